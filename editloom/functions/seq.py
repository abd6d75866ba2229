"""Sequence, haplotype and naming functions as Columns.

A haplotype is MAP<STRING, STRING> from ``<ref><pos>`` (C6) to the observed nucleotide, ``.`` if unknown.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from editloom.functions.special import let

#: The standard genetic code in TCAG order; ``_`` is a stop.
AMINO_ACIDS = "FFLLSSSSYY__CC_WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
ORDER = "TCAG"


def substr0(s: Column, start: Column, length: Column | int) -> Column:
    """``length`` characters from 0-based ``start``."""
    return F.substring(s, (start + 1).cast("int"), F.lit(length) if isinstance(length, int) else length.cast("int"))


def context(seq: Column, idx: Column, radius: int) -> Column:
    """``radius`` characters on each side, the centre left out; null where the sequence ends first."""
    whole = (idx >= radius) & (idx + radius < F.length(seq))
    return F.when(whole, F.concat(substr0(seq, idx - radius, radius), substr0(seq, idx + 1, radius)))


def window30(seq: Column, pos0_idx: Column) -> Column:
    """Positions -9 .. 20 around the protospacer's zero index."""
    return F.when(pos0_idx >= 9, substr0(seq, pos0_idx - 9, 30))


def reverse_complement(s: Column) -> Column:
    """X2."""
    return F.reverse(F.translate(s, "ACGT", "TGCA"))


def amino_acid(codon: Column) -> Column:
    """The codon's letter, by its place in the table; an unknown character gives null."""
    at = [F.instr(F.lit(ORDER), F.substring(codon, i, 1)) - 1 for i in (1, 2, 3)]
    known = (at[0] >= 0) & (at[1] >= 0) & (at[2] >= 0) & (F.length(codon) == 3)
    return F.when(known, substr0(F.lit(AMINO_ACIDS), at[0] * 16 + at[1] * 4 + at[2], 1))


def translate_frame(seq30: Column, frame: Column, position: Column, strand: Column) -> Column:
    """Amino acids of a 30-character window read so that the base at ``position`` (0 is the window's tenth)
    has codon place ``frame`` (1-3) on ``strand``; an intronic (null) frame gives ''."""
    turned = strand == "-"
    text = F.when(turned, reverse_complement(seq30)).otherwise(seq30)
    at = F.when(turned, F.length(seq30) - (position + 9) - 1).otherwise(position + 9)
    first = F.pmod(3 - F.pmod(frame - 1 - at, F.lit(3)), F.lit(3))
    letters = let(F.struct(text.alias("s"), first.alias("f")), lambda v: F.array_join(F.transform(F.sequence(v["f"] + 1, F.length(v["s"]) - 2, F.lit(3)), lambda i: amino_acid(F.substring(v["s"], i, F.lit(3)))), ""))
    return F.when(frame.isNull(), F.lit("")).otherwise(letters)


def apply_haplotype(seq30: Column, hap: Column) -> Column:
    """The window with the haplotype's nucleotides put in."""
    def place(i: Column) -> Column:
        base = F.substring(seq30, i, F.lit(1))
        return F.coalesce(F.element_at(hap, F.concat(base, (i - 10).cast("string"))), base)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(seq30)), place), "")


def match_count(grna: Column, seq: Column, start: Column) -> Column:
    """Equal characters of the guide and the sequence from 0-based ``start``."""
    return F.size(F.filter(F.sequence(F.lit(1), F.length(grna)), lambda i: F.substring(grna, i, F.lit(1)) == substr0(seq, start + i - 1, 1)))


def count_in(text: Column, nt: Column | str) -> Column:
    """Occurrences of one nucleotide."""
    return F.length(text) - F.length(F.replace(text, nt if isinstance(nt, Column) else F.lit(nt), F.lit("")))


def core_count(grna: Column, nt: Column | str, first: int, last: int) -> Column:
    """Occurrences within guide positions ``first`` .. ``last`` (from 1)."""
    return count_in(F.substring(grna, F.lit(first), F.lit(last - first + 1)), nt)


def run_length(seq: Column, idx: Column, nt: str = "C") -> Column:
    """Length of the run of ``nt`` that ends at 0-based ``idx``."""
    return F.length(F.regexp_extract(F.substring(seq, F.lit(1), (idx + 1).cast("int")), f"{nt}*$", 0))


def left_shift(start: Column, end: Column, mh: Column, edit: int = 6, nick: int = 18, long: int = 7) -> Column:
    """The shift below ``mh`` that brings an indel's midpoint nearest to the editing or nick position, the least
    of equals; an indel of ``long`` bases or more stops where its end meets the nick."""
    distance = lambda s: F.least(F.abs((start + end) / 2.0 - s - edit), F.abs((start + end) / 2.0 - s - nick))
    best = F.array_min(F.transform(F.sequence(F.lit(0), F.greatest(mh, F.lit(1)) - 1), lambda s: F.struct(distance(s).alias("d"), s.alias("s"))))["s"]
    meets = (end - start >= long) & (end - nick >= 0) & (end - nick < mh)
    return F.when(mh <= 0, F.lit(0)).when(meets, end - nick).otherwise(best).cast("int")


def label(idx: Column, pos1_idx: int) -> Column:
    """Signed position label; positions from the protospacer's first on get a plus."""
    return F.when(idx < pos1_idx, (idx - pos1_idx).cast("string")).otherwise(F.concat(F.lit("+"), (idx - pos1_idx + 1).cast("string")))


def series(name: Column, category: Column) -> tuple[Column, Column]:
    """(category, subcategory) labels of an off-target design from the parts of its name."""
    part = F.split(name, "_")
    kind = F.when(category == "guideseq", "Off-target series").when(category == "mismatch", "Mismatch series").when(category == "chipseq", "Chip series").when(category == "vivo", "vivo").otherwise("On-target")
    sub = F.when(category == "guideseq", F.get(part, F.lit(2))).when(category == "mismatch", F.get(part, F.lit(1))).when(category == "chipseq", F.lit(None).cast("string")).when(category == "vivo", "vivo").otherwise("On-target")
    return kind, sub


def profile_range(cell: Column) -> tuple[Column, Column]:
    """First and last position of a cell like ``(3, 9)``."""
    return tuple(F.regexp_extract(cell, r"\((-?\d+), *(-?\d+)\)", i).cast("int") for i in (1, 2))


def edited(key: Column, value: Column) -> Column:
    """Whether a haplotype entry is a known nucleotide other than the reference."""
    return (value != ".") & (value != F.substring(key, 1, 1))


def n_edits(hap: Column) -> Column:
    """X12."""
    return F.size(F.map_filter(hap, edited))


def is_edited(hap: Column) -> Column:
    """F5."""
    return F.exists(F.map_entries(hap), lambda e: edited(e["key"], e["value"]))


def has_edit(hap: Column, ref: str, obs: tuple[str, ...]) -> Column:
    """some ``ref`` position observed as one of ``obs``."""
    return F.exists(F.map_entries(hap), lambda e: (F.substring(e["key"], 1, 1) == ref) & e["value"].isin(*obs))


def impute(hap: Column) -> Column:
    """unknown nucleotides read as the reference."""
    return F.transform_values(hap, lambda k, v: F.when(v == ".", F.substring(k, 1, 1)).otherwise(v))


def position_of(key: Column) -> Column:
    return F.substring(key, 2, 10).cast("int")


def hap_text(hap: Column) -> Column:
    """A haplotype as text in order of position; also a join key, which a map cannot be."""
    entries = F.array_sort(F.transform(F.map_entries(hap), lambda e: F.struct(position_of(e["key"]).alias("p"), e["key"].alias("k"), e["value"].alias("v"))))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["k"], F.lit("="), e["v"])), ",")


def logit(x: Column) -> Column:
    """T19; null outside (0, 1)."""
    return F.when((x > 0) & (x < 1), F.ln(x / (1 - x)))


def expit(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def parse_id(text: Column) -> tuple[Column, Column]:
    """Name and fraction of a hyper-parameter id like ``name_0.5``; no fraction means 1.0."""
    fraction = F.regexp_extract(text, r"_(\d+\.\d+)$", 1)
    return F.regexp_replace(text, r"_\d+\.\d+$", ""), F.when(fraction == "", "1.0").otherwise(fraction).cast("double")
