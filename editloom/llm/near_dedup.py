"""MinHash near-dedup by a signature-coordinate inverted join.

Texts of equal words are one class. Every class is posted under each (coordinate, value) pair of its
signature. Posting lists longer than ``hot`` are skipped in the merge: what they could add is bounded by
the number of hot coordinates a class has, so the collision count asked of the short lists is lowered by
exactly that. Short lists are joined over a prefix of each class's cold coordinates (all but as many as
the threshold allows to differ, plus a margin that must be collided on); of the pairs met, all coordinates
are then counted, and those at the match threshold are kept. Classes hot in so many coordinates that they
could match on hot lists alone are grouped by those lists.

Links are decided on full shingle sets, numbered by their words without hashes. Each group of candidates
up to ``BLOCK`` texts is one unit, its texts shipped once. In a larger group all texts first meet one
leader, the text on most hot lists; only texts that it does not link go on to meet the rest of the group,
block by block. Units are dealt to tasks by number, so those of one group are spread; blocks hold at most
about ``BLOCK`` texts or ``BLOCK_CHARS`` characters.

Only the signature is random: a pair at the threshold itself is missed with a chance of about 1e-6.

Defined cases: a null or blank text has no shingles, links with nothing and is its own component;
a null doc_id takes no part, its component is null and it is kept; repeated rows and equal texts
share a component, and every row that carries the smallest doc_id is kept; rows that repeat a doc_id
with different texts are compared each, and a component is named by the smallest doc_id in it.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from editloom.llm.base import drop, save, ship, sized, unused, width
from editloom.llm.graph import components, local_labels, stream_groups
from editloom.llm.text import FOLD, IS_SPACE, Permutations, buffers, exact_sets, shingles, slices, steps, word_hashes

COORDINATES, SHINGLE, PERCENT = 64, 5, 80
HOT, MARGIN, BLOCK, BLOCK_CHARS = 32, 16, 256, 1 << 22
_SIGNED = "doc_id long, mark binary, n_shingles long, words binary, sig array<int>"
_UNIT = ["grp", "unit_i", "unit_j"]


def match_threshold(share: float, coordinates: int = COORDINATES, miss: float = 1e-6) -> int:
    """Most matches to ask for so that a pair of that similarity falls short with a chance of at most ``miss``."""
    total = 0.0
    for m in range(coordinates + 1):
        total += comb(coordinates, m) * share**m * (1 - share) ** (coordinates - m)
        if total > miss:
            return max(m, 1)
    return coordinates


def text_mark(text: Column) -> Column:
    """128 bits of a text's SHA-256; null counts as empty."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)), 1, 16)


def signed(docs: DataFrame, coordinates: int = COORDINATES, k: int = SHINGLE) -> DataFrame:
    """doc_id, mark (of the text), n_shingles, a 128-bit digest of the words in order, and the signature of the shingle set."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        perms = Permutations(coordinates)
        for batch in steps(batches, 512):
            raw, off = buffers(batch.column(2))
            found, names = [], []
            for a, b in slices(off):
                part = raw[off[a] : off[b]]
                words, lengths, bounds = word_hashes(part, off[a : b + 1] - off[a])
                runs, ends = shingles(words, bounds, k)
                solid, cuts = FOLD[part[~IS_SPACE[part]]], np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])[bounds]
                for i in range(b - a):
                    found.append(np.unique(runs[ends[i] : ends[i + 1]]))
                    name = blake2b(solid[cuts[i] : cuts[i + 1]].data, digest_size=16)
                    name.update(lengths[bounds[i] : bounds[i + 1]].data)
                    names.append(name.digest())
            sizes = np.array([len(s) for s in found], np.int64)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            sig = perms.signatures(np.concatenate(found) if found else np.zeros(0, np.uint64), ends)
            lists = pa.ListArray.from_arrays(np.arange(len(found) + 1, dtype=np.int32) * coordinates, pa.array(sig.view(np.int32).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes), pa.array(names, pa.binary()), lists], names=["doc_id", "mark", "n_shingles", "words", "sig"])

    return docs.select(F.col("doc_id").cast("long"), text_mark(F.col("text")), F.col("text").cast("string")).mapInArrow(run, _SIGNED)


def candidates(reps: DataFrame, percent: int, coordinates: int = COORDINATES, hot: int = HOT, margin: int = MARGIN) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b) over ``reps`` (cid, sig), and (cid, heat) of those on hot lists: all pairs that match in
    enough coordinates lie in one component of the edges. Such a pair shows at least the threshold less its
    heat in cold collisions, or both are hot in so many coordinates and share a hot list."""
    threshold = match_threshold(percent / 100, coordinates)
    posts = reps.select("cid", F.posexplode("sig").alias("c", "v")).select(
        "cid", "c", (F.shiftleft(F.col("c").cast("long"), 32) + F.col("v").cast("long") + F.lit(1 << 31)).alias("token")
    )
    lists = save(posts.groupBy("token").agg(F.count("*").alias("df"), F.min("cid").alias("leader")).where("df > 1"), "near-lists")
    # Posts are exploded: at any size Spark takes them for a fraction of what they are.
    hits = save(posts.join(lists.hint("merge"), "token"), "near-hits")
    hot_hits = hits.where(F.col("df") > hot)
    heat = save(hot_hits.groupBy("cid").agg(F.count("*").alias("heat"), F.array_sort(F.collect_set("c")).alias("hot_at")), "near-heat")  # at most one entry a coordinate
    few_hot, signatures = sized(heat, 80 + 4 * coordinates), sized(reps, 80 + 4 * coordinates)
    # A cold coordinate shared with nobody never collides, so a prefix ends where its coordinate number
    # does: two classes cut theirs at the same order of coordinates.
    prefix = coordinates - threshold + margin
    cold = (
        hits.where(F.col("df") <= hot)
        .join(few_hot, "cid", "left")
        .withColumn("place", F.col("c") - F.coalesce(F.size(F.filter("hot_at", lambda x: x < F.col("c"))), F.lit(0)))
        .where(F.col("place") < prefix)
        .select("token", "cid", F.coalesce("heat", F.lit(0)).alias("heat"))
    )
    left = cold.select("token", F.col("cid").alias("b"), F.col("heat").alias("heat_b"))
    right = cold.select("token", F.col("cid").alias("a"), F.col("heat").alias("heat_a")).hint("merge")
    least = F.least(F.min("heat_a"), F.min("heat_b"))
    need = F.when(least >= threshold, F.lit(threshold)).otherwise(F.lit(threshold) - least)
    met = left.join(right, "token").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"), need.alias("need")).where(F.col("n") >= F.least("need", F.lit(margin)))
    full = met.select("a", "b").join(signatures.select(F.col("cid").alias("a"), F.col("sig").alias("sig_a")), "a")
    full = full.join(signatures.select(F.col("cid").alias("b"), F.col("sig").alias("sig_b")), "b")
    matches = F.size(F.filter(F.zip_with("sig_a", "sig_b", lambda x, y: x == y), lambda same: same))
    pairs = full.where(matches >= threshold).select("a", "b")
    # The list's smallest member may itself be too cold to match; the edge to it only groups.
    stars = hot_hits.join(few_hot.where(F.col("heat") >= threshold).select("cid"), "cid", "left_semi").select(F.col("leader").alias("a"), F.col("cid").alias("b")).where("a < b").distinct()
    out = save(pairs.unionByName(stars), "near-pairs")
    drop(hits, lists)
    return out, heat.select("cid", "heat")


def _dealt(units: DataFrame) -> DataFrame:
    """Units to partitions: those of one group one after another from a place of its own."""
    parts = width(units.sparkSession)
    place = F.pmod(F.xxhash64("grp"), F.lit(parts)) + F.col("unit_i") * F.lit(7919) + F.col("unit_j")
    return units.repartitionById(parts, F.pmod(place, F.lit(parts)).cast("int")).sortWithinPartitions(*_UNIT, "cid")


def _compare(units: DataFrame, percent: int, k: int, of: str) -> DataFrame:
    """Edges (a, b) found in each unit of rows cid, text, first. ``of`` says which pairs: 'all', or those with
    at least one of the ``first``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in stream_groups(batches, _UNIT):
            table = table.set_column(table.schema.get_field_index("text"), "text", table.column("text").cast(pa.large_string()))
            # A text that stands there as first and as one of the rest is compared as first.
            table = table.sort_by([("first", "descending"), ("cid", "ascending")])
            names, at = np.unique(table.column("cid").to_numpy(), return_index=True)
            table = table.take(np.sort(at))
            ids = table.column("cid").to_numpy()
            if len(ids) < 2:
                continue
            found = exact_sets(table.column("text"), k)
            if of == "all":
                linked = _links(found, percent)
            else:
                n = int(np.sum(table.column("first").to_numpy(zero_copy_only=False)))
                linked = _links(found, percent, heads=n)
            label = local_labels(linked)
            away = label != np.arange(len(ids))
            if away.any():
                yield pa.RecordBatch.from_arrays([pa.array(ids[label[away]]), pa.array(ids[away])], names=["a", "b"])

    return _dealt(units.select(*_UNIT, "cid", "text", "first")).mapInArrow(run, "a long, b long")


def verified(groups: DataFrame, percent: int, k: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that span the links within ``groups`` (grp, cid, heat, text): 100 * shared >= percent * joint."""
    ship(groups.sparkSession)
    chars = F.sum(F.length("text"))
    blocks = lambda n: F.greatest(F.ceil(n / block), F.ceil(chars / BLOCK_CHARS)).cast("int")
    sizes = groups.groupBy("grp").agg(blocks(F.count("*")).alias("blocks"), F.max(F.struct("heat", (-F.col("cid")).alias("minus"))).alias("top"))
    big = save(sizes.where("blocks > 1").select("grp", "blocks", (-F.col("top.minus")).alias("leader")), "near-sizes")
    zero, no = F.lit(0), F.lit(False)
    small = groups.join(big.select("grp"), "grp", "left_anti").select("grp", zero.alias("unit_i"), zero.alias("unit_j"), "cid", "text", no.alias("first"))
    links = save(_compare(small, percent, k, "all"), "near-links")
    if big.isEmpty():
        return links
    mine = lambda n, seed: F.pmod(F.xxhash64("cid", F.lit(seed)), n).cast("int")
    over = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    rows = groups.join(big, "grp")
    led = rows.where("cid = leader").select("grp", over(F.col("blocks")).alias("unit_i"), zero.alias("unit_j"), "cid", "text", F.lit(True).alias("first"))
    rest = rows.where("cid <> leader").select("grp", mine(F.col("blocks"), 11).alias("unit_i"), zero.alias("unit_j"), "cid", "text", no.alias("first"))
    near = save(_compare(led.unionByName(rest), percent, k, "first"), "near-led")
    # What meets its leader carries its link as (leader, cid) or (cid, leader).
    ends = sized(near.select(F.col("a").alias("end")).unionByName(near.select(F.col("b").alias("end"))).distinct(), 40, 2 * near.count())
    far = save(rows.where("cid <> leader").select("grp", "cid", "blocks", "text").join(ends, F.col("cid") == F.col("end"), "left_anti"), "near-far")
    again = far.groupBy("grp").agg(blocks(F.count("*")).alias("heads"))
    firsts = far.join(again, "grp").select("grp", mine(F.col("heads"), 13).alias("unit_i"), over(F.col("blocks")).alias("unit_j"), "cid", "text", F.lit(True).alias("first"))
    others = rows.where("cid <> leader").join(again, "grp").select("grp", over(F.col("heads")).alias("unit_i"), mine(F.col("blocks"), 11).alias("unit_j"), "cid", "text", no.alias("first"))
    return links.unionByName(near).unionByName(save(_compare(firsts.unionByName(others), percent, k, "first"), "near-crossed"))


def _links(found: list[np.ndarray], percent: int, heads: int | None = None, columns: int = 4096) -> np.ndarray:
    """Which pairs of sets are similar enough: shared sizes by products of 0/1 blocks over the shared numbers.
    With ``heads``, only pairs with one of the first so many sets."""
    sizes = np.array([len(s) for s in found], np.int64)
    flat = np.concatenate(found)
    owner = np.repeat(np.arange(len(found)), sizes)
    _, where, counts = np.unique(flat, return_inverse=True, return_counts=True)
    common = counts > 1
    number = np.cumsum(common) - 1
    keep = common[where]
    at, owner = number[where[keep]], owner[keep]
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    top = len(found) if heads is None else heads
    shared = np.zeros((top, len(found)), np.float32)
    for c in range(0, int(at[-1]) + 1 if len(at) else 0, columns):
        lo, hi = np.searchsorted(at, [c, c + columns])
        grid = np.zeros((len(found), columns), np.float32)
        grid[owner[lo:hi], at[lo:hi] - c] = 1
        shared += grid[:top] @ grid.T
    both = shared.astype(np.int64)
    joint = sizes[:top, None] + sizes[None, :] - both
    out = np.zeros((len(found), len(found)), bool)
    out[:top] = (100 * both >= percent * joint) & (both > 0)
    out[:, :top] |= out[:top].T
    np.fill_diagonal(out, False)
    return out


def grouped_texts(edges: DataFrame, classes: DataFrame, docs: DataFrame, heat: DataFrame) -> DataFrame:
    """grp, cid, heat, text, saved: the texts of the classes (cid, doc_id, mark) that ``edges`` group."""
    roots = components(edges, "near-groups")
    members = roots.select(F.col("node").alias("cid"), F.col("root").alias("grp")).unionByName(roots.select(F.col("root").alias("cid"), F.col("root").alias("grp")).distinct())
    members = sized(members, 40).join(classes.select("cid", F.col("doc_id").alias("of"), F.col("mark").alias("own")), "cid").join(sized(heat, 40), "cid", "left")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    # By merge at any size: what is small here on a small table is not bounded on a large one.
    found = members.hint("merge").join(texts, F.col("id") == F.col("of")).where(text_mark(F.col("text")) == F.col("own"))
    out = save(found.select("grp", "cid", F.coalesce("heat", F.lit(0)).cast("long").alias("heat"), "text").dropDuplicates(["cid"]), "near-texts")
    drop(roots)
    return out


def told(docs: DataFrame, percent: int, k: int, sign: Callable = signed, find: Callable = candidates) -> tuple[DataFrame, DataFrame]:
    """(table, classes): the signed rows, and for each class (words) its first row (doc_id, mark) and the
    component's first row ``head`` where others are in it. ``sign`` makes the signatures, ``find`` the candidates."""
    table = save(sign(docs, k=k), "near-signed")
    real = table.where("doc_id is not null and n_shingles > 0")
    classes = real.groupBy("words").agg(F.min(F.struct("doc_id", "mark")).alias("first"), F.count("*").alias("copies"), F.min("sig").alias("sig"))
    classes = save(classes.select(F.monotonically_increasing_id().alias("cid"), "words", "first.doc_id", "first.mark", "copies", "sig"), "near-classes")
    edges, heat = find(classes.select("cid", "sig"), percent)
    texts = grouped_texts(edges, classes, docs, heat)
    final = components(verified(texts, percent, k))
    rooted = final.select(F.col("node").alias("cid"), "root").unionByName(final.select(F.col("root").alias("cid"), "root").distinct())
    named = save(sized(rooted, 40).join(classes.select("cid", F.struct("doc_id", "mark").alias("own")), "cid"), "near-named")
    many = named.count()
    heads = named.groupBy("root").agg(F.min("own").alias("head"))
    drop(edges, heat, texts, final)
    return table, classes.join(sized(sized(named, 120, many).join(heads, "root").select("cid", "head"), 120, many), "cid", "left")


def near_components(docs: DataFrame, percent: int = PERCENT, k: int = SHINGLE, sign: Callable = signed, find: Callable = candidates) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept."""
    table, classes = told(docs, percent, k, sign, find)
    # Only classes with others in their component, or with copies, need telling.
    few = save(classes.where("head is not null or copies > 1").select(F.col("words").alias("of"), F.coalesce("head.doc_id", "doc_id").alias("root")), "near-told")
    few = sized(few, 80)
    drop(classes)
    out = table.select("doc_id", "n_shingles", "words").join(few, F.col("words") == F.col("of"), "left")
    component = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.coalesce("root", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicate(docs: DataFrame, percent: int = PERCENT, k: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the first text of the smallest id, once; of rows that
    repeat an id and a blank text, one. Which of several rows with that id and text stays is decided by a
    digest of the whole row."""
    table, classes = told(docs, percent, k)
    heads = classes.where("head is null or (head.doc_id = doc_id and head.mark = mark)").select("doc_id", "mark")
    blank = table.where("doc_id is not null and n_shingles = 0").select("doc_id", "mark")
    rows = table.where("doc_id is not null").groupBy("doc_id", "mark").agg(F.count("*").alias("n"))
    identity, mark, n, place = (unused(docs, x) for x in ("kept_id", "kept_mark", "kept_rows", "kept_place"))
    stay = heads.unionByName(blank.distinct()).join(rows.hint("merge"), ["doc_id", "mark"])
    stay = save(stay.select(F.col("doc_id").alias(identity), F.col("mark").alias(mark), F.col("n").alias(n)), "near-kept")
    drop(table, classes)
    own = docs.withColumn(place, text_mark(F.col("text")))
    on = (own["doc_id"].cast("long") == F.col(identity)) & (own[place] == F.col(mark))
    once = own.join(sized(stay.where(F.col(n) == 1), 80), on, "left_semi").select(*docs.columns)
    order = Window.partitionBy(identity, mark).orderBy(F.xxhash64(F.to_json(F.struct(*[own[c] for c in docs.columns]))))
    repeated = own.join(sized(stay.where(F.col(n) > 1), 80), on).withColumn(n, F.row_number().over(order)).where(F.col(n) == 1)
    return once.unionByName(repeated.select(*docs.columns)).unionByName(docs.where(F.col("doc_id").isNull()))


def op4_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), percent=85)
