"""Document fingerprints by MinHash, and near groups from signature bands.

A fingerprint holds, for each of ``PERMUTATIONS`` universal hashes, 16 bits of the least value over the
text's five-word shingles (words lower-cased in A-Z; fewer words are one shingle), in base64. The share of
equal lanes estimates the Jaccard similarity of the shingle sets; texts with equal words have equal
fingerprints. ``near_groups`` joins bands of lanes in Spark: members of a band bucket join its smallest
member's group, so a bucket of any size costs a row a member, and groups are then compared on full
shingle sets, block by block.

Defined cases: a null text is empty; an empty text has a fingerprint of its own kind, like only to
itself; null doc_ids rank lowest; rows that repeat a doc_id follow each other by a digest of their text;
a table of one row is its own neighbour; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from editloom.llm.base import drop, save, ship, width
from editloom.llm.near_dedup import near_components, signed
from editloom.llm.text import Permutations, text_shingles

PERMUTATIONS, SHINGLE, BAND = 128, 5, 4
LOWEST = -(1 << 63)
PRINTS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def lanes(column: pa.Array, count: int = PERMUTATIONS, k: int = SHINGLE) -> np.ndarray:
    """uint16 (texts, count): the low halves of the least values."""
    perms = Permutations(count)
    parts = [perms.signatures(h, bounds).astype(np.uint16) for _, _, h, bounds in text_shingles(column, k)]
    return np.concatenate(parts) if parts else np.zeros((0, count), np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=1)


def _print(row: np.ndarray) -> str:
    return base64.b64encode(row.tobytes()).decode()


def range_bucket(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted ``bounds`` lie below ``key``, looked up in two steps of about their square root."""
    if not bounds:
        return F.lit(0)
    step = isqrt(len(bounds)) + 1
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    chunks = F.array(*[longs(bounds[i : i + step]) for i in range(0, len(bounds), step)])
    top = F.size(F.filter(longs(bounds[::step]), lambda b: b < key))
    return F.when(top == 0, F.lit(0)).otherwise((top - 1) * step + F.size(F.filter(F.get(chunks, top - 1), lambda b: b < key)))


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """Rows key, is_copy, doc_id, text: ranges of ids, one a partition, each sorted by descending id and
    followed by a copy of the row that comes next. The driver holds two ids a partition."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST).cast("long"))
    rows = docs.select(key.alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    shares = [i / parts for i in range(1, parts)]
    found = rows.agg(F.percentile_approx("key", shares, max(10_000, 20 * parts)).alias("q")).first().q if shares else []
    bounds = sorted(set(found or []))
    bucket = range_bucket(F.col("key"), bounds).cast("int")
    tops = dict(rows.select(bucket.alias("bucket"), "key").groupBy("bucket").agg(F.max("key").alias("top")).collect())
    used = sorted(tops)
    if not used:
        return rows.select("key", F.lit(False).alias("is_copy"), "doc_id", "text")
    above = {b: used[(i + 1) % len(used)] for i, b in enumerate(used)}
    top = F.array(*[F.lit(tops.get(b)).cast("long") for b in range(used[-1] + 1)])
    up = F.array(*[F.lit(above.get(b, 0)) for b in range(used[-1] + 1)])
    target = lambda b, copy: F.struct(b.alias("bucket"), F.lit(copy).alias("is_copy"))
    own = F.col("bucket")
    sent = F.when(F.col("key") == F.get(top, own), F.array(target(own, False), target(F.get(up, own), True))).otherwise(F.array(target(own, False)))
    return (
        rows.withColumn("bucket", bucket)
        .withColumn("to", F.explode(sent))
        .repartitionById(len(bounds) + 1, F.col("to.bucket"))
        .select("key", F.col("to.is_copy").alias("is_copy"), "doc_id", "text")
        .sortWithinPartitions("is_copy", F.desc("key"), F.xxhash64("text"))
    )


def fingerprints(docs: DataFrame, count: int = PERMUTATIONS, k: int = SHINGLE) -> DataFrame:
    """PRINTS for every row of ``docs`` (doc_id, text): its fingerprint, that of its text with the last half
    replaced by the first characters of the next row's in descending doc_id, and their likenesses."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512).select(["is_copy", "doc_id", "text"])
                table = pa.concat_tables([pa.Table.from_batches([b]) for b in ([held] if held is not None else []) + [rows]]).combine_chunks()
                copy = table.column("is_copy").to_numpy()
                own = min(int((~copy).sum()), table.num_rows - 1)
                if own:
                    yield emit(table, own)
                last = table.slice(own, 1).to_batches()
                held = last[0] if last else held

    def emit(table: pa.Table, own: int) -> pa.RecordBatch:
        texts = table.column("text").to_pylist()[: own + 1]
        edited = []
        for text, then in zip(texts, texts[1:]):
            half = len(text) // 2
            edited.append(text[: len(text) - half] + then[:half])
        mine, other = lanes(table.column("text").slice(0, own + 1), count, k), lanes(pa.array(edited, pa.large_string()), count, k)
        return pa.RecordBatch.from_arrays(
            [
                table.column("doc_id").slice(0, own).combine_chunks(), pa.array([len(t) for t in texts[:own]], pa.int64()),
                pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited]),
                pa.array([_print(r) for r in mine[:own]]), pa.array([_print(r) for r in other]),
                pa.array(likeness(mine[:own], other)), pa.array(likeness(mine[:-1], mine[1:])),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    return with_next(docs, width(docs.sparkSession)).mapInArrow(run, PRINTS)


def banded(docs: DataFrame, count: int = PERMUTATIONS, k: int = SHINGLE) -> DataFrame:
    """``near_dedup.signed`` with a fingerprint's lanes for its signature."""
    return signed(docs, count, k).withColumn("sig", F.transform("sig", lambda v: v.bitwiseAND(0xFFFF)))


def band_edges(reps: DataFrame, percent: int = 80, band: int = BAND) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b) over ``reps`` (cid, sig): members of a band bucket to its smallest member; no class is on a hot list."""
    number = F.posexplode(F.transform(F.sequence(F.lit(0), F.floor(F.size("sig") / F.lit(band)).cast("int") - 1), lambda i: F.concat_ws(",", F.slice("sig", i * band + 1, band).cast("array<string>")))).alias("number", "mark")
    bands = save(reps.select("cid", number), "bands")
    heads = save(bands.groupBy("number", "mark").agg(F.min("cid").alias("a"), F.max("cid").alias("z")).where("a < z").select("number", "mark", "a"), "band-heads")
    edges = save(bands.join(heads, ["number", "mark"]).where("cid > a").select("a", F.col("cid").alias("b")).distinct(), "band-edges")
    drop(bands, heads)
    return edges, reps.select("cid", F.lit(0).cast("long").alias("heat")).limit(0)


def near_groups(docs: DataFrame, percent: int = 80, k: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row: documents that bands of lanes bring into one group are
    linked where their full shingle sets have that similarity."""
    return near_components(docs, percent, k, banded, band_edges)


def op1_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
