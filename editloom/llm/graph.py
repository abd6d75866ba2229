"""Connected components by alternating stars, and block units for comparisons inside groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editloom.llm.base import drop, save, width

EDGES_A_TASK = 100_000


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, root): every node of ``edges`` (a, b) that isn't its component's smallest, with the smallest.

    Alternating large and small stars: each round is two joins over the edges, whose number never
    grows; rounds grow with the logarithm of the component's size. Hubs meet only joins of two plain
    exchanges, which adaptive execution splits, and pre-aggregated minima. Null ends and loops are ignored.
    """
    a, b = F.col("a"), F.col("b")
    pairs = edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = save(pairs, f"{name}-edges")
    # Few edges are worked on by few tasks; their number never grows.
    tasks = now.count() // EDGES_A_TASK + 1

    def met(df: DataFrame) -> DataFrame:
        return df if tasks == 1 else df.hint("merge")  # files of edges are a fraction of their rows

    def keep(df: DataFrame, part: str) -> DataFrame:
        return save(df.coalesce(tasks) if tasks < width(df.sparkSession) else df, f"{name}-{part}")

    while not _is_star(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = keep(both.join(met(low), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        low2 = keep(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(met(low2), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        then = keep(small.unionByName(low2.select("u", F.col("m").alias("v"))).distinct(), "edges")
        drop(now, low, large, low2)
        now = then
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _is_star(edges: DataFrame) -> bool:
    """Each upper end once, and none of them a lower end."""
    kinds = edges.select(F.col("u").alias("n"), F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("n"), F.lit(0).alias("up")))
    bad = kinds.groupBy("n").agg(F.sum("up").alias("ups"), F.min("up").alias("low")).where("ups > 1 or (ups = 1 and low = 0)")
    return bad.isEmpty()


def block_units(df: DataFrame, key: str, identity: str, size: int, name: str, keys: DataFrame | None = None) -> DataFrame:
    """Rows with ``unit_i``, ``unit_j``, ``block``: each pair of rows of one key meets in a unit of at most
    about two blocks of ``size`` rows. Small keys are one unit; a key of n rows makes (n/size)**2/2 units,
    each a small task of its own, and no pair is written out. ``keys``: the same keys, if they are at hand."""
    big = save(
        (df if keys is None else keys).groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > size).select(key, F.ceil(F.col("__n") / size).cast("int").alias("__blocks")),
        f"{name}-big",
    )
    block = F.coalesce(F.pmod(F.xxhash64(identity, F.lit(11)), F.col("__blocks")).cast("int"), F.lit(0))
    others = F.sequence(F.lit(0), F.coalesce(F.col("__blocks"), F.lit(1)) - 1)
    return (
        df.join(big, key, "left")
        .withColumn("block", block)
        .withColumn("__other", F.explode(others))
        .withColumn("unit_i", F.least("block", "__other"))
        .withColumn("unit_j", F.greatest("block", "__other"))
        .drop("__blocks", "__other")
    )


def stream_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Cut batches sorted by ``keys`` (integers, not null) into one table a group."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for m in marks:
            change[1:] |= m[1:] != m[:-1]
        first = tuple(m[0] for m in marks)
        change[0] = last is not None and first != last
        cuts = np.flatnonzero(change)
        at = 0
        for cut in cuts:
            if cut > at:
                held.append(batch.slice(at, cut - at))
            if held:
                yield pa.Table.from_batches(held)
            held, at = [], cut
        held.append(batch.slice(at))
        last = tuple(m[-1] for m in marks)
    if held:
        yield pa.Table.from_batches(held)


def local_labels(linked: np.ndarray) -> np.ndarray:
    """Least index reachable within a boolean symmetric matrix."""
    n = len(linked)
    label = np.arange(n)
    near = linked | np.eye(n, dtype=bool)
    while True:
        then = np.where(near, label[None, :], n).min(1)
        then = then[then]
        if (then == label).all():
            return label
        label = then
