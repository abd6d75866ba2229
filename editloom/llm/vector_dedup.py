"""Embedding near-dedup by a forest of random-projection trees with spill overlap.

Equal vectors are one class with a count. A node splits at the median of a random projection (one
direction a tree and level), and vectors near the cut go both ways: those within ``spill`` of the ranks
around it, and those within the distance that a pair at the cosine threshold spreads over in a random
direction. A group of near copies therefore goes down together and ends in leaves that hold all of it,
however large, which are compared in blocks. Every class goes down every tree.

Trees grow in stages, as deep as the rows need. A stage fits each open node on a bounded sample of the
node's own rows, and splits until the rows expected in a part fit a leaf or its sample runs low; parts that
still hold more go to the next stage. Nodes are numbered as in a binary heap, the trees being its nodes
``trees`` to ``2 * trees - 1``. Vectors of different lengths never link: each length has a forest.

Classes in one leaf are compared, block by block, by cosine in double precision; a pair that meets in
several leaves is counted in the first, told by the leaves both carry, so links are counted without
writing pairs. Leaves are joined by their local components and then unioned.

Defined cases: a vector that is null, empty, zero, or holds null or non-finite components links with
nothing; vectors are scaled by their largest component before squaring, so no finite one over- or
underflows; a null vec_id takes no part, has no component and is kept; repeated rows are copies of each
other and link; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editloom.llm.base import drop, save, ship
from editloom.llm.graph import block_units, components, local_labels, stream_groups

COSINE, TREES, LEAF, SPILL, SAMPLE, BLOCK, SEED = 0.9, 8, 512, 0.05, 20_000, 1024, 5
SPREAD, MOST_SHARED, LEAST_SAMPLED, MOST_DEPTH, SALT_ROWS = 0.75, 0.4, 24, 48, 50_000


def directions(tree: int, size: int, seed: int = SEED) -> np.ndarray:
    """float32 (MOST_DEPTH, size), the same on every machine."""
    return np.random.default_rng([seed, tree]).standard_normal((MOST_DEPTH, size)).astype(np.float32)


class Piece:
    """What a stage adds below a node: two thresholds for each node that splits, in heap order from 1; below
    the upper goes left, from the lower goes right. A node that does not split has no lower one (nan), and an
    infinite upper one if only its sample ran low."""

    def __init__(self, low: np.ndarray, high: np.ndarray) -> None:
        self.low, self.high = low, high
        self.levels = max(len(low).bit_length() - 1, 0)

    @classmethod
    def fit(cls, shadows: np.ndarray, apart: np.ndarray, rows: int, leaf: int, spill: float) -> Piece:
        """``shadows``: a sample's projections, a column a level; ``apart``: how far a pair at the threshold lies
        in each; ``rows``: those that the sample stands for."""
        weight = rows / max(len(shadows), 1)
        cuts: dict[int, tuple[float, float]] = {}
        held = {1: np.arange(len(shadows))}
        while held:
            node, mine = held.popitem()
            level = node.bit_length() - 1
            # Spilled rows are counted too, so leaves keep their size however deep the tree is.
            wanted = ceil(len(mine) * weight / leaf)
            if wanted < 2 or level >= shadows.shape[1]:
                continue
            if len(mine) < LEAST_SAMPLED:
                cuts[node] = np.nan, np.inf
                continue
            shadow = shadows[mine, level]
            at, margin = wanted // 2 / wanted, apart[level] / 2
            low, cut, high = np.quantile(shadow, [max(at - spill, 0), at, min(at + spill, 1)])
            low, high = min(low, cut - margin), max(high, cut + margin)
            left, right = shadow <= high, shadow >= low
            if (left & right).mean() > MOST_SHARED:
                continue  # a dense group: splitting would only copy it
            cuts[node] = low, high
            held[2 * node], held[2 * node + 1] = mine[left], mine[right]
        size = 1 << max(cuts, default=0).bit_length()
        low, high = np.full(size, np.nan), np.full(size, np.nan)
        for node, both in cuts.items():
            low[node], high[node] = both
        return cls(low, high)

    def leaves(self, shadows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, heap numbers, and whether the node is open still: a row for each part a vector falls in."""
        row, node = np.arange(len(shadows)), np.ones(len(shadows), np.int64)
        done = []
        for level in range(self.levels):
            split = ~np.isnan(self.low[node])
            done.append((row[~split], node[~split], np.isinf(self.high[node[~split]])))
            row, node = row[split], node[split]
            shadow = shadows[row, level]
            left, right = shadow <= self.high[node], shadow >= self.low[node]
            row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left], 2 * node[right] + 1])
        done.append((row, node, np.zeros(len(row), bool)))
        return tuple(np.concatenate([d[i] for d in done]) for i in range(3))


def below(code: int, nodes: np.ndarray) -> np.ndarray:
    """Heap numbers under ``code`` of the nodes of a piece."""
    depth = np.floor(np.log2(nodes)).astype(np.int64)
    return (np.int64(code) << depth) + (nodes - (np.int64(1) << depth))


def unit_rows(column: pa.Array, size: int) -> np.ndarray:
    """float64 (rows, size) unit vectors from lists of that size, none of them zero."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = flat.reshape(-1, size)
    out = out / np.abs(out).max(axis=1, keepdims=True)
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def keyed(table: DataFrame) -> DataFrame:
    """vec_id, embedding (floats stay floats), and a digest that is null for vectors that can't link."""
    kind = "array<float>" if dict(table.dtypes)["embedding"] == "array<float>" else "array<double>"
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    can = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda x: x != 0)
    # -0.0 and 0.0 are one value
    text = F.concat_ws(",", F.transform("embedding", lambda x: (x.cast("double") + F.lit(0.0)).cast("string")))
    return rows.withColumn("digest", F.when(F.coalesce(can, F.lit(False)), F.sha2(text, 256)))


class Grower:
    """How one stage samples, fits and routes vectors of one length."""

    def __init__(self, size: int, cosine: float, trees: int, leaf: int, spill: float) -> None:
        self.size, self.trees, self.leaf, self.spill = size, trees, leaf, spill
        self.apart = SPREAD * np.sqrt(max(0.0, 2 - 2 * cosine) / size)

    def shadows(self, unit: np.ndarray, code: int) -> tuple[np.ndarray, np.ndarray]:
        """Projections of vectors on the directions of a node's tree from its level on, and how far pairs lie apart."""
        depth = code.bit_length() - self.trees.bit_length()
        lines = directions(code >> depth, self.size)[depth:]
        return unit.astype(np.float32) @ lines.T, np.linalg.norm(lines, axis=1) * self.apart

    def fit(self, group: pd.DataFrame) -> pd.DataFrame:
        """leaf, n, rep, embedding of a sample of one node to open, low, high."""
        group = group.sort_values("rep", ignore_index=True)
        code = int(group["leaf"][0])
        told = Piece.fit(*self.shadows(unit_rows(pa.array(group["embedding"]), self.size), code), int(group["n"][0]), self.leaf, self.spill)
        return pd.DataFrame({"open": [code], "low": [told.low], "high": [told.high]})

    def placed(self, reps: pa.Array, embeddings: pa.Array, pieces: dict[int, Piece]) -> pa.RecordBatch:
        """leaf, rep, open: where the pieces send vectors."""
        unit = unit_rows(embeddings, self.size)
        rows, leaves, still = [], [], []
        for code, piece in pieces.items():
            row, node, more = piece.leaves(self.shadows(unit, code)[0])
            rows.append(row)
            leaves.append(below(code, node))
            still.append(more)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(leaves)), reps.take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(still))], names=["leaf", "rep", "open"])


_PLACED = "leaf long, rep long, open boolean"


def grown(classes: DataFrame, rows: int, size: int, cosine: float, trees: int, leaf: int, spill: float, sample_rows: int) -> DataFrame:
    """Rows leaf, rep: one for each leaf that each of the ``rows`` classes (rep, embedding of ``size``) falls in."""
    spark, grower = classes.sparkSession, Grower(size, cosine, trees, leaf, spill)
    if rows <= leaf:
        return classes.select(F.lit(trees).cast("long").alias("leaf"), "rep")
    digest = F.pmod(F.xxhash64("rep", F.lit(SEED)), F.lit(1 << 30))

    def fitted(live: DataFrame) -> DataFrame:
        """open, low, high of each leaf of ``live`` (leaf, n, rep, embedding), from at most about ``sample_rows`` of its rows."""
        drawn = live.where(digest * F.col("n") < F.lit(float(sample_rows) * (1 << 30)))
        return save(drawn.select("leaf", "n", "rep", "embedding").groupBy("leaf").applyInPandas(lambda group: grower.fit(group), "open long, low array<double>, high array<double>"), "vec-pieces")

    roots = F.explode(F.array(*[F.lit(t).cast("long") for t in range(trees, 2 * trees)]))
    first = fitted(classes.select(roots.alias("leaf"), F.lit(rows).cast("long").alias("n"), "rep", "embedding")).collect()  # a tree each, of at most 2 * sample_rows / LEAST_SAMPLED nodes
    sent = spark.sparkContext.broadcast({r.open: Piece(np.array(r.low, float), np.array(r.high, float)) for r in first})

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                yield grower.placed(part.column(0), part.column(1), sent.value)

    def route_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = None  # rows of a node follow its piece
        for batch in batches:
            low = batch.column(3)
            heads = [*np.flatnonzero(low.is_valid().to_numpy(zero_copy_only=False)).tolist(), batch.num_rows]
            for at, to in zip([-1, *heads[:-1]], heads):
                if at >= 0:
                    piece = int(batch.column(0)[at].as_py()), Piece(*(np.array(batch.column(c)[at].as_py(), float) for c in (3, 4)))
                for x in range(at + 1, to, 2048):
                    part = batch.slice(x, min(2048, to - x))
                    yield grower.placed(part.column(1), part.column(2), dict([piece]))

    parts, closed = save(classes.select("rep", "embedding").mapInArrow(route, _PLACED), "vec-parts"), []
    while True:
        closed.append(parts.where("not open").select("leaf", "rep"))
        sizes = save(parts.where("open").groupBy("leaf").agg(F.count("*").alias("n")), "vec-open")
        if sizes.isEmpty():
            return reduce(DataFrame.unionByName, closed)
        open_rows = parts.where("open").select("leaf", "rep").join(sizes, "leaf").join(classes.select("rep", "embedding"), "rep")
        live = save(open_rows, "vec-live")
        salts = F.ceil(F.col("n") / SALT_ROWS)
        pieces = fitted(live).join(sizes.withColumnRenamed("leaf", "open"), "open")
        heads = pieces.select(F.col("open").alias("leaf"), F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"), F.lit(0).alias("place"), F.lit(None).cast("long").alias("rep"), F.lit(None).cast(dict(live.dtypes)["embedding"]).alias("embedding"), "low", "high")
        none = F.lit(None).cast("array<double>")
        tails = live.select("leaf", F.pmod(F.xxhash64("rep", F.lit(7)), salts).alias("salt"), F.lit(1).alias("place"), "rep", "embedding", none.alias("low"), none.alias("high"))
        lined = heads.unionByName(tails).repartition("leaf", "salt").sortWithinPartitions("leaf", "salt", "place")
        parts = save(lined.select("leaf", "rep", "embedding", "low", "high").mapInArrow(route_on, _PLACED), "vec-parts")


def linked(classes: DataFrame, rows: int, size: int, cosine: float = COSINE, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL, sample_rows: int = SAMPLE) -> DataFrame:
    """Rows a (class), n (vectors of other classes linked), b (least class of its leaf it is joined to)."""
    ship(classes.sparkSession)
    placed = grown(classes, rows, size, cosine, trees, leaf, spill, sample_rows)
    lists = placed.groupBy(F.col("rep").alias("of")).agg(F.array_sort(F.collect_list("leaf")).alias("leaves"))  # a few a tree
    spilled = classes.join(lists, F.col("rep") == F.col("of")).select("rep", "copies", "embedding", "leaves", F.explode("leaves").alias("leaf"))
    units = block_units(spilled, "leaf", "rep", BLOCK, "vec", placed)
    keys = ["leaf", "unit_i", "unit_j"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in stream_groups(batches, keys):
            reps, copies = table.column("rep").to_numpy(), table.column("copies").to_numpy()
            unit, block = unit_rows(table.column("embedding").combine_chunks(), size), table.column("block").to_numpy()
            here, i, j = (table.column(k)[0].as_py() for k in keys)
            near = unit @ unit.T >= cosine
            np.fill_diagonal(near, False)
            if i != j:  # pairs within a block belong to the unit of that block
                near &= block[:, None] != block[None, :]
            x, y = np.nonzero(near)
            if not len(x):
                continue
            held = table.column("leaves").combine_chunks()
            off, flat = held.offsets.to_numpy(), held.values.to_numpy()
            # A pair counts where it meets first: none of the leaves before this one is common.
            some, at = np.unique(x, return_inverse=True)
            earlier = [(m := flat[off[r] : off[r + 1]])[m < here] for r in some]
            names, column = np.unique(np.concatenate(earlier), return_inverse=True)
            grid = np.zeros((len(some), len(names)), np.float32)
            grid[np.repeat(np.arange(len(some)), [len(e) for e in earlier]), column] = 1
            met = grid @ grid.T > 0
            first = ~met[at, np.searchsorted(some, y)]
            counts = np.bincount(x[first], weights=copies[y[first]], minlength=len(reps)).astype(np.int64)
            label = local_labels(near)
            told = near.any(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(reps[told]), pa.array(counts[told]), pa.array(reps[label][told])], names=["a", "n", "b"])

    ready = units.select(*keys, "block", "rep", "copies", "leaves", "embedding")
    out = save(ready.repartition(*keys).sortWithinPartitions(*keys, "rep").mapInArrow(compare, "a long, n long, b long"), "vec-links")
    if rows > leaf:
        drop(placed)
    return out


def vector_components(table: DataFrame, cosine: float = COSINE, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL, sample_rows: int = SAMPLE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``table`` (vec_id, embedding). ``trees`` is a power of two."""
    rows = save(keyed(table), "vec-rows")
    good = rows.where("digest is not null")
    classes = save(good.groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")).withColumn("cid", F.monotonically_increasing_id()), "vec-classes")
    # Rows that repeat a vec_id with different vectors are classes of their own.
    reps = good.join(classes.select("cid", F.col("rep").alias("first"), "copies", F.col("digest").alias("same")), (F.col("vec_id") == F.col("first")) & (F.col("digest") == F.col("same")))
    full = save(reps.select(F.col("cid").alias("rep"), "copies", "embedding").dropDuplicates(["rep"]), "vec-reps")
    lengths = full.groupBy(F.size("embedding").alias("size")).count().where("count > 1").orderBy("size").collect()  # the lengths that embeddings have
    none = full.select(F.col("rep").alias("a"), F.col("copies").alias("n"), F.col("rep").alias("b")).limit(0)
    found = reduce(DataFrame.unionByName, [linked(full.where(F.size("embedding") == r["size"]), r["count"], r["size"], cosine, trees, leaf, spill, sample_rows) for r in lengths], none)
    counts = found.groupBy("a").agg(F.sum("n").alias("links"))
    roots = components(found.select("a", "b"), "vec")
    named = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()).join(classes.select(F.col("cid").alias("node"), "rep"), "node")
    heads = named.groupBy("root").agg(F.min("rep").alias("head"))
    told = (
        classes.join(counts, F.col("cid") == F.col("a"), "left")
        .join(named.join(heads, "root").select("node", "head"), F.col("cid") == F.col("node"), "left")
        .where("links is not null or head is not null or copies > 1")
        .select(F.col("digest").alias("same"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("head", "rep").alias("root"))
    )
    told = save(told, "vec-told")
    drop(full, classes, roots)
    out = rows.select("vec_id", "digest").join(told, F.col("digest") == F.col("same"), "left")
    return out.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "vec_id").alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op10_vector_dedup(spark, sf_dir: str) -> DataFrame:
    return vector_components(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
