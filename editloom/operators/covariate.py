"""The covariate model of mean activity, a_condition**2 * e_editor,mutation**2 + b_batch,mutation**2 + g**2, fitted by full-batch
Adam on squared error from several starts, with snapshots.

Rows of one cell (condition, editor, batch and mutation) share all four parameters, so their count and mean give the whole gradient:
the data is first summed by cell. Parameters and their moments are one table of (seed, kind, key), written to the run's
folder as a snapshot. Up to ``FIT_CELLS`` cells a job takes ``every`` steps, each seed's in a task of its own. Beyond, a job is one
step: the cells are joined with each kind's parameters and the slopes are summed by key with map-side combining. Both take
the same steps. A run that finds cells and snapshots in its folder goes on from the last whole one, and a lost executor costs one
job. The step size shrinks by 0.9995 a step, down to 0.001.
"""

from __future__ import annotations

import re

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from editloom.functions.special import hash_int
from editloom.operators import trees
from editloom.sources.shared import new_folder, removed

KINDS = ("a", "e", "b", "g")
#: Beyond this many cells a step is a Spark job, not a pass in one worker a seed.
FIT_CELLS = 1_000_000
_STATE = "seed int, kind string, key string, p double, m double, v double"
cloudpickle.register_pickle_by_value(trees)


def step_sizes(steps: int, size: float) -> list[float]:
    sizes = []
    for _ in range(steps):
        size = size * 0.9995 if size > 0.001 else size
        sizes.append(size)
    return sizes


def last_step(spark: SparkSession, folder: str) -> int | None:
    """The number of the last snapshot that was written whole."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/step-*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    numbers = [int(re.search(r"step-(\d+)/_SUCCESS$", f.getPath().toString())[1]) for f in found or []]
    return max(numbers, default=None)


def _kept(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cell_sums(y: DataFrame) -> DataFrame:
    """key_a, key_e, key_b, key_g, n, value and ss: each cell's rows, mean and sum of squared deviations."""
    keys = {"a": F.col("condition"), "e": F.concat_ws("|", "editor", "mutation"), "b": F.concat_ws("|", "batch", "mutation"), "g": F.lit("all")}
    data = y.where(F.col("value").isNotNull()).select("value", *[k.alias(f"key_{n}") for n, k in keys.items()])
    return data.groupBy(*[f"key_{n}" for n in KINDS]).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), (F.var_pop("value") * F.count("*")).alias("ss")).withColumnRenamed("mean", "value")


def starts(cells: DataFrame, seeds: int) -> DataFrame:
    """Every parameter's start in [0, 1), by hash, for each seed."""
    parts = [cells.select(F.lit(n).alias("kind"), F.col(f"key_{n}").alias("key")).distinct() for n in KINDS]
    keys = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    rows = keys.select(F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))).alias("seed"), "kind", "key")
    name = F.when(F.col("seed") == 0, F.concat_ws("|", "kind", "key")).otherwise(F.concat_ws("|", "seed", "kind", "key"))
    return rows.select("seed", "kind", "key", (hash_int(name) / F.lit(2.0**32)).alias("p"), F.lit(0.0).alias("m"), F.lit(0.0).alias("v"))


def _many_steps(state: DataFrame, cells: DataFrame, seeds: int, before: int, sizes: list[float]) -> DataFrame:
    """The steps of ``sizes``, of each seed in a task of its own."""
    import pandas as pd

    rows, kinds = cells.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1)))), list(KINDS)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return trees.cell_steps(left, right, kinds, before, sizes)

    return rows.groupBy("seed").cogroup(state.groupBy("seed")).applyInPandas(run, _STATE)


def joined(state: DataFrame, cells: DataFrame) -> DataFrame:
    """The cells of each seed beside their parameters a, e, b, g."""
    full = cells
    for i, n in enumerate(KINDS):
        told = state.where(F.col("kind") == n).select("seed", F.col("key").alias(f"key_{n}"), F.col("p").alias(n))
        full = full.join(told, f"key_{n}" if i == 0 else ["seed", f"key_{n}"])
    return full


def _one_step(state: DataFrame, cells: DataFrame, total: int, step: int, size: float) -> DataFrame:
    full = joined(state, cells)
    error = 2.0 * F.col("n") * (F.pow("a", 2) * F.pow("e", 2) + F.pow("b", 2) + F.pow("g", 2) - F.col("value")) / total
    slopes = {"a": 2 * F.col("a") * F.pow("e", 2), "e": 2 * F.col("e") * F.pow("a", 2), "b": 2 * F.col("b"), "g": 2 * F.col("g")}
    each = F.array(*[F.struct(F.lit(n).alias("kind"), F.col(f"key_{n}").alias("key"), (error * s).alias("g")) for n, s in slopes.items()])
    slope = full.select("seed", F.explode(each).alias("s")).groupBy("seed", F.col("s.kind").alias("kind"), F.col("s.key").alias("key")).agg(F.sum("s.g").alias("slope"))
    moved = state.join(slope, ["seed", "kind", "key"]).select("seed", "kind", "key", "p", (0.9 * F.col("m") + 0.1 * F.col("slope")).alias("m"), (0.999 * F.col("v") + 0.001 * F.pow("slope", 2)).alias("v"))
    return moved.withColumn("p", F.col("p") - size * F.col("m") / (1 - 0.9**step) / (F.sqrt(F.col("v") / (1 - 0.999**step)) + 1e-8))


def covariate_fits(y: DataFrame, seeds: int = 10, steps: int = 1200, step_size: float = 0.1, folder: str | None = None, fit_cells: int = FIT_CELLS, every: int = 300) -> tuple[DataFrame, DataFrame]:
    """(state, cells): seed, kind, key, p of every start after ``steps``, and the cells they were fitted on. ``y``: condition, editor, batch,
    mutation, value. ``folder``: that of a run to go on with, on the same data and step sizes."""
    spark = y.sparkSession
    folder = folder or new_folder(spark, "covariate")
    done = last_step(spark, folder)
    if done is None:
        cells = _kept(cell_sums(y), f"{folder}/cells")
        state, done = _kept(starts(cells, seeds), f"{folder}/step-0"), 0
    else:
        cells, state = spark.read.parquet(f"{folder}/cells"), spark.read.schema(_STATE).parquet(f"{folder}/step-{done}")
    count, total = cells.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    sizes = step_sizes(steps, step_size)
    while done < steps and count:
        then = min(done + every, steps) if count <= fit_cells else done + 1
        moved = _many_steps(state, cells, seeds, done, sizes[done:then]) if count <= fit_cells else _one_step(state, cells, total, then, sizes[done])
        state = _kept(moved, f"{folder}/step-{then}")
        removed(spark, f"{folder}/step-{done}")
        done = then
    return state, cells


def covariate_model(y: DataFrame, steps: int = 1200, step_size: float = 0.1, folder: str | None = None, fit_cells: int = FIT_CELLS, every: int = 300) -> DataFrame:
    """kind, key, value of the first start."""
    state, _ = covariate_fits(y, 1, steps, step_size, folder, fit_cells, every)
    return state.select("kind", "key", F.col("p").alias("value"))


def losses(state: DataFrame, cells: DataFrame) -> DataFrame:
    """seed, loss, rows: the mean squared error of every start over all rows."""
    error = F.pow("a", 2) * F.pow("e", 2) + F.pow("b", 2) + F.pow("g", 2) - F.col("value")
    return joined(state, cells).groupBy("seed").agg((F.sum(F.col("n") * F.pow(error, F.lit(2)) + F.col("ss")) / F.sum("n")).alias("loss"), F.sum("n").alias("rows"))
