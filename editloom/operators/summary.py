"""Summaries that join families: ratios, replicates, folds, reshaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from editloom.functions.seq import core_count
from editloom.operators.ranges import order_statistics

QUARTILES = {"median": 0.5, "p25": 0.25, "p75": 0.75}


def edit_indel_ratio(edits: DataFrame, indels: DataFrame) -> DataFrame:
    """Base-edit annotations beside indel summaries: frequency among all reads and ratio to indels."""
    a = edits.select("condition", "site", "fraction_edited", F.col("edited_count"), F.col("total_count").alias("total_be"))
    b = indels.select("condition", "site", F.col("total_count").alias("total_indel"), "indel_count", "wildtype_freq", "indel_freq")
    rows = a.join(b, ["condition", "site"]).withColumn("base_edit_freq", F.col("wildtype_freq") * F.col("fraction_edited"))
    return rows.withColumn("ratio", F.try_divide("base_edit_freq", "indel_freq"))


def qualified(ratios: DataFrame, sites: DataFrame, depth: float = 1000, substrate: str = "C", core: tuple[int, int] = (4, 7), least: float = 0.025) -> DataFrame:
    """deep sites with the substrate in the core of the guide and enough editing."""
    near = sites.where(core_count(F.col("grna"), substrate, *core) > 0).select("site")
    return ratios.join(near, "site", "left_semi").where((F.col("total_be") >= depth) & (F.col("total_indel") >= depth) & (F.col("base_edit_freq") >= least))


def ratio_summary(ratios: DataFrame, value: str, by: list[str], pseudo: float = 0.0) -> DataFrame:
    """Geometric mean and spread, median and quartiles; values that are not positive are left out."""
    x = F.col(value) + pseudo
    rows = ratios.where(x > 0).withColumn("__x", x)
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.exp(F.avg(F.ln("__x"))).alias("gmean"), F.exp(F.stddev_pop(F.ln("__x"))).alias("gstd")
    ).join(order_statistics(rows, by, "__x", QUARTILES), by)


def efficiency(ratios: DataFrame, depth: float = 100) -> DataFrame:
    """Editing efficiency of a condition over its sites."""
    x = "base_edit_freq"
    sums = ratios.groupBy("condition").agg(
        F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.sum(F.when(F.col("total_indel") >= depth, 1).otherwise(0)).alias("deep_sites"), F.sum("total_indel").alias("total_reads")
    )
    return sums.join(order_statistics(ratios, ["condition"], x, QUARTILES), "condition", "left")


def replicate_pairs(conditions: DataFrame) -> DataFrame:
    """M5: conditions that share editor, library and cell type, two of them."""
    keys = ["editor", "library", "celltype"]
    found = conditions.groupBy(*keys).agg(F.array_sort(F.collect_list("condition")).alias("names")).where("size(names) = 2")
    return found.select(*keys, F.col("names")[0].alias("rep1"), F.col("names")[1].alias("rep2"))


def replicates(df: DataFrame, pairs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Both replicates of each row, absolute difference and absolute log2 fold."""
    a = df.select(F.col("condition").alias("rep1"), *keys, F.col(value).alias("v1"))
    b = df.select(F.col("condition").alias("rep2"), *keys, F.col(value).alias("v2"))
    rows = F.broadcast(pairs.select("rep1", "rep2")).join(a, "rep1").join(b, ["rep2", *keys])
    fold = F.when((F.col("v1") > 0) & (F.col("v2") > 0), F.abs(F.log2(F.col("v1") / F.col("v2"))))
    return rows.select("rep1", "rep2", *keys, "v1", "v2", F.abs(F.col("v1") - F.col("v2")).alias("difference"), fold.alias("log2_fold"))


def fold(df: DataFrame, keys: list[str], value: str, conditions: list[str]) -> DataFrame:
    """One column a condition by a single pivot, and the row's mean over those that are there."""
    wide = df.groupBy(*keys).pivot("condition", conditions).agg(F.first(value, ignorenulls=True))
    there = F.filter(F.array(*conditions), lambda x: x.isNotNull())
    mean = F.when(F.size(there) > 0, F.aggregate(there, F.lit(0.0), lambda a, x: a + x) / F.size(there))
    return wide.withColumn("row_mean", mean)


def melt(wide: DataFrame, keys: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    """Columns to rows."""
    return wide.unpivot(keys, columns, name, value)


def weighted(df: DataFrame) -> DataFrame:
    """Each row weighs one over the rows of its condition."""
    return df.withColumn("weight", 1.0 / F.count("*").over(Window.partitionBy("condition")))


def stack_frames(*frames: DataFrame) -> DataFrame:
    """Union by name, columns that a frame lacks are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def observed_predicted(observed: DataFrame, predicted: DataFrame, depth: float = 100) -> DataFrame:
    """Rows of both on a composite id, observed deep enough."""
    key = lambda df: F.concat_ws("_", df["condition"], df["site"].cast("string"))
    a = observed.where(F.col("total_count") >= depth).select(key(observed).alias("id"), F.col("fraction_edited").alias("observed"))
    b = predicted.select(key(predicted).alias("id"), "predicted")
    return a.join(b, "id")


def recalibrated(predicted: Column, mean: Column) -> Column:
    """expit(2 * prediction + logit(mean))."""
    return 1 / (1 + F.exp(-(2 * predicted + F.ln(mean / (1 - mean)))))


def class_frequency(freq: DataFrame, classes: dict[str, list[str]]) -> DataFrame:
    """Frequencies of single substitutions summed into named classes."""
    rows = [(n, s) for n, ss in classes.items() for s in ss]
    members = freq.sparkSession.createDataFrame(rows, "class string, substitution string")
    named = freq.withColumn("substitution", F.concat_ws("_", "ref_nt", "obs_nt")).join(F.broadcast(members), "substitution")
    return named.groupBy("condition", "site", "position", "class").agg(F.sum("frequency").alias("frequency"))


def split_sizes(df: DataFrame, split: str, share: float = 0.9) -> DataFrame:
    """Rows and names by split, and the part of a training set left after validation."""
    return df.groupBy("condition", split).agg(F.count("*").alias("rows"), F.count_distinct("site").alias("sites"), F.floor(F.count("*") * share).alias("train_rows"))
