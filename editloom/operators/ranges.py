"""Order within groups by ranges: running totals, places, order statistics and tied ranks without one sorted window a group.

Rows are dealt by ranges of (group, order), so a group may be spread over any number of tasks. Each range is sorted by itself and
begins after what earlier ranges hold of the group, which is a table of a row a range and group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from editloom.sources.shared import new_folder, written


def running_before(df: DataFrame, by: list[str], order: list[str], amounts: dict[str, Column]) -> DataFrame:
    """``df`` with, for each name of ``amounts``, the sum of that amount over the group's rows before this one, and as ``<name>_all`` over
    all of them. Group columns hold no nulls; ties in ``order`` fall in any order, which is then kept."""
    held = {n: f"__{n}" for n in amounts}
    ranged = df.withColumns({held[n]: a for n, a in amounts.items()}).repartitionByRange(*by, *order).withColumn("__range", F.spark_partition_id())
    rows = written(ranged, new_folder(df.sparkSession, "ranged"))
    sizes = rows.groupBy(*by, "__range").agg(*[F.sum(c).alias(c) for c in held.values()])  # a row a range and group
    earlier, whole = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*by)
    none = lambda c: F.coalesce(c, F.lit(0))
    base = sizes.select(*by, "__range", *[none(F.sum(c).over(earlier)).alias(f"{c}_base") for c in held.values()], *[F.sum(c).over(whole).alias(f"{n}_all") for n, c in held.items()])
    inside = Window.partitionBy(*by, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # Rows lie by group and range already, so the bases come to them; a broadcast might take the rows, which are small as stored.
    rows = rows.withColumns({f"{c}_inside": none(F.sum(c).over(inside)) for c in held.values()}).join(base.hint("merge"), [*by, "__range"])
    rows = rows.withColumns({n: F.col(f"{c}_base") + F.col(f"{c}_inside") for n, c in held.items()})
    return rows.drop("__range", *[f"{c}{end}" for c in held.values() for end in ("", "_base", "_inside")])


def placed(df: DataFrame, by: list[str], order: list[str], place: str = "place", size: str = "size") -> DataFrame:
    """``df`` with its place in the group's order, from 0, and the group's rows."""
    return running_before(df, by, order, {place: F.lit(1).cast("long")}).withColumnRenamed(f"{place}_all", size)


def value_counts(df: DataFrame, by: list[str], value: str, label: str | None = None) -> DataFrame:
    """``by``, value, n, before and before_all: rows of each value, of smaller values, and of the group; with a ``label`` of 0 and 1 also ones,
    ones_before and ones_before_all, as many of label 1. Nulls are left out."""
    sums = {"n": F.count("*")} | ({"ones": F.sum(F.col(label).cast("long"))} if label else {})
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(*[c.alias(n) for n, c in sums.items()])
    return running_before(counts, by, [value], {"before": F.col("n")} | ({"ones_before": F.col("ones")} if label else {}))


def order_statistics(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """``by`` and a column a share: the value at that share of the group's order, between two values as far as it falls.
    Nulls are left out. Values are counted first, so that equal ones are one row."""
    counts = value_counts(df, by, value)
    last = (F.col("before_all") - 1).cast("double")
    aims = F.array(*[F.struct(F.lit(n).alias("name"), (F.lit(q) * last).alias("at")) for n, q in shares.items()])
    rows = counts.withColumn("aim", F.explode(aims))
    part = F.col("aim.at") - F.floor("aim.at")
    ends = F.array(*[F.struct((F.floor("aim.at") + i).cast("long").alias("place"), weight.alias("weight")) for i, weight in ((0, 1 - part), (1, part))])
    held = rows.withColumn("end", F.explode(ends)).where("end.weight > 0 and end.place >= before and end.place < before + n")
    return held.groupBy(*by).agg(*[F.sum(F.when(F.col("aim.name") == n, F.col(value) * F.col("end.weight"))).alias(n) for n in shares])


def with_average_rank(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """``df`` with the rank from 1 of ``value`` in its group, ties sharing their mean; null where the value is."""
    told = value_counts(df, by, value).select(*by, value, (F.col("before") + (F.col("n") + 1) / 2.0).alias(name))
    return df.join(told, [*by, value], "left")
