"""Tables whose files hold an order, so that a reader gets it, and each row's place in it, without a sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def store_ordered(df: DataFrame, path: str, order: list[Column], rows_per_file: int = 0) -> None:
    """Written in ``order``: ranges of it go to tasks, whose numbers the files carry, and rows are sorted within a task.

    Rows that ``order`` ties fall in any order among each other and all into one range, so it should end with columns that tell rows
    apart. Nulls come first in ascending columns and last in descending ones, as Spark sorts. ``rows_per_file`` > 0 cuts a task's rows into
    more files. An empty table is stored as one. What stood at ``path`` is replaced.
    """
    df.orderBy(*order).write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)


def read_ordered(spark: SparkSession, path: str, place: str = "place") -> DataFrame:
    """The rows of ``store_ordered`` with ``place``, from 1: rows of earlier files and the row's number in its own. No row is shuffled
    for it; the running total is taken over a row a file."""
    if place in spark.read.parquet(path).columns:
        raise ValueError(f"the table has a column {place}")
    name = F.col("_metadata.file_name")
    # Numbers, not names: part-100000 sorts before part-99999.
    file = F.struct(F.regexp_extract(name, r"^part-(\d+)", 1).cast("long").alias("task"), F.regexp_extract(name, r"-c(\d+)", 1).cast("long").alias("piece"))
    rows = spark.read.parquet(path).select("*", file.alias("__file"), F.col("_metadata.row_index").alias("__row"))
    sizes = spark.read.parquet(path).select(file.alias("__file")).groupBy("__file").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("__file", F.coalesce(before, F.lit(0)).alias("__before"))
    return rows.join(starts, "__file").withColumn(place, F.col("__before") + F.col("__row") + 1).drop("__file", "__row", "__before")
