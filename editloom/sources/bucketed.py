"""Condition tables in buckets by site, so that joins and sums of a site's rows need no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Joins on the bucket column and more (cell, haplotype) use the buckets only where a part of the keys may place the rows.
CO_LOCATED = {
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.sources.bucketing.autoBucketedScan.enabled": "true",
}


def store_bucketed(df: DataFrame, table: str, path: str, buckets: int, by: str = "site", sort: tuple[str, ...] = ("site",)) -> None:
    """A new table at ``path`` with a folder a condition and in it ``buckets`` files by the hash of ``by``, each sorted by ``sort``. Rows are
    first dealt to their buckets, a task a bucket, so that there is one file a condition and bucket. Rows without a site share a
    bucket; a hot site stays in one, as every join on it would have it. A table of the name is an error."""
    df.repartition(buckets, by).write.partitionBy("condition").bucketBy(buckets, by).sortBy(*sort).option("path", path).saveAsTable(table)


def replace_slices(df: DataFrame, table: str, buckets: int, by: str = "site") -> None:
    """The conditions of ``df`` written anew into their folders and buckets; other conditions stay as they are."""
    spark = df.sparkSession
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        df.select(*spark.table(table).columns).repartition(buckets, by).write.insertInto(table, overwrite=True)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)


def co_located(spark: SparkSession) -> SparkSession:
    """A session beside this one, over the same tables, whose joins on ``site`` and more columns use the buckets."""
    beside = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone", "spark.sql.ansi.enabled", "spark.sql.adaptive.enabled", "spark.checkpoint.dir"):
        value = spark.conf.get(name, None)
        if value is not None and beside.conf.isModifiable(name):
            beside.conf.set(name, value)
    for name, value in CO_LOCATED.items():
        beside.conf.set(name, value)
    return beside
