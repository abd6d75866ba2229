"""Design tables, condition hierarchy, and reading and writing condition-partitioned datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_design(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A design table from CSV with a header and a given schema."""
    return spark.read.csv(path, header=True, schema=schema)


def read_libraries(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Library designs stacked with ``library``; the sequence column is the one named like ``Sequence context (..)``."""
    out = None
    for library, path in paths.items():
        df = spark.read.csv(path, header=True)
        found = [c for c in df.columns if c.startswith("Sequence context (")]
        if len(found) != 1:
            raise ValueError(f"{library}: {len(found)} sequence columns")
        df = df.withColumnRenamed(found[0], "seq").withColumn("library", F.lit(library))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def load(spark: SparkSession, path: str, conditions: list[str] | None = None) -> DataFrame:
    """A dataset, pruned to the partitions of the wanted conditions that are there."""
    df = spark.read.parquet(path)
    return df if conditions is None else df.where(F.col("condition").isin(*conditions))


def store(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Written by condition; overwriting replaces only the partitions written."""
    df.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("condition").parquet(path)


def least_qualities(calls: DataFrame) -> DataFrame:
    """The least Phred score of each condition, site and index; calls without a score don't count."""
    return calls.where("quality is not null").groupBy("condition", "site", "idx").agg(F.min("quality").alias("quality"))


def load_qualities(spark: SparkSession, treated: str, control: str, dim: DataFrame) -> DataFrame:
    """Condition, site, idx, t_quality, c_quality from the stored side tables of both sides. Only conditions of level L1 have
    such tables: rows under a name of another level are left out. A place that one side lacks is null there."""
    l1 = F.broadcast(dim.where("level = 'L1'").select(F.col("name").alias("condition")).distinct())
    sides = [load(spark, path).select("condition", "site", "idx", F.col("quality").alias(name)) for path, name in ((treated, "t_quality"), (control, "c_quality"))]
    return sides[0].join(sides[1], ["condition", "site", "idx"], "full").join(l1, "condition", "left_semi")


def publish(df: DataFrame, design: DataFrame, **wanted) -> DataFrame:
    """Rows of conditions with the wanted attributes (editor=, celltype=, library=)."""
    keep = design
    for column, value in wanted.items():
        keep = keep.where(F.col(column) == value)
    return df.join(F.broadcast(keep.select("condition").distinct()), "condition", "left_semi")


def levels(l1: DataFrame, l2: DataFrame, endo: DataFrame) -> DataFrame:
    """M1: name, level, l1_name: a replicate group stands for its first item."""
    one = l1.select(F.col("name"), F.lit("L1").alias("level"), F.col("name").alias("l1_name"))
    two = l2.select("name", F.lit("L2").alias("level"), F.col("members")[0].alias("l1_name"))
    three = endo.select("name", F.lit("endo").alias("level"), F.col("name").alias("l1_name"))
    return one.unionByName(two).unionByName(three)


def resolve(names: DataFrame, dim: DataFrame) -> DataFrame:
    """M1: names with their level; an unknown name fails the query."""
    rows = names.join(F.broadcast(dim), "name", "left")
    return rows.withColumn("level", F.coalesce("level", F.raise_error(F.concat(F.lit("unknown condition "), F.col("name"))).cast("string")))


def library_of(name: Column, design_library: Column, known: list[str]) -> Column:
    """M2: the design's library, else a known one that the name contains."""
    out = design_library
    for lib in known:
        out = F.coalesce(out, F.when(F.contains(name, F.lit(lib)), F.lit(lib)))
    return out


def editor_kind(editor: Column, cbe: tuple[str, ...] = ("BE4", "BE4-CP", "AID", "CDA", "eA3A", "evoAPOBEC", "BE4-H47ES48A"), abe: tuple[str, ...] = ("ABE", "ABE-CP")) -> Column:
    """M3."""
    return F.when(editor.isin(*cbe), "CBE").when(editor.isin(*abe), "ABE").otherwise("other")


def on_target(sites: DataFrame, off: tuple[str, ...] = ("mismatch", "guideseq", "chipseq", "vivo")) -> DataFrame:
    """M4: sites that are no off-target design."""
    return sites.where(~F.col("category").isin(*off))


def public_subset(design: DataFrame, libraries: list[str], celltypes: list[str], editors: list[str]) -> DataFrame:
    """M6: conditions of three lists with a composed name."""
    rows = design.where(F.col("library").isin(*libraries) & F.col("celltype").isin(*celltypes) & F.col("editor").isin(*editors))
    return rows.withColumn("public_name", F.concat_ws("_", "celltype", "library", "editor"))


def position(idx: Column, zero: Column) -> Column:
    """M7."""
    return idx - zero


def without_nuclease(df: DataFrame, name: str = "condition") -> DataFrame:
    """M9: conditions that aren't Cas9 treatments."""
    return df.where(~F.contains(F.col(name), F.lit("Cas9")))


def library_matches(endo: DataFrame, endo_to_library: DataFrame, libraries: list[str], conditions: DataFrame) -> DataFrame:
    """M8: endogenous sites beside the library conditions with the same editor that contain them."""
    names = endo_to_library.unpivot("locus", libraries, "library", "site_name").where("site_name is not null and site_name <> ''")
    rows = endo.join(F.broadcast(names), "locus")
    return rows.join(F.broadcast(conditions.select(F.col("condition"), "library", "editor")), ["library", "editor"])
