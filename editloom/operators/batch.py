"""Batch effects: means, culprits, pools, islands, and adjustments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from editloom.functions import tails
from editloom.operators.stats import MUTATION, anova_test, fdr_global
from editloom.sources.shared import new_folder, written

SIGNATURE = ["category", "indel_start", "indel_end", "indel_length", "mh_length", "inserted_bases"]


def batch_means(activity: DataFrame, value: str = "mean_activity") -> DataFrame:
    """Per mutation the batches' means: their mean, median, range, and medians within editor kinds."""
    means = activity.groupBy(*MUTATION, "batch").agg(F.avg(value).alias("m"))
    kinds = activity.groupBy(*MUTATION, "kind", "batch").agg(F.avg(value).alias("m")).groupBy(*MUTATION).agg(
        F.percentile(F.when(F.col("kind") == "CBE", F.col("m")), 0.5).alias("cbe_median"), F.percentile(F.when(F.col("kind") == "ABE", F.col("m")), 0.5).alias("abe_median")
    )
    whole = means.groupBy(*MUTATION).agg(F.avg("m").alias("mean_means"), F.percentile("m", 0.5).alias("median_means"), (F.max("m") - F.min("m")).alias("spread"))
    return whole.join(kinds, MUTATION)


def culprits(activity: DataFrame, accepted: DataFrame | None = None, spread: float = 0.002, background: float = 0.0005, least: float = 0.002) -> DataFrame:
    """Batches in which a batch-dependent mutation is frequent though both editor kinds' medians are low.
    A kind without editors does not veto."""
    rows = activity if accepted is None else activity.join(accepted.select(*MUTATION), MUTATION, "left_semi")
    odd = batch_means(rows).where(
        (F.col("spread") >= spread) & (F.coalesce("cbe_median", F.lit(0.0)) <= background) & (F.coalesce("abe_median", F.lit(0.0)) <= background)
    )
    means = rows.groupBy(*MUTATION, "batch").agg(F.avg("mean_activity").alias("batch_mean"))
    return means.join(odd.select(*MUTATION), MUTATION, "left_semi").where(F.col("batch_mean") >= least)


def pool_fraction(mutations: DataFrame, group: str, members: DataFrame) -> DataFrame:
    """In how many of a group's conditions each mutation occurs, and their share."""
    sizes = members.groupBy(group).agg(F.count_distinct("condition").alias("conditions"))
    pooled = mutations.join(F.broadcast(members.select("condition", group)), "condition").groupBy(group, *MUTATION).agg(F.count_distinct("condition").alias("pool_count"))
    return pooled.join(F.broadcast(sizes), group).withColumn("pool_fraction", F.col("pool_count") / F.col("conditions"))


def drop_islands(pool: DataFrame, group: str, seeds: list[tuple[str, int, str]] = (("A", 6, "G"), ("C", 6, "T"), ("C", 6, "G")), least: float = 0.25) -> DataFrame:
    """Mutations connected to a seed through neighbouring positions are on-target and go; what is left are
    other islands. Gaps and islands: position minus row number is constant along a run."""
    rows = pool.where(F.col("pool_fraction") >= least)
    run = Window.partitionBy(group, "ref_nt", "obs_nt").orderBy("position")
    rows = rows.withColumn("__island", F.col("position") - F.row_number().over(run))
    seeded = F.lit(False)
    for ref, position, obs in seeds:
        seeded = seeded | ((F.col("ref_nt") == ref) & (F.col("obs_nt") == obs) & (F.col("position") == position))
    hit = F.max(seeded).over(Window.partitionBy(group, "ref_nt", "obs_nt", "__island"))
    return rows.withColumn("__hit", hit).where(~F.col("__hit")).drop("__island", "__hit")


def indel_anova(indels: DataFrame, conditions: DataFrame) -> DataFrame:
    """ANOVA of each indel's frequency across batches, where a condition that carries any indel at the site but not this one counts
    as 0, and one that carries none is no observation. Zeros are not written out: batches without the indel add nothing to
    the sums, and the counts of batches and conditions are the site's. ``batches`` has the means of those with it.

    Everything is by site, so that one shuffle by site serves all steps."""
    by_site, rows = Window.partitionBy("site"), indels.repartition("site")
    share = F.col("count") / F.sum("count").over(Window.partitionBy("condition", "site"))
    rows = rows.withColumn("frequency", share).where("category <> 'wildtype'").join(F.broadcast(conditions.select("condition", "batch")), "condition")
    some = lambda c, *by: F.size(F.collect_set(c).over(Window.partitionBy("site", *by))).cast("long")  # noqa: E731  the design's conditions and batches
    rows = rows.withColumns({"n": some("condition", "batch"), "k": some("batch"), "whole": F.size(F.collect_set("condition").over(by_site)).cast("long")})
    keys = ["site", *SIGNATURE]
    held = rows.groupBy(*keys, "batch", "n", "k", "whole").agg(F.count("*").alias("held"), F.avg("frequency").alias("mean"), F.var_pop("frequency").alias("var"), F.max("frequency").alias("top"))
    m = F.col("mean") * F.col("held") / F.col("n")
    ss = F.col("var") * F.col("held") + F.col("held") * F.pow(F.col("mean") - m, 2) + (F.col("n") - F.col("held")) * F.pow(m, 2)
    sums = held.withColumns({"m": m, "ss": ss}).groupBy(*keys, "k", "whole").agg(
        F.sum("ss").alias("within"), F.sum(F.col("n") * F.col("m")).alias("one"), F.sum(F.col("n") * F.pow("m", 2)).alias("two"), F.sum("m").alias("means"),
        F.max(F.col("ss") > 0).alias("varies"), F.max((F.col("n") == 1) & (F.col("top") > 0)).alias("lone"), F.collect_list(F.struct("batch", "m")).alias("batches"),
    )
    sound = sums.where("k >= 2 and (varies or not lone)")
    told = anova_test(sound, F.col("k"), F.col("whole"), F.col("within"), F.col("two") - F.pow("one", 2) / F.col("whole"), tails.f_sf)
    return told.select(*keys, "f_stat", "df_between", "df_within", "p_value", (F.col("means") / F.col("k")).alias("mean_means"), "batches").where("f_stat is not null")


def indel_batch_effects(indels: DataFrame, conditions: DataFrame, alpha: float = 0.01, least: float = 0.005) -> tuple[DataFrame, DataFrame]:
    """(tests, culprits): ``indel_anova`` with the indels accepted over all sites, and the batches in which those are frequent.
    p values that agree to 1e-9 of themselves are ties, and so are means that agree to 1e-12, as sums in another order differ by rounding.
    The tests are stored, so that dealing them by ranges does not take them twice."""
    keys = ["site", *SIGNATURE]
    tests = written(indel_anova(indels, conditions), new_folder(indels.sparkSession, "indels"))
    tied = F.exp(F.floor(F.ln(F.greatest("p_value", F.lit(1e-300))) * 1e9 + 0.5) / 1e9)
    tests = fdr_global(tests.withColumn("__p", tied), "__p", keys, alpha).drop("__p")
    found = tests.where("accept").select(*keys, "mean_means", F.explode("batches").alias("b")).select(*keys, "b.batch", F.col("b.m").alias("batch_mean"), "mean_means")
    return tests.drop("batches"), found.where((F.col("batch_mean") >= F.col("mean_means") - 1e-12) | (F.col("batch_mean") >= least - 1e-12)).drop("mean_means")


def adjust_ratio(ratios: DataFrame, coefficients: DataFrame, key: str, value: str) -> DataFrame:
    """Ratio * exp(mean - b), the log taken only where positive."""
    mean = coefficients.agg(F.avg("coefficient").alias("__mean"))
    rows = ratios.join(F.broadcast(coefficients.select(key, "coefficient")), key).join(F.broadcast(mean))
    return rows.withColumn("adjusted", F.when(F.col(value) > 0, F.exp(F.ln(value) + F.col("__mean") - F.col("coefficient")))).drop("__mean", "coefficient")


def adjust_indels(indels: DataFrame, coefficients: DataFrame, key: str, value: str = "count") -> DataFrame:
    """T16, opposite sign: counts of indels * exp(b - mean); other rows stay."""
    mean = coefficients.agg(F.avg("coefficient").alias("__mean"))
    rows = indels.join(F.broadcast(coefficients.select(key, "coefficient")), key).join(F.broadcast(mean))
    moved = F.when(F.col("category") == "wildtype", F.col(value)).otherwise(F.when(F.col(value) > 0, F.exp(F.ln(value) + F.col("coefficient") - F.col("__mean"))).otherwise(0.0))
    return rows.withColumn("adjusted", moved).drop("__mean", "coefficient")
