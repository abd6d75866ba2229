"""Queries over tables that are first stored: ordered, in buckets, and as side tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editloom.operators import counts, haplotypes, stats
from editloom.plans import haplotypes as hq
from editloom.plans import positions as pq
from editloom.plans.registry import query, rounded
from editloom.sources import bucketed, ordered
from editloom.sources import dimensions as dim
from editloom.sources.fixtures import Source, oracle
from editloom.sources.shared import new_folder


@query("w4_haplotypes", oracle("SELECT condition, site, hap, count, row_number() OVER (ORDER BY condition, site, count DESC, hap) AS place FROM t", "v_g5_long", ctes=hq.LONG))
def w4_haplotypes(s: Source) -> DataFrame:
    """Haplotypes of each condition and site by falling count, stored so and read back with their places."""
    path = new_folder(s.spark, "ordered") + "/haplotypes"
    haps = hq.told(haplotypes.regroup(hq.reads(s)))
    ordered.store_ordered(haps, path, [F.col("condition"), F.col("site"), F.desc("count"), F.col("hap")])
    return ordered.read_ordered(s.spark, path)


@query("w4_decisions", oracle("""
SELECT condition, site, idx, obs_nt, round(c_fq, 6) AS c_fq, row_number() OVER (ORDER BY c_fq DESC, condition, site, idx, obs_nt) AS place FROM (
  SELECT condition, site, idx, obs_nt, c_count / c_total AS c_fq FROM paired WHERE obs_nt <> ref_nt AND t_count > 0 AND c_total > 0 AND c_count / c_total >= 0.05) x""", "v_g4", ctes=pq.PAIRED))
def w4_decisions(s: Source) -> DataFrame:
    """Mutations as frequent in control as to be wiped, by falling frequency."""
    path = new_folder(s.spark, "ordered") + "/decisions"
    found = counts.paired(*pq.sides(s)).where("obs_nt <> ref_nt and t_count > 0").withColumn("c_fq", F.try_divide("c_count", "c_total")).where("c_fq >= 0.05")
    ordered.store_ordered(found.select("condition", "site", "idx", "obs_nt", "c_fq"), path, [F.desc("c_fq"), F.col("condition"), F.col("site"), F.col("idx"), F.col("obs_nt")])
    return rounded(ordered.read_ordered(s.spark, path))


@query("s4_quality", oracle(f"""
, least_q AS (SELECT role, condition, site, idx, min(quality) AS q FROM v_quality GROUP BY ALL),
rows AS (SELECT t.condition, t.site, t.idx, t.obs_nt, count, CAST(floor(count) AS BIGINT) AS k, CAST(floor(sum(count) OVER (PARTITION BY t.condition, t.site, t.idx)) AS BIGINT) AS n, ref_nt,
  pow(10.0, -coalesce(a.q, 30) / 10.0) AS tp, pow(10.0, -coalesce(b.q, 30) / 10.0) AS cp FROM t
  LEFT JOIN least_q a ON a.role = 'T' AND a.condition = t.condition AND a.site = t.site AND a.idx = t.idx AND t.condition < 'c6'
  LEFT JOIN least_q b ON b.role = 'C' AND b.condition = t.condition AND b.site = t.site AND b.idx = t.idx AND t.condition < 'c6'),
terms AS (SELECT *, list_transform(range(0, least(n, 24) + 1), lambda i: {pq.PMF.format(n="n", j="i", p="cp")} *
  coalesce(list_sum(list_transform(range(i + k, least(n, i + k + 60) + 1), lambda j: {pq.PMF.format(n="n", j="j", p="tp")})), 0.0)) AS ts FROM rows WHERE obs_nt <> ref_nt AND count > 0)
SELECT condition, site, idx, obs_nt, count, round(list_sum(ts[1:coalesce(list_position(list_transform(ts, lambda x: x <= 1e-6), true), len(ts))]), 5) AS p_value FROM terms""", "v_g4", "v_quality", ctes=pq.SIDES).replace("\n\n, least_q", ",\nleast_q"))
def s4_quality(s: Source) -> DataFrame:
    """Errors at the least qualities of each side, from side tables stored by condition. Two conditions have none, as names above L1
    have none, and are tested at the default."""
    folder = new_folder(s.spark, "quality")
    for role, name in (("T", "treated"), ("C", "control")):
        dim.store(dim.least_qualities(s.v_quality.where(F.col("role") == role)), f"{folder}/{name}")
    levels = s.v_cond.select(F.col("condition").alias("name"), F.when(F.col("condition") < "c6", "L1").otherwise("L2").alias("level"))
    quality = dim.load_qualities(s.spark, f"{folder}/treated", f"{folder}/control", levels)
    return rounded(stats.sequencing_error(pq.sides(s)[0], quality).select("condition", "site", "idx", "obs_nt", "count", "p_value"), 5)


BUCKETS = 16


def stored_sides(s: Source) -> tuple[DataFrame, DataFrame]:
    """Both sides of the counts in site buckets; one treated condition is stored at first with wrong counts and then replaced."""
    folder, mark = new_folder(s.spark, "buckets"), uuid.uuid4().hex
    names = [f"g4_{side}_{mark}" for side in ("t", "c")]
    for df, name in zip(pq.sides(s), names):
        wrong = df.withColumn("count", F.when(F.col("condition") == "c3", -1.0).otherwise(F.col("count"))) if name == names[0] else df
        bucketed.store_bucketed(wrong, name, f"{folder}/{name}", BUCKETS, sort=("site", "idx"))
    bucketed.replace_slices(pq.sides(s)[0].where("condition = 'c3'"), names[0], BUCKETS)
    beside = bucketed.co_located(s.spark)
    return beside.table(names[0]), beside.table(names[1])


@query("s8_buckets", oracle("""
SELECT condition, site, idx, position, ref_nt, obs_nt, round(CASE WHEN obs_nt = ref_nt THEN t_count ELSE greatest(0.0, t_count - coalesce(c_count / nullif(c_total, 0), 0) * t_total) END, 6) AS count FROM paired""", "v_g4", ctes=pq.PAIRED))
def s8_buckets(s: Source) -> DataFrame:
    """J6 over stored tables: control taken off without a shuffle of counts, after one condition was written anew."""
    return rounded(counts.subtract(*stored_sides(s)))
