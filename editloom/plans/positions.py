"""Queries over position-wise counts: cleaning, tests, batch effects, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editloom.operators import batch, counts, stats
from editloom.plans.registry import query, rounded
from editloom.sources.dimensions import editor_kind
from editloom.sources.fixtures import Source, oracle

DEPTH = 100.0
SIDES = "t AS (SELECT * FROM v_g4 WHERE role = 'T'), c AS (SELECT * FROM v_g4 WHERE role = 'C')"
PAIRED = SIDES + """,
tt AS (SELECT *, sum(count) OVER (PARTITION BY condition, site, idx) AS t_total FROM t),
ct AS (SELECT condition, site, idx, sum(count) AS c_total FROM c GROUP BY ALL),
paired AS (SELECT tt.condition, tt.site, tt.idx, tt.position, tt.ref_nt, tt.obs_nt, tt.count AS t_count, t_total,
  coalesce(c.count, 0) AS c_count, coalesce(c_total, 0) AS c_total
  FROM tt LEFT JOIN c ON tt.condition = c.condition AND tt.site = c.site AND tt.idx = c.idx AND tt.obs_nt = c.obs_nt
  LEFT JOIN ct ON tt.condition = ct.condition AND tt.site = ct.site AND tt.idx = ct.idx)"""
TAIL = """list_sum(list_transform(range(CAST({k} AS BIGINT), CAST({n} AS BIGINT) + 1), lambda i: exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) + i * ln({p}) + ({n} - i) * ln(1 - {p}))))"""
TESTED = PAIRED + """,
tested AS (SELECT *, CASE WHEN c_count >= c_total THEN 1.0 ELSE least(1.0, """ + TAIL.format(k="t_count", n="t_total", p="(c_count / c_total)") + """) END AS p_value
  FROM paired WHERE obs_nt <> ref_nt AND t_count > 0 AND c_count > 0)"""
DENSE = SIDES + """,
cells AS (SELECT condition, site, idx, position, ref_nt, n AS obs_nt FROM (SELECT DISTINCT condition, site, idx, position, ref_nt FROM t) h, (VALUES ('A'), ('C'), ('G'), ('T')) AS x(n)),
dense AS (SELECT cells.*, coalesce(t.count, 0.0) AS count FROM cells LEFT JOIN t USING (condition, site, idx, position, ref_nt, obs_nt)),
freq AS (SELECT * FROM (SELECT *, sum(count) OVER (PARTITION BY condition, site, idx) AS total FROM dense) x WHERE total >= 100),
zero AS (SELECT condition, position, ref_nt, obs_nt, CAST(sum(CASE WHEN count = 0 THEN 1 ELSE 0 END) AS BIGINT) AS zero_sites, count(*) AS sites, avg(count / total) AS mean_activity
  FROM freq WHERE obs_nt <> ref_nt GROUP BY ALL)"""
ACTIVITY = DENSE + """,
activity AS (SELECT zero.*, editor, batch, CASE WHEN editor = 'BE4' THEN 'CBE' ELSE 'ABE' END AS kind FROM zero JOIN v_cond USING (condition))"""


def sides(s: Source) -> tuple[DataFrame, DataFrame]:
    return s.v_g4.where("role = 'T'").drop("role"), s.v_g4.where("role = 'C'").drop("role")


def dense(s: Source) -> DataFrame:
    return counts.dense_cells(sides(s)[0])


def activity(s: Source) -> DataFrame:
    rows = counts.zero_fraction(dense(s), DEPTH).join(F.broadcast(s.v_cond.select("condition", "editor", "batch")), "condition")
    return rows.withColumn("kind", editor_kind(F.col("editor")))


@query("flagship", oracle("""
SELECT condition, position, ref_nt, obs_nt, count(*) AS cells, round(avg(share), 6) AS mean_activity FROM (
  SELECT s.condition, s.position, s.ref_nt, s.obs_nt, s.left_count / s.t_total AS share FROM (
    SELECT *, greatest(0.0, t_count - c_count / c_total * t_total) AS left_count FROM tested WHERE t_total >= 20) s
  WHERE p_value <= 0.1) x GROUP BY ALL""", "v_g4", ctes=TESTED))
def flagship(s: Source) -> DataFrame:
    """Substitutions above control after subtraction, and their mean activity by position."""
    rows = stats.control_explained(*sides(s)).where("t_total >= 20 and p_value <= 0.1")
    left = F.greatest(F.lit(0.0), F.col("t_count") - F.col("c_count") / F.col("c_total") * F.col("t_total")) / F.col("t_total")
    return rounded(rows.groupBy("condition", "position", "ref_nt", "obs_nt").agg(F.count("*").alias("cells"), F.avg(left).alias("mean_activity")))


@query("j1_status", oracle("""
SELECT d.condition, d.site, CASE WHEN a.site IS NULL THEN 'No treatment' WHEN b.site IS NULL THEN 'No control' ELSE 'Adjusted' END AS status
FROM (SELECT condition, site FROM v_cond, v_site) d
LEFT JOIN (SELECT DISTINCT condition, site FROM t WHERE obs_nt <> ref_nt AND count >= 60) a ON d.condition = a.condition AND d.site = a.site
LEFT JOIN (SELECT DISTINCT condition, site FROM c WHERE obs_nt <> ref_nt AND count >= 60) b ON d.condition = b.condition AND d.site = b.site""", "v_cond", "v_g4", ctes=SIDES))
def j1_status(s: Source) -> DataFrame:
    t, c = sides(s)
    design = s.v_site.select("site").join(F.broadcast(s.v_cond.select("condition")))
    seen = lambda df: df.where("obs_nt <> ref_nt and count >= 60")
    return counts.treatment_control_status(design, seen(t), seen(c))


@query("s10_long", oracle("""
SELECT condition, site, idx, position, ref_nt, obs_nt, count FROM dense WHERE obs_nt <> ref_nt""", "v_g4", ctes=DENSE))
def s10_long(s: Source) -> DataFrame:
    t = sides(s)[0]
    return counts.long_from_matrix(counts.matrix(t, ["condition", "site"]), s.v_site, ["condition", "site"])


@query("a1_freq", oracle("""
SELECT condition, site, idx, position, ref_nt, obs_nt, count, total, round(count / total, 6) AS frequency,
  CASE WHEN holes = 0 THEN total END AS strict_total
FROM (SELECT *, sum(count) OVER w AS total, sum(CASE WHEN count IS NULL THEN 1 ELSE 0 END) OVER w AS holes
  FROM (SELECT condition, site, idx, position, ref_nt, obs_nt, CASE WHEN position = 6 AND ref_nt = 'A' AND obs_nt = 'G' THEN NULL ELSE count END AS count FROM t) y
  WINDOW w AS (PARTITION BY condition, site, idx)) x WHERE total >= 100""", "v_g4", ctes=SIDES))
def a1_freq(s: Source) -> DataFrame:
    rules = s.spark.createDataFrame([(6, "A", "G")], "position int, ref_nt string, obs_nt string")
    holed = counts.mask(sides(s)[0].withColumn("position", F.col("position").cast("int")), rules, ["position", "ref_nt", "obs_nt"], "null")
    rows = holed.withColumn("strict_total", counts.total("count", counts.CELL, "propagate"))
    return rounded(counts.frequencies(rows, depth=DEPTH)).select("condition", "site", "idx", "position", "ref_nt", "obs_nt", "count", "total", "frequency", "strict_total")


@query("j6_subtract", oracle("""
SELECT condition, site, idx, position, ref_nt, obs_nt, round(CASE WHEN obs_nt = ref_nt THEN t_count ELSE greatest(0.0, t_count - CASE WHEN c_total > 0 THEN c_count / c_total * t_total ELSE 0 END) END, 6) AS count
FROM paired""", "v_g4", ctes=PAIRED))
def j6_subtract(s: Source) -> DataFrame:
    return rounded(counts.subtract(*sides(s)))


@query("t1_binom_tail", oracle("SELECT condition, site, idx, obs_nt, t_count, c_count, t_total, c_total, round(p_value, 6) AS p_value FROM tested", "v_g4", ctes=TESTED))
def t1_binom_tail(s: Source) -> DataFrame:
    return rounded(stats.control_explained(*sides(s)).select("condition", "site", "idx", "obs_nt", "t_count", "c_count", "t_total", "c_total", "p_value"))


PMF = "exp(lgamma({n} + 1) - lgamma({j} + 1) - lgamma({n} - {j} + 1) + {j} * ln({p}) + ({n} - {j}) * ln(1 - {p}))"


@query("t2_error_tail", oracle(f"""
, rows AS (SELECT condition, site, idx, obs_nt, count, CAST(floor(count) AS BIGINT) AS k, CAST(floor(sum(count) OVER (PARTITION BY condition, site, idx)) AS BIGINT) AS n, ref_nt,
  pow(10.0, -(30 + (site + idx) % 7) / 10.0) AS tp, pow(10.0, -(30 + (site + 2 * idx) % 7) / 10.0) AS cp FROM t),
terms AS (SELECT *, list_transform(range(0, least(n, 24) + 1), lambda i: {PMF.format(n="n", j="i", p="cp")} *
  coalesce(list_sum(list_transform(range(i + k, least(n, i + k + 60) + 1), lambda j: {PMF.format(n="n", j="j", p="tp")})), 0.0)) AS ts FROM rows WHERE obs_nt <> ref_nt AND count > 0)
SELECT condition, site, idx, obs_nt, count, round(list_sum(ts[1:coalesce(list_position(list_transform(ts, lambda x: x <= 1e-6), true), len(ts))]), 5) AS p_value FROM terms""", "v_g4", ctes=SIDES).replace("\n\n, rows", ",\nrows"))
def t2_error_tail(s: Source) -> DataFrame:
    """Errors at the least qualities of each side, from a table of them by site and index."""
    places = s.v_site.select("site", F.explode(F.sequence(F.lit(15), F.lit(21))).alias("idx"))
    quality = places.select("site", "idx", (30 + (F.col("site") + F.col("idx")) % 7).alias("t_quality"), (30 + (F.col("site") + 2 * F.col("idx")) % 7).alias("c_quality"))
    return rounded(stats.sequencing_error(sides(s)[0], quality).select("condition", "site", "idx", "obs_nt", "count", "p_value"), 5)


@query("t3_wipe", oracle("""
SELECT condition, site, idx, position, ref_nt, obs_nt, CASE WHEN wiped THEN 0.0 ELSE t_count END AS count, wiped FROM (
  SELECT *, coalesce(max(CASE WHEN obs_nt <> ref_nt AND t_count > 0 AND c_total > 0 THEN c_count / c_total END) OVER (PARTITION BY condition, site, idx) >= 0.05, false) AS wiped FROM paired) x""", "v_g4", ctes=PAIRED))
def t3_wipe(s: Source) -> DataFrame:
    return counts.wipe_high_control(*sides(s))


RANKED = TESTED + """,
ranked AS (SELECT *, p_value <= row_number() OVER w / CAST(count(*) OVER (PARTITION BY condition) AS DOUBLE) * 0.05 AS ok,
  row_number() OVER w AS r FROM tested WHERE p_value <= 0.995 WINDOW w AS (PARTITION BY condition ORDER BY p_value, site, idx, obs_nt))"""


@query("t4_fdr_pointwise", oracle("""
SELECT tested.condition, tested.site, tested.idx, tested.obs_nt, coalesce(ok, false) AS accept FROM tested LEFT JOIN ranked USING (condition, site, idx, obs_nt)""", "v_g4", ctes=RANKED))
def t4_fdr_pointwise(s: Source) -> DataFrame:
    rows = stats.control_explained(*sides(s))
    return stats.fdr_flag(rows, "p_value", ["condition"], ["site", "idx", "obs_nt"], 0.05).select("condition", "site", "idx", "obs_nt", "accept")


@query("t4_fdr_stepdown", oracle("""
SELECT tested.condition, tested.site, tested.idx, tested.obs_nt, coalesce(bool_and(ok) OVER (PARTITION BY tested.condition ORDER BY r NULLS LAST ROWS UNBOUNDED PRECEDING), false) AND r IS NOT NULL AS accept
FROM tested LEFT JOIN ranked USING (condition, site, idx, obs_nt)""", "v_g4", ctes=RANKED))
def t4_fdr_stepdown(s: Source) -> DataFrame:
    rows = stats.control_explained(*sides(s))
    return stats.fdr_flag(rows, "p_value", ["condition"], ["site", "idx", "obs_nt"], 0.05, "step_down").select("condition", "site", "idx", "obs_nt", "accept")


@query("f12_mask_fold", oracle("""
SELECT t.condition, t.site, t.idx, t.position, t.ref_nt, CASE WHEN r.batch IS NULL THEN t.obs_nt ELSE t.ref_nt END AS obs_nt, sum(t.count) AS count
FROM t JOIN v_cond v ON t.condition = v.condition LEFT JOIN (VALUES ('b0', 7, 'A', 'T'), ('b1', 8, 'C', 'G'), ('b3', 6, 'G', 'A')) AS r(batch, position, ref_nt, obs_nt)
  ON v.batch = r.batch AND t.position = r.position AND t.ref_nt = r.ref_nt AND t.obs_nt = r.obs_nt GROUP BY ALL""", "v_g4", "v_cond", ctes=SIDES))
def f12_mask_fold(s: Source) -> DataFrame:
    rules = s.spark.createDataFrame([("b0", 7, "A", "T"), ("b1", 8, "C", "G"), ("b3", 6, "G", "A")], "batch string, position long, ref_nt string, obs_nt string")
    rows = sides(s)[0].join(F.broadcast(s.v_cond.select("condition", "batch")), "condition")
    return counts.mask(rows, rules, ["batch", "position", "ref_nt", "obs_nt"], "fold").drop("batch")


@query("f12_mask_zero", oracle("""
SELECT t.condition, t.site, t.idx, t.position, t.ref_nt, t.obs_nt, CASE WHEN r.batch IS NULL THEN t.count ELSE 0.0 END AS count
FROM t JOIN v_cond v ON t.condition = v.condition LEFT JOIN (VALUES ('b0', 7, 'A', 'T'), ('b1', 8, 'C', 'G'), ('b3', 6, 'G', 'A')) AS r(batch, position, ref_nt, obs_nt)
  ON v.batch = r.batch AND t.position = r.position AND t.ref_nt = r.ref_nt AND t.obs_nt = r.obs_nt""", "v_g4", "v_cond", ctes=SIDES))
def f12_mask_zero(s: Source) -> DataFrame:
    rules = s.spark.createDataFrame([("b0", 7, "A", "T"), ("b1", 8, "C", "G"), ("b3", 6, "G", "A")], "batch string, position long, ref_nt string, obs_nt string")
    rows = sides(s)[0].join(F.broadcast(s.v_cond.select("condition", "batch")), "condition")
    return counts.mask(rows, rules, ["batch", "position", "ref_nt", "obs_nt"], "zero").drop("batch")


@query("a2_zero_frac", oracle("SELECT condition, position, ref_nt, obs_nt, zero_sites, sites, round(mean_activity, 6) AS mean_activity, round(zero_sites / sites, 6) AS zero_fraction FROM zero", "v_g4", ctes=DENSE))
def a2_zero_frac(s: Source) -> DataFrame:
    return rounded(counts.zero_fraction(dense(s), DEPTH))


@query("a3_grid", oracle("""
SELECT condition, position, r AS ref_nt, o AS obs_nt, round(mean_activity, 6) AS mean_activity
FROM (SELECT DISTINCT condition FROM zero) a, (SELECT unnest(range(lo, hi + 1)) AS position FROM (SELECT min(position) AS lo, max(position) AS hi FROM zero) y) p,
  (VALUES ('A'), ('C'), ('G'), ('T')) AS x(r), (VALUES ('A'), ('C'), ('G'), ('T')) AS z(o)
LEFT JOIN zero ON a.condition = zero.condition AND p.position = zero.position AND r = zero.ref_nt AND o = zero.obs_nt WHERE r <> o""".replace("SELECT condition, position", "SELECT a.condition, p.position"), "v_g4", ctes=DENSE))
def a3_grid(s: Source) -> DataFrame:
    return rounded(counts.activity_grid(dense(s), DEPTH))


@query("t5_background", oracle("""
SELECT condition, position, ref_nt, obs_nt, zero_sites, sites, round(baseline, 6) AS baseline,
  round(CASE WHEN zero_sites = sites THEN 1.0 ELSE 1.0 - """ + TAIL.format(k="(zero_sites + 1)", n="sites", p="baseline") + """ END, 6) AS p_value
FROM zero JOIN (SELECT condition, avg(zero_sites / sites) AS baseline FROM (SELECT *, dense_rank() OVER (PARTITION BY condition ORDER BY position DESC) AS place FROM zero) x
  WHERE place <= 5 AND mean_activity <= 0.2 AND sites >= 5 GROUP BY condition) b USING (condition)""", "v_g4", ctes=DENSE))
def t5_background(s: Source) -> DataFrame:
    found = stats.background_test(counts.zero_fraction(dense(s), DEPTH), most_mean=0.2, least_sites=5)
    return rounded(found.select("condition", "position", "ref_nt", "obs_nt", "zero_sites", "sites", "baseline", "p_value"))


ANOVA = """parts AS (SELECT position, ref_nt, obs_nt, batch, count(*) AS n, avg(mean_activity) AS m, var_pop(mean_activity) * count(*) AS ss FROM activity GROUP BY ALL),
sums AS (SELECT position, ref_nt, obs_nt, count(*) AS k, CAST(sum(n) AS BIGINT) AS n, sum(ss) AS w, sum(n * m * m) - pow(sum(n * m), 2) / sum(n) AS b FROM parts GROUP BY ALL),
anova AS (SELECT position, ref_nt, obs_nt, k - 1 AS df_between, n - k AS df_within, CASE WHEN k > 1 AND n > k AND w <> 0 THEN greatest(b, 0.0) / (k - 1) / (w / (n - k)) END AS f_stat FROM sums)"""


@query("t6_anova", oracle("SELECT position, ref_nt, obs_nt, round(f_stat, 4) AS f_stat, df_between, df_within FROM anova", "v_g4", "v_cond", ctes=ACTIVITY + ",\n" + ANOVA))
def t6_anova(s: Source) -> DataFrame:
    return rounded(stats.anova(activity(s), "mean_activity", "batch", stats.MUTATION).drop("p_value"), 4)


SERIES = """exp({a} * ln({x}) + {b} * ln(1 - {x}) + lgamma({a} + {b}) - lgamma({a} + 1) - lgamma({b})) *
  list_sum(list_transform(range(0, 300), lambda i: exp(lgamma({a} + {b} + i) - lgamma({a} + {b}) - lgamma({a} + 1 + i) + lgamma({a} + 1) + i * ln({x}))))"""
F_TAIL = """CASE WHEN {f} IS NULL THEN NULL WHEN {f} <= 0 THEN 1.0 WHEN {x} <= 0.5 THEN """ + SERIES.format(a="({d2} / 2.0)", b="({d1} / 2.0)", x="({x})") + " ELSE 1 - " + SERIES.format(a="({d1} / 2.0)", b="({d2} / 2.0)", x="(1 - {x})") + " END"


def f_tail(f: str, d1: str, d2: str) -> str:
    """SQL of the upper tail of the F distribution, by the series of the incomplete beta function."""
    return F_TAIL.format(f=f, d1=d1, d2=d2, x=f"({d2} / ({d2} + {d1} * {f}))")


@query("t6_anova_p", oracle(f"SELECT position, ref_nt, obs_nt, round(f_stat, 4) AS f_stat, df_between, df_within, round({f_tail('f_stat', 'df_between', 'df_within')}, 4) AS p_value FROM anova", "v_g4", "v_cond", ctes=ACTIVITY + ",\n" + ANOVA))
def t6_anova_p(s: Source) -> DataFrame:
    return rounded(stats.anova(activity(s), "mean_activity", "batch", stats.MUTATION), 4)


@query("t7_bonferroni", oracle("SELECT condition, site, idx, obs_nt, p_value <= 0.005 / (SELECT count(*) FROM tested) AS accept FROM tested", "v_g4", ctes=TESTED))
def t7_bonferroni(s: Source) -> DataFrame:
    return stats.bonferroni(stats.control_explained(*sides(s))).select("condition", "site", "idx", "obs_nt", "accept")


MEANS = ACTIVITY + """,
bm AS (SELECT position, ref_nt, obs_nt, batch, avg(mean_activity) AS m FROM activity GROUP BY ALL),
km AS (SELECT position, ref_nt, obs_nt, kind, batch, avg(mean_activity) AS m FROM activity GROUP BY ALL),
means AS (SELECT position, ref_nt, obs_nt, avg(m) AS mean_means, quantile_cont(m, 0.5) AS median_means, max(m) - min(m) AS spread FROM bm GROUP BY ALL),
kinds AS (SELECT position, ref_nt, obs_nt, quantile_cont(m, 0.5) FILTER (kind = 'CBE') AS cbe_median, quantile_cont(m, 0.5) FILTER (kind = 'ABE') AS abe_median FROM km GROUP BY ALL)"""


@query("a20_batch_means", oracle("""
SELECT position, ref_nt, obs_nt, round(mean_means, 8) AS mean_means, round(median_means, 8) AS median_means, round(spread, 8) AS spread, round(cbe_median, 8) AS cbe_median, round(abe_median, 8) AS abe_median
FROM means JOIN kinds USING (position, ref_nt, obs_nt)""", "v_g4", "v_cond", ctes=MEANS))
def a20_batch_means(s: Source) -> DataFrame:
    return rounded(batch.batch_means(activity(s)), 8)


@query("t8_culprits", oracle("""
SELECT position, ref_nt, obs_nt, batch, round(m, 8) AS batch_mean FROM bm JOIN means USING (position, ref_nt, obs_nt) JOIN kinds USING (position, ref_nt, obs_nt)
WHERE spread >= 0.002 AND coalesce(cbe_median, 0) <= 0.1 AND coalesce(abe_median, 0) <= 0.1 AND m >= 0.002""", "v_g4", "v_cond", ctes=MEANS))
def t8_culprits(s: Source) -> DataFrame:
    return rounded(batch.culprits(activity(s), background=0.1), 8)


POOL = MEANS + """,
pool AS (SELECT batch, position, ref_nt, obs_nt, count(DISTINCT condition) AS pool_count, conditions, count(DISTINCT condition) / CAST(conditions AS DOUBLE) AS pool_fraction
  FROM activity JOIN (SELECT batch, count(DISTINCT condition) AS conditions FROM v_cond GROUP BY batch) x USING (batch) WHERE mean_activity >= 0.05 GROUP BY batch, position, ref_nt, obs_nt, conditions)"""


def pool(s: Source) -> DataFrame:
    return batch.pool_fraction(activity(s).where("mean_activity >= 0.05").drop("batch"), "batch", s.v_cond)


@query("a16_pool", oracle("SELECT batch, position, ref_nt, obs_nt, pool_count, conditions, round(pool_fraction, 6) AS pool_fraction FROM pool", "v_g4", "v_cond", ctes=POOL))
def a16_pool(s: Source) -> DataFrame:
    return rounded(pool(s))


@query("t11_islands", oracle("""
SELECT batch, position, ref_nt, obs_nt, round(pool_fraction, 6) AS pool_fraction FROM (
  SELECT *, max(CASE WHEN position = 6 AND ((ref_nt = 'A' AND obs_nt = 'G') OR (ref_nt = 'C' AND obs_nt IN ('T', 'G'))) THEN 1 ELSE 0 END) OVER (PARTITION BY batch, ref_nt, obs_nt, island) AS hit
  FROM (SELECT *, position - row_number() OVER (PARTITION BY batch, ref_nt, obs_nt ORDER BY position) AS island FROM pool WHERE pool_fraction >= 0.25) x) y WHERE hit = 0""", "v_g4", "v_cond", ctes=POOL))
def t11_islands(s: Source) -> DataFrame:
    return rounded(batch.drop_islands(pool(s), "batch").select("batch", "position", "ref_nt", "obs_nt", "pool_fraction"))


@query("t10_rra", oracle("""
, many AS (SELECT count(DISTINCT condition) AS n FROM activity),
common AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY position, ref_nt, obs_nt) AS seen FROM activity) x, many WHERE seen = n),
ranks AS (SELECT position, ref_nt, obs_nt, n, row_number() OVER (PARTITION BY condition ORDER BY mean_activity DESC, position, ref_nt, obs_nt) / CAST(count(*) OVER (PARTITION BY condition) AS DOUBLE) AS r FROM common),
per AS (SELECT position, ref_nt, obs_nt, n, list_sort(list(r)) AS rs FROM ranks GROUP BY ALL),
rho AS (SELECT position, ref_nt, obs_nt, n * list_min(list_transform(range(1, n + 1), lambda i: list_sum(list_transform(range(i, n + 1), lambda j:
  (j - i + 1) * CAST(factorial(CAST(n AS INT)) / (factorial(CAST(j AS INT)) * factorial(CAST(n - j AS INT))) AS DOUBLE) * pow(rs[i], j) * pow(1 - rs[i], n - j))))) AS rho FROM per),
placed AS (SELECT *, row_number() OVER w AS place, rho <= row_number() OVER w / CAST(count(*) OVER () AS DOUBLE) * 0.01 AS ok FROM rho WINDOW w AS (ORDER BY rho, position, ref_nt, obs_nt))
SELECT position, ref_nt, obs_nt, round(rho, 6) AS rho, bool_and(ok) OVER (ORDER BY place ROWS UNBOUNDED PRECEDING) AS accept FROM placed""", "v_g4", "v_cond", ctes=ACTIVITY).replace("\n\n, many", ",\nmany"))
def t10_rra(s: Source) -> DataFrame:
    return rounded(stats.rank_aggregation(activity(s), "mean_activity", stats.MUTATION))


@query("t10_ranks", oracle("""
SELECT condition, position, ref_nt, obs_nt, round(row_number() OVER (PARTITION BY condition ORDER BY mean_activity DESC, position, ref_nt, obs_nt) / CAST(count(*) OVER (PARTITION BY condition) AS DOUBLE), 6) AS rank
FROM activity""", "v_g4", "v_cond", ctes=ACTIVITY))
def t10_ranks(s: Source) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("condition").orderBy(F.desc("mean_activity"), *stats.MUTATION)
    return rounded(activity(s).select("condition", *stats.MUTATION, (F.row_number().over(order) / F.count("*").over(Window.partitionBy("condition"))).alias("rank")))


@query("t17_median_bg", oracle("""
SELECT condition, site, position, ref_nt, obs_nt, round(greatest(0.0, count / total - coalesce(background, 0)), 6) AS adjusted
FROM freq JOIN (SELECT condition, ref_nt, obs_nt, quantile_cont(count / total, 0.5) FILTER (position BETWEEN 9 AND 11) AS background FROM freq WHERE ref_nt <> obs_nt GROUP BY ALL) b USING (condition, ref_nt, obs_nt)""", "v_g4", ctes=DENSE))
def t17_median_bg(s: Source) -> DataFrame:
    freq = counts.frequencies(dense(s), depth=DEPTH).where("ref_nt <> obs_nt")
    return rounded(counts.median_background(freq, (9, 11)).select("condition", "site", "position", "ref_nt", "obs_nt", "adjusted"))


@query("a13_onoff", oracle("""
SELECT condition, x.site, position, edit_count, total_count, category, round(edit_count / total_count, 6) AS edited_fraction,
  CAST(len(list_filter(range(1, 21), lambda i: substr(grna, i, 1) = substr(seq, pos0_idx + 1 + i, 1))) AS INT) AS match_count
FROM (SELECT condition, site, position, sum(CASE WHEN obs_nt <> ref_nt THEN count ELSE 0 END) AS edit_count, sum(count) AS total_count FROM t WHERE ref_nt = 'C' AND position IN (6, 7) GROUP BY ALL) x
JOIN v_site ON x.site = v_site.site""", "v_g4", ctes=SIDES))
def a13_onoff(s: Source) -> DataFrame:
    return rounded(counts.on_off_target(sides(s)[0], s.v_site))


@query("a15_pool_l2", oracle("""
SELECT g AS condition_group, site, position, ref_nt, obs_nt, sum(count) AS count FROM t JOIN (VALUES ('g0', 'c0'), ('g0', 'c2'), ('g1', 'c1'), ('g1', 'c3')) AS m(g, condition) USING (condition) GROUP BY ALL""", "v_g4", ctes=SIDES))
def a15_pool_l2(s: Source) -> DataFrame:
    groups = s.spark.createDataFrame([("g0", ["c0", "c2"]), ("g1", ["c1", "c3"])], "name string, members array<string>")
    return counts.pool_replicates(sides(s)[0], groups, ["site", "position", "ref_nt", "obs_nt"])


@query("a22_shares", oracle("""
SELECT condition, site, position, round(t / e, 6) AS c_t, round(g / e, 6) AS c_g, round(a / e, 6) AS c_a, round((a + g) / e, 6) AS c_ga
FROM (SELECT *, a + g + t AS e, count(*) OVER (PARTITION BY condition, position) AS n FROM (
  SELECT condition, site, position, coalesce(sum(count) FILTER (obs_nt = 'A'), 0) AS a, coalesce(sum(count) FILTER (obs_nt = 'G'), 0) AS g, coalesce(sum(count) FILTER (obs_nt = 'T'), 0) AS t
  FROM t WHERE ref_nt = 'C' AND obs_nt <> 'C' GROUP BY ALL) x) y WHERE n >= 5 AND e >= 50""", "v_g4", ctes=SIDES))
def a22_shares(s: Source) -> DataFrame:
    return rounded(counts.substitution_shares(sides(s)[0], edited_least=50, rows_least=5))
