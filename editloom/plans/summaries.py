"""Queries that join families, summarise, reshape, and look up."""

from __future__ import annotations

from math import exp, factorial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editloom.functions import seq
from editloom.operators import batch, counts, haplotypes, indels, models, stats, summary
from editloom.plans import haplotypes as hq
from editloom.plans import indels as iq
from editloom.plans import positions as pq
from editloom.plans.registry import query, rounded
from editloom.sources import dimensions as dim
from editloom.sources.fixtures import Source, oracle

ANNOT = hq.LONG + """,
annot AS (SELECT condition, site, sum(CASE WHEN edits > 0 THEN count ELSE 0.0 END) AS edited_count, sum(count) AS total_count, sum(CASE WHEN edits > 0 THEN count ELSE 0.0 END) / sum(count) AS fraction_edited FROM reads WHERE side = 'T' GROUP BY ALL),
isum AS (SELECT condition, site, sum(count) AS total_indel, sum(CASE WHEN category <> 'wildtype' THEN count ELSE 0.0 END) AS indel_count, sum(CASE WHEN category = 'wildtype' THEN count ELSE 0.0 END) / sum(count) AS wildtype_freq,
  sum(CASE WHEN category <> 'wildtype' THEN count ELSE 0.0 END) / sum(count) AS indel_freq FROM v_h6 WHERE role = 'T' GROUP BY ALL),
ratios AS (SELECT condition, site, fraction_edited, edited_count, total_count AS total_be, total_indel, indel_count, wildtype_freq, indel_freq, wildtype_freq * fraction_edited AS base_edit_freq, wildtype_freq * fraction_edited / nullif(indel_freq, 0) AS ratio
  FROM annot JOIN isum USING (condition, site)),
good AS (SELECT ratios.* FROM ratios JOIN v_site USING (site) WHERE length(substr(grna, 4, 4)) - length(replace(substr(grna, 4, 4), 'C', '')) > 0 AND total_be >= 100 AND total_indel >= 1000 AND base_edit_freq >= 0.025)"""
V = ("v_cond", "v_g5_long", "v_h6")


def ratios(s: Source) -> DataFrame:
    return summary.edit_indel_ratio(haplotypes.annotate(hq.reads(s)), indels.summary(iq.sides(s)[0]))


def good(s: Source) -> DataFrame:
    return summary.qualified(ratios(s), s.v_site, depth=100).where("total_indel >= 1000")


@query("j8_ratio", oracle("""
SELECT condition, site, round(fraction_edited, 6) AS fraction_edited, edited_count, total_be, total_indel, indel_count, round(wildtype_freq, 6) AS wildtype_freq, round(indel_freq, 6) AS indel_freq, round(base_edit_freq, 6) AS base_edit_freq, round(ratio, 6) AS ratio FROM ratios""", *V, ctes=ANNOT))
def j8_ratio(s: Source) -> DataFrame:
    return rounded(ratios(s))


@query("f3_qualified", oracle("SELECT condition, site, round(ratio, 6) AS ratio FROM good", *V, ctes=ANNOT))
def f3_qualified(s: Source) -> DataFrame:
    return rounded(good(s).select("condition", "site", "ratio"))


@query("a18_ratio_stats", oracle("""
SELECT condition, count(*) AS n, round(exp(avg(ln(ratio))), 6) AS gmean, round(exp(stddev_pop(ln(ratio))), 6) AS gstd, round(quantile_cont(ratio, 0.5), 6) AS median, round(quantile_cont(ratio, 0.25), 6) AS p25, round(quantile_cont(ratio, 0.75), 6) AS p75
FROM good WHERE ratio > 0 GROUP BY ALL""", *V, ctes=ANNOT))
def a18_ratio_stats(s: Source) -> DataFrame:
    return rounded(summary.ratio_summary(good(s), "ratio", ["condition"]))


@query("a19_efficiency", oracle("""
SELECT condition, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.25), 6) AS p25, round(quantile_cont(x, 0.75), 6) AS p75,
  CAST(sum(CASE WHEN total_indel >= 100 THEN 1 ELSE 0 END) AS BIGINT) AS deep_sites, sum(total_indel) AS total_reads FROM (SELECT *, base_edit_freq AS x FROM ratios) r GROUP BY ALL""", *V, ctes=ANNOT))
def a19_efficiency(s: Source) -> DataFrame:
    return rounded(summary.efficiency(ratios(s)))


PAIRS = "reps AS (SELECT min(condition) AS rep1, max(condition) AS rep2 FROM v_cond GROUP BY editor, library, celltype HAVING count(*) = 2)"


@query("m5_replicates", oracle("SELECT editor, library, celltype, min(condition) AS rep1, max(condition) AS rep2 FROM v_cond GROUP BY editor, library, celltype HAVING count(*) = 2", "v_cond"))
def m5_replicates(s: Source) -> DataFrame:
    return summary.replicate_pairs(s.v_cond)


@query("j10_replicates", oracle("""
SELECT rep1, rep2, site, round(a.ratio, 6) AS v1, round(b.ratio, 6) AS v2, round(abs(a.ratio - b.ratio), 6) AS difference, round(CASE WHEN a.ratio > 0 AND b.ratio > 0 THEN abs(log2(a.ratio / b.ratio)) END, 6) AS log2_fold
FROM reps JOIN ratios a ON rep1 = a.condition JOIN ratios b ON rep2 = b.condition AND a.site = b.site""".replace("SELECT rep1, rep2, site", "SELECT rep1, rep2, a.site"), *V, ctes=ANNOT + ", " + PAIRS))
def j10_replicates(s: Source) -> DataFrame:
    return rounded(summary.replicates(ratios(s), summary.replicate_pairs(s.v_cond), ["site"], "ratio"))


CONDITIONS = [f"c{i}" for i in range(8)]


@query("j11_fold", oracle("SELECT site, " + ", ".join(f"round(max(ratio) FILTER (condition = '{c}'), 6) AS {c}" for c in CONDITIONS) + ", round(avg(ratio), 6) AS row_mean FROM ratios GROUP BY site", *V, ctes=ANNOT))
def j11_fold(s: Source) -> DataFrame:
    return rounded(summary.fold(ratios(s), ["site"], "ratio", CONDITIONS))


@query("r1_pivot", oracle("SELECT position, ref_nt, obs_nt, " + ", ".join(f"round(max(mean_activity) FILTER (condition = '{c}'), 6) AS {c}" for c in CONDITIONS) + ", round(avg(mean_activity), 6) AS row_mean FROM zero GROUP BY ALL", "v_g4", ctes=pq.DENSE))
def r1_pivot(s: Source) -> DataFrame:
    return rounded(summary.fold(counts.zero_fraction(pq.dense(s), 100), stats.MUTATION, "mean_activity", CONDITIONS))


@query("r3_melt", oracle("SELECT site, condition, round(max(ratio), 6) AS ratio FROM ratios WHERE ratio IS NOT NULL GROUP BY ALL", *V, ctes=ANNOT))
def r3_melt(s: Source) -> DataFrame:
    wide = summary.fold(ratios(s), ["site"], "ratio", CONDITIONS)
    return rounded(summary.melt(wide, ["site"], CONDITIONS, "condition", "ratio").where("ratio is not null"))


@query("r4_reps_long", oracle("""
SELECT rep1, rep2, site, replicate, round(value, 6) AS value FROM (SELECT rep1, rep2, a.site, a.ratio AS r0, b.ratio AS r1 FROM reps JOIN ratios a ON rep1 = a.condition JOIN ratios b ON rep2 = b.condition AND a.site = b.site) x
UNPIVOT INCLUDE NULLS (value FOR replicate IN (r0, r1))""", *V, ctes=ANNOT + ", " + PAIRS))
def r4_reps_long(s: Source) -> DataFrame:
    both = summary.replicates(ratios(s), summary.replicate_pairs(s.v_cond), ["site"], "ratio").select("rep1", "rep2", "site", F.col("v1").alias("r0"), F.col("v2").alias("r1"))
    return rounded(summary.melt(both, ["rep1", "rep2", "site"], ["r0", "r1"], "replicate", "value"))


@query("r5_union", oracle("SELECT condition, site, round(ratio, 6) AS ratio, NULL AS indel_freq FROM ratios UNION ALL SELECT condition, site, NULL, round(indel_freq, 6) FROM isum", *V, ctes=ANNOT))
def r5_union(s: Source) -> DataFrame:
    a = ratios(s).select("condition", "site", "ratio")
    return rounded(summary.stack_frames(a, indels.summary(iq.sides(s)[0]).select("condition", "site", "indel_freq")))


@query("s7_stack_weight", oracle("SELECT condition, site, round(ratio, 6) AS ratio, round(1.0 / count(*) OVER (PARTITION BY condition), 6) AS weight FROM good", *V, ctes=ANNOT))
def s7_stack_weight(s: Source) -> DataFrame:
    return rounded(summary.weighted(good(s).select("condition", "site", "ratio")))


@query("s9_publish", oracle("SELECT r.condition, r.site, round(ratio, 6) AS ratio FROM ratios r JOIN v_cond v ON r.condition = v.condition WHERE editor = 'BE4' AND library = '12kChar'", *V, ctes=ANNOT))
def s9_publish(s: Source) -> DataFrame:
    return rounded(dim.publish(ratios(s), s.v_cond, editor="BE4", library="12kChar").select("condition", "site", "ratio"))


@query("j15_obs_pred", oracle("""
SELECT annot.condition || '_' || annot.site AS id, round(fraction_edited, 6) AS observed, round(base_edit_freq, 6) AS predicted FROM annot JOIN ratios ON annot.condition = ratios.condition AND annot.site = ratios.site WHERE total_count >= 100""".replace("round(fraction_edited", "round(annot.fraction_edited"), *V, ctes=ANNOT))
def j15_obs_pred(s: Source) -> DataFrame:
    return rounded(summary.observed_predicted(haplotypes.annotate(hq.reads(s)), ratios(s).withColumn("predicted", F.col("base_edit_freq"))))


HASH = "CAST('0x' || substr(md5({x}), 1, 8) AS BIGINT)"


BOOT = ANNOT + """,
boot_rows AS (SELECT condition, ratio AS x, row_number() OVER (PARTITION BY condition ORDER BY site) - 1 AS spot, count(*) OVER (PARTITION BY condition) AS n FROM ratios WHERE ratio IS NOT NULL),
draws AS (SELECT condition, rep, """ + HASH.format(x="'boot|' || rep || '|' || spot") + """ % n AS pick FROM boot_rows, (SELECT unnest(range(1, 201)) AS rep) r),
means AS (SELECT draws.condition, rep, avg(x) AS m FROM draws JOIN boot_rows ON draws.condition = boot_rows.condition AND pick = spot GROUP BY ALL)"""


@query("t12_bootstrap", oracle("""
SELECT condition, round(quantile_cont(m, 0.025), 6) AS p025, round(quantile_cont(m, 0.16), 6) AS p16, round(quantile_cont(m, 0.84), 6) AS p84, round(quantile_cont(m, 0.975), 6) AS p975 FROM means GROUP BY ALL""", *V, ctes=BOOT))
def t12_bootstrap(s: Source) -> DataFrame:
    return rounded(stats.bootstrap(ratios(s), "ratio", ["condition"], ["site"], replicates=200))


CUTS = ", ".join(repr(sum(exp(-1) / factorial(j) for j in range(k + 1))) for k in range(8))


@query("t12_bootstrap_poisson", oracle(f"""
, draws AS (SELECT condition, rep, ratio, len(list_filter([{CUTS}], lambda c: ({HASH.format(x="'boot|' || rep || '|' || condition || '|' || site")} + 0.5) / 4294967296.0 > c)) AS w
  FROM ratios, (SELECT unnest(range(1, 5001)) AS rep) r WHERE ratio IS NOT NULL),
means AS (SELECT condition, rep, sum(ratio * w) / nullif(sum(w), 0) AS m FROM draws GROUP BY ALL)
SELECT condition, round(quantile_cont(m, 0.025), 6) AS p025, round(quantile_cont(m, 0.16), 6) AS p16, round(quantile_cont(m, 0.84), 6) AS p84, round(quantile_cont(m, 0.975), 6) AS p975 FROM means GROUP BY ALL""", *V, ctes=ANNOT).replace("\n\n, draws", ",\ndraws"))
def t12_bootstrap_poisson(s: Source) -> DataFrame:
    return rounded(stats.bootstrap_poisson(ratios(s), "ratio", ["condition"], ["condition", "site"], replicates=5000))


def boot(kind: str, replicates: int) -> str:
    """SQL of the intervals of one statistic, with the draws of ``stats.bootstrap``."""
    each = {"mean": "avg(x)", "gmean": "exp(avg(ln(x)))", "median": "quantile_cont(x, 0.5)"}[kind]
    return oracle("SELECT condition, round(quantile_cont(m, 0.025), 6) AS p025, round(quantile_cont(m, 0.16), 6) AS p16, round(quantile_cont(m, 0.84), 6) AS p84, round(quantile_cont(m, 0.975), 6) AS p975 FROM means GROUP BY ALL", *V, ctes=ANNOT + f""",
boot_rows AS (SELECT condition, ratio AS x, row_number() OVER (PARTITION BY condition ORDER BY site) - 1 AS spot, count(*) OVER (PARTITION BY condition) AS n FROM ratios WHERE ratio {"> 0" if kind == "gmean" else "IS NOT NULL"}),
draws AS (SELECT condition, rep, {HASH.format(x="'boot|' || rep || '|' || spot")} % n AS pick FROM boot_rows, (SELECT unnest(range(1, {replicates + 1})) AS rep) r),
means AS (SELECT draws.condition, rep, {each} AS m FROM draws JOIN boot_rows ON draws.condition = boot_rows.condition AND pick = spot GROUP BY ALL)""")


@query("t12_mean", boot("mean", 5000))
def t12_mean(s: Source) -> DataFrame:
    return rounded(stats.bootstrap(ratios(s), "ratio", ["condition"], ["site"], replicates=5000))


@query("t12_gmean", boot("gmean", 10000))
def t12_gmean(s: Source) -> DataFrame:
    return rounded(stats.bootstrap(ratios(s), "ratio", ["condition"], ["site"], replicates=10000, kind="gmean"))


@query("t12_median", boot("median", 10000))
def t12_median(s: Source) -> DataFrame:
    return rounded(stats.bootstrap(ratios(s), "ratio", ["condition"], ["site"], replicates=10000, kind="median"))


@query("t13_corr", oracle("""
SELECT condition, count(*) AS n, round(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0), 6) + 0.0 AS pearson, round(covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0), 6) + 0.0 AS spearman, round(1 - sum((y - x) * (y - x)) / sum((y - m) * (y - m)), 6) AS r2 FROM (
  SELECT *, avg(y) OVER (PARTITION BY condition) AS m, rank() OVER (PARTITION BY condition ORDER BY x) + (count(*) OVER (PARTITION BY condition, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY condition ORDER BY y) + (count(*) OVER (PARTITION BY condition, y) - 1) / 2.0 AS ry
  FROM (SELECT condition, base_edit_freq AS x, fraction_edited AS y FROM ratios) a) b GROUP BY ALL""", *V, ctes=ANNOT))
def t13_corr(s: Source) -> DataFrame:
    return rounded(stats.correlation(ratios(s), "base_edit_freq", "fraction_edited", ["condition"]).drop("p_value"))


@query("t14_mwu", oracle("""
SELECT condition, n1, n0, r1 - n1 * (n1 + 1) / 2.0 AS u, round((r1 - n1 * (n1 + 1) / 2.0 - n1 * n0 / 2.0) / nullif(sqrt(n1 * n0 / 12.0 * (n1 + n0 + 1 - tied / ((n1 + n0) * (n1 + n0 - 1)))), 0), 6) AS z FROM (
  SELECT condition, CAST(sum(label) AS BIGINT) AS n1, CAST(sum(1 - label) AS BIGINT) AS n0, sum(CASE WHEN label = 1 THEN r ELSE 0.0 END) AS r1, CAST(sum(ties * ties - 1) AS DOUBLE) AS tied FROM (
    SELECT *, rank() OVER (PARTITION BY condition ORDER BY ratio) + (ties - 1) / 2.0 AS r FROM (SELECT condition, ratio, CAST(site % 2 AS INT) AS label, count(*) OVER (PARTITION BY condition, ratio) AS ties FROM ratios WHERE ratio IS NOT NULL) x) y GROUP BY ALL) z""", *V, ctes=ANNOT))
def t14_mwu(s: Source) -> DataFrame:
    rows = ratios(s).where("ratio is not null").withColumn("label", (F.col("site") % 2).cast("int"))
    return rounded(stats.mann_whitney(rows, "ratio", "label", ["condition"]).drop("p_value"))


def by_factors(s: Source) -> DataFrame:
    return summary.weighted(good(s)).join(F.broadcast(s.v_cond.select("condition", "editor", "batch")), "condition")


@query("t15_twoway")
def t15_twoway(s: Source) -> DataFrame:
    return models.two_way(by_factors(s), "ratio", ("editor", "batch"), "weight")


@query("t15_residuals", oracle("""
SELECT factor, level, 0.0 AS residual FROM (SELECT DISTINCT unnest(['editor', 'batch']) AS factor, unnest([editor, batch]) AS level FROM good JOIN v_cond USING (condition) WHERE ratio > 0) x""", *V, ctes=ANNOT))
def t15_residuals(s: Source) -> DataFrame:
    """What the fit leaves in each level: weighted residuals add up to nothing where it solves the normal equations."""
    rows = by_factors(s).where("ratio > 0")
    fit = models.two_way(rows, "ratio", ("editor", "batch"), "weight")
    part = lambda name: F.broadcast(fit.where(F.col("factor") == name).select(F.col("level").alias(name), F.col("coefficient").alias(f"at_{name}")))
    both = rows.join(part("editor"), "editor").join(part("batch"), "batch")
    left = F.col("weight") * (F.ln("ratio") - F.col("at_editor") - F.col("at_batch"))
    levels = F.explode(F.array(*[F.struct(F.lit(n).alias("factor"), F.col(n).alias("level")) for n in ("editor", "batch")]))
    return rounded(both.select(levels.alias("l"), left.alias("left")).groupBy("l.factor", "l.level").agg(F.sum("left").alias("residual")))


@query("t16_adjust", oracle("""
SELECT condition, site, batch, round(ratio, 6) AS ratio, round(CASE WHEN ratio > 0 THEN exp(ln(ratio) + 0.15 - b) END, 6) AS adjusted
FROM ratios JOIN v_cond USING (condition) JOIN (VALUES ('b0', 0.0), ('b1', 0.1), ('b2', 0.2), ('b3', 0.3)) AS k(batch, b) USING (batch)""", *V, ctes=ANNOT))
def t16_adjust(s: Source) -> DataFrame:
    coefficients = s.spark.createDataFrame([("b0", 0.0), ("b1", 0.1), ("b2", 0.2), ("b3", 0.3)], "batch string, coefficient double")
    rows = ratios(s).join(F.broadcast(s.v_cond.select("condition", "batch")), "condition").select("condition", "site", "batch", "ratio")
    return rounded(batch.adjust_ratio(rows, coefficients, "batch", "ratio"))


@query("t16_indel_adjust", oracle("""
SELECT t.condition, site, category, count, round(CASE WHEN category = 'wildtype' THEN count ELSE exp(ln(count) + b - 0.15) END, 6) AS adjusted
FROM (SELECT * FROM v_h6 WHERE role = 'T') t JOIN v_cond v ON t.condition = v.condition JOIN (VALUES ('b0', 0.0), ('b1', 0.1), ('b2', 0.2), ('b3', 0.3)) AS k(batch, b) ON v.batch = k.batch""", "v_h6", "v_cond"))
def t16_indel_adjust(s: Source) -> DataFrame:
    coefficients = s.spark.createDataFrame([("b0", 0.0), ("b1", 0.1), ("b2", 0.2), ("b3", 0.3)], "batch string, coefficient double")
    rows = iq.sides(s)[0].join(F.broadcast(s.v_cond.select("condition", "batch")), "condition").select("condition", "batch", "site", "category", "count")
    return rounded(batch.adjust_indels(rows, coefficients, "batch").drop("batch"))


FITTED = ANNOT + """,
fit_rows AS (SELECT g.condition, site, editor, batch, ratio, total_be, 1.0 / count(*) OVER (PARTITION BY g.condition) AS weight FROM good g JOIN v_cond v ON g.condition = v.condition),
fit_batch AS (SELECT batch, sum(weight) AS w, sum(weight * ln(ratio)) AS wy, coalesce(sum(weight) FILTER (editor = 'BE4'), 0) AS w2, coalesce(sum(weight * ln(ratio)) FILTER (editor = 'BE4'), 0) AS wy2 FROM fit_rows WHERE ratio > 0 GROUP BY ALL),
fit_editor AS (SELECT coalesce(sum(wy2 - w2 * wy / w) / nullif(sum(w2 - w2 * w2 / w), 0), 0) AS d FROM fit_batch),
fit AS (SELECT batch, (wy - w2 * d) / w AS b FROM fit_batch, fit_editor)"""


def fitted_batches(s: Source) -> DataFrame:
    """Coefficients of the batches in the two-way fit; only their differences are told by the data, and only these are used."""
    return models.two_way(by_factors(s), "ratio", ("editor", "batch"), "weight").where("factor = 'batch'").select(F.col("level").alias("batch"), "coefficient")


@query("t16_fitted", oracle("""
SELECT condition, site, batch, round(ratio, 6) AS ratio, round(CASE WHEN ratio > 0 THEN exp(ln(ratio) + (SELECT avg(b) FROM fit) - b) END, 6) AS adjusted FROM fit_rows JOIN fit USING (batch)""", *V, ctes=FITTED))
def t16_fitted(s: Source) -> DataFrame:
    """Ratios adjusted by the batch coefficients of their own two-way fit. The SQL eliminates the batches by hand, as the editors are two."""
    rows = by_factors(s).select("condition", "site", "batch", "ratio")
    return rounded(batch.adjust_ratio(rows, fitted_batches(s), "batch", "ratio"))


@query("t16_editor_summary", oracle("""
SELECT editor, count(*) AS n, round(exp(avg(ln(x))), 6) AS gmean, round(exp(stddev_pop(ln(x))), 6) AS gstd, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.25), 6) AS p25, round(quantile_cont(x, 0.75), 6) AS p75
FROM (SELECT editor, exp(ln(ratio) + (SELECT avg(b) FROM fit) - b) AS x FROM fit_rows JOIN fit USING (batch) WHERE ratio > 0) y GROUP BY ALL""", *V, ctes=FITTED))
def t16_editor_summary(s: Source) -> DataFrame:
    """The adjusted ratios of each editor over all its conditions."""
    rows = by_factors(s).select("condition", "site", "editor", "batch", "ratio")
    return rounded(summary.ratio_summary(batch.adjust_ratio(rows, fitted_batches(s), "batch", "ratio"), "adjusted", ["editor"]))


@query("t16_indel_fitted", oracle("""
SELECT t.condition, t.site, category, indel_start, indel_end, inserted_bases, mh_length, count, round(CASE WHEN category = 'wildtype' THEN count ELSE exp(ln(count) + b - (SELECT avg(b) FROM fit)) END, 6) AS adjusted
FROM (SELECT * FROM v_h6 WHERE role = 'T') t JOIN v_cond v ON t.condition = v.condition JOIN fit ON v.batch = fit.batch""", *V, ctes=FITTED))
def t16_indel_fitted(s: Source) -> DataFrame:
    """Indel counts moved the other way by the coefficients that the ratios were adjusted by."""
    rows = iq.sides(s)[0].join(F.broadcast(s.v_cond.select("condition", "batch")), "condition")
    moved = batch.adjust_indels(rows, fitted_batches(s), "batch")
    return rounded(moved.select("condition", "site", "category", "indel_start", "indel_end", "inserted_bases", "mh_length", "count", "adjusted"))


@query("t19_expit", oracle("""
SELECT condition, site, round(ln(fraction_edited / (1 - fraction_edited)), 6) AS logit, round(1 / (1 + exp(-(2 * ln(fraction_edited / (1 - fraction_edited)) + ln(m / (1 - m))))), 6) AS recalibrated
FROM (SELECT *, avg(fraction_edited) OVER (PARTITION BY condition) AS m FROM annot) x WHERE fraction_edited > 0 AND fraction_edited < 1""", *V, ctes=ANNOT))
def t19_expit(s: Source) -> DataFrame:
    rows = haplotypes.annotate(hq.reads(s))
    mean = rows.groupBy("condition").agg(F.avg("fraction_edited").alias("m"))
    both = rows.join(F.broadcast(mean), "condition").withColumn("logit", seq.logit(F.col("fraction_edited"))).where("logit is not null")
    return rounded(both.select("condition", "site", "logit", summary.recalibrated(F.col("logit"), F.col("m")).alias("recalibrated")))


@query("a26_classes", oracle("""
SELECT condition, site, position, class, round(sum(count / total), 6) AS frequency FROM freq JOIN (VALUES ('C_TGA', 'C', 'T'), ('C_TGA', 'C', 'G'), ('C_TGA', 'C', 'A'), ('A_G', 'A', 'G')) AS k(class, ref_nt, obs_nt) USING (ref_nt, obs_nt) GROUP BY ALL""", "v_g4", ctes=pq.DENSE))
def a26_classes(s: Source) -> DataFrame:
    freq = counts.frequencies(pq.dense(s), depth=100)
    return rounded(summary.class_frequency(freq, {"C_TGA": ["C_T", "C_G", "C_A"], "A_G": ["A_G"]}))


@query("x1_context", oracle("""
SELECT site, CAST(idx AS INT) AS idx, CASE WHEN idx >= 5 AND idx + 5 < length(seq) THEN substr(seq, CAST(idx - 4 AS INT), 5) || substr(seq, CAST(idx + 2 AS INT), 5) END AS context FROM v_site, (SELECT unnest(range(0, 64, 3)) AS idx) r""", "v_site"))
def x1_context(s: Source) -> DataFrame:
    rows = s.v_site.withColumn("idx", F.explode(F.sequence(F.lit(0), F.lit(63), F.lit(3))))
    return rows.select("site", "idx", seq.context(F.col("seq"), F.col("idx"), 5).alias("context"))


@query("x2_revcomp", oracle("SELECT site, reverse(translate(seq, 'ACGT', 'TGCA')) AS revcomp FROM v_site", "v_site"))
def x2_revcomp(s: Source) -> DataFrame:
    return s.v_site.select("site", seq.reverse_complement(F.col("seq")).alias("revcomp"))


@query("x5_match", oracle("SELECT a.site, b.site AS other, CAST(len(list_filter(range(1, 21), lambda i: substr(a.grna, CAST(i AS INT), 1) = substr(b.seq, CAST(b.pos0_idx + 1 + i AS INT), 1))) AS INT) AS matches FROM v_site a JOIN v_site b ON b.site = a.site + 1", "v_site"))
def x5_match(s: Source) -> DataFrame:
    other = s.v_site.select(F.col("site").alias("other"), F.col("seq").alias("other_seq"), F.col("pos0_idx").alias("zero"))
    rows = s.v_site.withColumn("other", F.col("site") + 1).join(other, "other")
    return rows.select("site", "other", seq.match_count(F.col("grna"), F.col("other_seq"), F.col("zero") + 1).alias("matches"))


@query("x6_core_count", oracle("SELECT site, CAST(length(substr(grna, 4, 4)) - length(replace(substr(grna, 4, 4), 'C', '')) AS INT) AS cs, CAST(length(substr(grna, 5, 3)) - length(replace(substr(grna, 5, 3), 'A', '')) AS INT) AS as_ FROM v_site", "v_site"))
def x6_core_count(s: Source) -> DataFrame:
    return s.v_site.select("site", seq.core_count(F.col("grna"), "C", 4, 7).alias("cs"), seq.core_count(F.col("grna"), "A", 5, 7).alias("as_"))


@query("x9_profile_parse", oracle("SELECT condition, ref, obs, first, last FROM v_cond JOIN (VALUES ('BE4', 'C', 'T', 3, 9), ('BE4', 'C', 'G', 4, 8), ('ABE', 'A', 'G', 3, 8)) AS p(editor, ref, obs, first, last) USING (editor)", "v_cond"))
def x9_profile_parse(s: Source) -> DataFrame:
    return hq.ranges(s)


@query("x10_label", oracle("SELECT site, CAST(idx AS INT) AS idx, CASE WHEN idx < 11 THEN CAST(idx - 11 AS VARCHAR) ELSE '+' || CAST(idx - 10 AS VARCHAR) END AS label FROM v_site, (SELECT unnest(range(0, 20)) AS idx) r", "v_site"))
def x10_label(s: Source) -> DataFrame:
    rows = s.v_site.withColumn("idx", F.explode(F.sequence(F.lit(0), F.lit(19))))
    return rows.select("site", "idx", seq.label(F.col("idx"), 11).alias("label"))


@query("x15_series", oracle("""
SELECT site, CASE WHEN category = 'mismatch' THEN 'Mismatch series' ELSE 'On-target' END AS category, CASE WHEN category = 'mismatch' THEN CAST(site % 3 AS VARCHAR) ELSE 'On-target' END AS subcategory FROM v_site""", "v_site"))
def x15_series(s: Source) -> DataFrame:
    name = F.concat_ws("_", F.lit("site"), (F.col("site") % 3).cast("string"), F.col("site").cast("string"))
    kind, sub = seq.series(name, F.col("category"))
    return s.v_site.select("site", kind.alias("category"), sub.alias("subcategory"))


@query("x17_parse_id", oracle("SELECT site, 'model_' || site AS name, CASE WHEN site % 2 = 0 THEN 0.5 ELSE 1.0 END AS fraction FROM v_site", "v_site"))
def x17_parse_id(s: Source) -> DataFrame:
    text = F.concat(F.lit("model_"), F.col("site").cast("string"), F.when(F.col("site") % 2 == 0, "_0.5").otherwise(""))
    name, fraction = seq.parse_id(text)
    return s.v_site.select("site", name.alias("name"), fraction.alias("fraction"))


@query("m1_level", oracle("""
SELECT condition AS name, 'L1' AS level, condition AS l1_name FROM v_cond UNION ALL SELECT * FROM (VALUES ('g0', 'L2', 'c0'), ('g1', 'L2', 'c1'), ('endo_1', 'endo', 'endo_1')) AS x(name, level, l1_name)""", "v_cond"))
def m1_level(s: Source) -> DataFrame:
    l1 = s.v_cond.select(F.col("condition").alias("name"))
    l2 = s.spark.createDataFrame([("g0", ["c0", "c2"]), ("g1", ["c1", "c3"])], "name string, members array<string>")
    endo = s.spark.createDataFrame([("endo_1",)], "name string")
    dims = dim.levels(l1, l2, endo)
    return dim.resolve(dims.select("name"), dims)


@query("m3_editor_kind", oracle("SELECT condition, editor, CASE WHEN editor = 'BE4' THEN 'CBE' ELSE 'ABE' END AS kind, celltype || '_' || library || '_' || editor AS public_name FROM v_cond WHERE library = '12kChar'", "v_cond"))
def m3_editor_kind(s: Source) -> DataFrame:
    rows = dim.public_subset(dim.without_nuclease(s.v_cond), ["12kChar"], ["mES"], ["BE4", "ABE"])
    return rows.select("condition", "editor", dim.editor_kind(F.col("editor")).alias("kind"), "public_name")


@query("m4_on_target", oracle("SELECT t.condition, t.site, sum(count) AS count FROM (SELECT * FROM v_g4 WHERE role = 'T') t JOIN v_site ON t.site = v_site.site WHERE category <> 'mismatch' GROUP BY ALL", "v_g4", "v_site"))
def m4_on_target(s: Source) -> DataFrame:
    keep = dim.on_target(s.v_site).select("site")
    return pq.sides(s)[0].join(F.broadcast(keep), "site", "left_semi").groupBy("condition", "site").agg(F.sum("count").alias("count"))


@query("m8_endo_match", oracle("""
SELECT e.locus, e.editor, l.library, l.site_name, v.condition FROM (VALUES ('HEK2', 'BE4'), ('HEK3', 'ABE'), ('EMX1', 'BE4')) AS e(locus, editor)
JOIN (VALUES ('HEK2', '12kChar', 's1'), ('HEK2', 'CtoT', 's2'), ('EMX1', 'CtoT', 's9')) AS l(locus, library, site_name) ON e.locus = l.locus JOIN v_cond v ON v.library = l.library AND v.editor = e.editor""", "v_cond"))
def m8_endo_match(s: Source) -> DataFrame:
    endo = s.spark.createDataFrame([("HEK2", "BE4"), ("HEK3", "ABE"), ("EMX1", "BE4")], "locus string, editor string")
    names = s.spark.createDataFrame([("HEK2", "s1", "s2"), ("HEK3", "", ""), ("EMX1", None, "s9")], "locus string, `12kChar` string, CtoT string")
    return dim.library_matches(endo, names, ["12kChar", "CtoT"], s.v_cond).select("locus", "editor", "library", "site_name", "condition")


@query("m2_lookup", oracle("SELECT condition, concat(condition, '_', library, '_', editor) AS name, library FROM v_cond", "v_cond"))
def m2_lookup(s: Source) -> DataFrame:
    """The library of a name whose design row has none, from the known library that the name contains."""
    name = F.concat_ws("_", "condition", "library", "editor")
    found = dim.library_of(name, F.lit(None).cast("string"), ["LibA", "12kChar", "CtoT", "AtoG", "CtoGA", "PAMvar"])
    return s.v_cond.select("condition", name.alias("name"), found.alias("library"))


@query("m7_position", oracle("SELECT site, CAST(idx AS INT) AS idx, CAST(idx - pos0_idx AS INT) AS position FROM v_site, (SELECT unnest(range(0, 64)) AS idx) r", "v_site"))
def m7_position(s: Source) -> DataFrame:
    rows = s.v_site.withColumn("idx", F.explode(F.sequence(F.lit(0), F.lit(63))))
    return rows.select("site", "idx", dim.position(F.col("idx"), F.col("pos0_idx")).cast("int").alias("position"))


@query("x16_logs", oracle("SELECT condition, site, round(log10(ratio + 1), 6) AS log10_ratio, round(CASE WHEN ratio > 0 THEN log2(ratio) END, 6) AS log2_ratio FROM ratios WHERE ratio IS NOT NULL", *V, ctes=ANNOT))
def x16_logs(s: Source) -> DataFrame:
    rows = ratios(s).where("ratio is not null")
    return rounded(rows.select("condition", "site", F.log10(F.col("ratio") + 1).alias("log10_ratio"), F.when(F.col("ratio") > 0, F.log2("ratio")).alias("log2_ratio")))
