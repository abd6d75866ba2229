"""Queries over training sets, their fits, and the smaller selections that feed them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editloom.functions import seq
from editloom.operators import counts, haplotypes, models, training
from editloom.plans import haplotypes as hq
from editloom.plans import positions as pq
from editloom.plans.registry import query, rounded
from editloom.plans.summaries import ANNOT, HASH, V, ratios
from editloom.sources import dimensions as dim
from editloom.sources.fixtures import Source, oracle

KIND = "CASE WHEN editor = 'BE4' THEN 'CBE' ELSE 'ABE' END"
PARAMETERS = ", ".join(f"('{d}', '{k}', '{c}', '{s}', {lo}, {hi}, {r})" for d, k, c, subs, lo, hi, r in training.DRIVERS for s in subs)
WINDOW = "substr(seq, CAST(pos0_idx - 8 AS INT), 30)"


def freq(s: Source) -> DataFrame:
    return counts.frequencies(pq.dense(s), depth=100)


def rows(s: Source) -> DataFrame:
    kinds = s.v_cond.select("condition", dim.editor_kind(F.col("editor")).alias("kind"))
    return training.training_rows(freq(s), s.v_site, kinds)


@query("l10_training_rows", oracle(f"""
, driver AS (SELECT * FROM (VALUES {PARAMETERS}) AS x(driver, kind, class, substitution, first, last, radius))
SELECT driver, class, f.condition, f.site, CAST(f.position AS INT) AS position, substr(seq, CAST(idx - radius + 1 AS INT), radius) || substr(seq, CAST(idx + 2 AS INT), radius) AS context, round(sum(count / total), 6) AS frequency
FROM freq f JOIN v_cond v ON f.condition = v.condition JOIN driver d ON d.kind = {KIND} AND d.substitution = ref_nt || '_' || obs_nt AND f.position BETWEEN first AND last
JOIN v_site ON f.site = v_site.site WHERE idx >= radius AND idx + radius < length(seq) GROUP BY ALL""", "v_g4", "v_cond", ctes=pq.DENSE).replace("\n\n, driver", ",\ndriver"))
def l10_training_rows(s: Source) -> DataFrame:
    return rounded(rows(s).withColumn("position", F.col("position").cast("int")))


@query("l10_fits")
def l10_fits(s: Source) -> DataFrame:
    """Ridge coefficients of the logit of frequencies between 0 and 1, by driver, class and condition, on the driver's own
    context with the position; l3_metrics tells how such fits do."""
    name = F.concat_ws("_", "condition", "site", "position", "class")
    sets = rows(s).withColumn("split", models.split(name)).where("split = 'train'").withColumn("logit", seq.logit(F.col("frequency")))
    places = range(-4, 9)
    sets = sets.withColumn("features", training.with_position(models.one_hot(F.col("context"), 20), F.col("position"), places))
    sets = sets.withColumn("group", F.concat_ws("|", "driver", "class", "condition"))
    return models.ridge(sets, "group", "features", "logit", [*models.feature_names(20), *[f"at {p}" for p in places]])


WIDE = "wide AS (SELECT condition, site, position, " + ", ".join(f"coalesce(avg(count / total) FILTER (obs_nt = '{n}'), 0) AS c_{n.lower()}" for n in "AGT") + " FROM freq WHERE ref_nt = 'C' AND obs_nt <> 'C' GROUP BY ALL)"


@query("r2_pivot_fill", oracle("SELECT condition, site, position, round(c_a, 6) AS c_a, round(c_g, 6) AS c_g, round(c_t, 6) AS c_t FROM wide", "v_g4", ctes=pq.DENSE + ",\n" + WIDE))
def r2_pivot_fill(s: Source) -> DataFrame:
    wide = training.pivot_substitutions(freq(s))
    return rounded(wide.withColumnsRenamed({c: c.lower() for c in wide.columns}))


@query("l10_outcome_fractions", oracle("""
SELECT condition, site, position, fraction, round(value, 6) AS value FROM (
  SELECT condition, site, position, unnest(['C_GA_over_C_D', 'C_T_over_C_D', 'C_G_over_C_D', 'C_A_over_C_D', 'C_G_over_C_GA']) AS fraction,
    unnest([(c_g + c_a) / nullif(c_t + c_g + c_a, 0), c_t / nullif(c_t + c_g + c_a, 0), c_g / nullif(c_t + c_g + c_a, 0), c_a / nullif(c_t + c_g + c_a, 0), c_g / nullif(c_a + c_g, 0)]) AS value
  FROM wide) x WHERE value IS NOT NULL""", "v_g4", ctes=pq.DENSE + ",\n" + WIDE))
def l10_outcome_fractions(s: Source) -> DataFrame:
    return rounded(training.outcome_fractions(freq(s)))


def windows(s: Source) -> DataFrame:
    """Sites with their 30-base window, edited fraction, ratio and split."""
    sites = s.v_site.select("site", seq.window30(F.col("seq"), F.col("pos0_idx")).alias("window"))
    return ratios(s).join(sites, "site").withColumn("split", models.split(F.concat_ws("_", "condition", "site")))


@query("l10_windows", oracle(f"""
SELECT r.condition, r.site, {WINDOW} AS "window", round(fraction_edited, 6) AS fraction_edited, round(CASE WHEN ratio > 0 THEN log10(ratio) END, 6) AS log10_ratio,
  CASE WHEN {HASH.format(x="'0|' || r.condition || '_' || r.site")} % 4 < 3 THEN 'train' ELSE 'test' END AS split,
  CAST(length({WINDOW}) - length(replace({WINDOW}, 'C', '')) AS DOUBLE) AS num_c FROM ratios r JOIN v_site ON r.site = v_site.site""", *V, "v_site", ctes=ANNOT))
def l10_windows(s: Source) -> DataFrame:
    features = training.window_features(F.col("window"))
    log10_ratio = F.when(F.col("ratio") > 0, F.log10("ratio")).alias("log10_ratio")
    return rounded(windows(s).select("condition", "site", "window", "fraction_edited", log10_ratio, "split", F.element_at(features, 122).alias("num_c")))


def _window_fit(s: Source, target: str, kept: str) -> DataFrame:
    sets = windows(s).where("split = 'train'").where(kept).withColumn("features", training.window_features(F.col("window")))
    return models.ridge(sets.withColumn("y", F.expr(target)), "condition", "features", "y", training.window_names())


@query("l10_anyedit_fits")
def l10_anyedit_fits(s: Source) -> DataFrame:
    return _window_fit(s, "fraction_edited", "total_be >= 100")


@query("l10_ratio_fits")
def l10_ratio_fits(s: Source) -> DataFrame:
    return _window_fit(s, "log10(ratio)", "ratio > 0")


@query("f15_by_label", oracle("SELECT t.condition, t.site, sum(count) AS count FROM t JOIN v_site ON t.site = v_site.site WHERE category = 'satmut' GROUP BY ALL", "v_g4", "v_site", ctes=pq.SIDES))
def f15_by_label(s: Source) -> DataFrame:
    kept = training.labelled(pq.sides(s)[0], s.v_site, ["satmut", "mismatch"], without=["mismatch"])
    return kept.groupBy("condition", "site").agg(F.sum("count").alias("count"))


@query("f17_prefix", oracle("SELECT condition, site, round(ratio, 6) AS obs_ratio, round(indel_freq, 6) AS obs_indel_freq FROM ratios", *V, ctes=ANNOT))
def f17_prefix(s: Source) -> DataFrame:
    return rounded(training.with_prefix(ratios(s).select("condition", "site", "ratio", "indel_freq"), "obs_", ["condition", "site"]))


@query("f2_positions", oracle("SELECT condition, position, sum(count) AS count FROM t WHERE position NOT IN (5, 9, 21, 22, 23) GROUP BY ALL", "v_g4", ctes=pq.SIDES))
def f2_positions(s: Source) -> DataFrame:
    return training.reliable(pq.sides(s)[0], (5, 9, 21, 22, 23)).groupBy("condition", "position").agg(F.sum("count").alias("count"))


@query("j9_design_stats", oracle("""
SELECT coalesce(v.condition, a.condition) AS condition, coalesce(v.site, a.site) AS site, category, round(fraction_edited, 6) AS fraction_edited, v.site IS NOT NULL AS designed, a.site IS NOT NULL AS measured
FROM (SELECT condition, site, category FROM v_site, v_cond WHERE category = 'satmut') v FULL JOIN annot a ON v.site = a.site AND v.condition = a.condition""", *V, "v_site", ctes=ANNOT))
def j9_design_stats(s: Source) -> DataFrame:
    found = haplotypes.annotate(hq.reads(s)).select("condition", "site", "fraction_edited")
    design = s.v_site.where("category = 'satmut'").select("site", "category").join(F.broadcast(s.v_cond.select("condition")))
    return rounded(training.design_stats(design, found, ["condition", "site"]))


@query("a23_name_counts", oracle("SELECT driver_split AS split, count(*) AS rows, count(DISTINCT site) AS sites, count(DISTINCT condition) AS conditions FROM (SELECT *, CASE WHEN " + HASH.format(x="'0|' || condition || '_' || site") + " % 4 < 3 THEN 'train' ELSE 'test' END AS driver_split FROM ratios) x GROUP BY ALL", *V, ctes=ANNOT))
def a23_name_counts(s: Source) -> DataFrame:
    return windows(s).groupBy("split").agg(F.count("*").alias("rows"), F.count_distinct("site").alias("sites"), F.count_distinct("condition").alias("conditions"))


@query("x11_error_rate", oracle("SELECT position, ref_nt, round(avg(pow(10.0, -coalesce(CASE WHEN site % 3 = 0 THEN NULL ELSE 20.0 + position END, 30.0) / 10)), 8) AS error_rate FROM t GROUP BY ALL", "v_g4", ctes=pq.SIDES))
def x11_error_rate(s: Source) -> DataFrame:
    quality = F.when(F.col("site") % 3 != 0, 20.0 + F.col("position"))
    return rounded(pq.sides(s)[0].groupBy("position", "ref_nt").agg(F.avg(training.error_rate(quality)).alias("error_rate")), 8)


@query("x12_edit_counts", oracle("SELECT condition, site, edits, sum(count) AS count FROM reads WHERE side = 'T' GROUP BY ALL", "v_g5_long", ctes=hq.LONG))
def x12_edit_counts(s: Source) -> DataFrame:
    return hq.reads(s).withColumn("edits", seq.n_edits(F.col("hap"))).groupBy("condition", "site", "edits").agg(F.sum("count").alias("count"))


@query("x14_run_length", oracle("SELECT site, CAST(i AS INT) AS idx, CAST(length(regexp_extract(substr(seq, 1, CAST(i + 1 AS INT)), 'C*$')) AS INT) AS run FROM v_site, (SELECT unnest(range(0, 64)) AS i) r", "v_site"))
def x14_run_length(s: Source) -> DataFrame:
    places = s.v_site.withColumn("idx", F.explode(F.sequence(F.lit(0), F.lit(63))))
    return places.select("site", "idx", seq.run_length(F.col("seq"), F.col("idx")).cast("int").alias("run"))


@query("x18_names", oracle("SELECT site || '_' || position || '_' || ref_nt || '_' || obs_nt AS name, count(*) AS conditions FROM t GROUP BY ALL", "v_g4", ctes=pq.SIDES))
def x18_names(s: Source) -> DataFrame:
    return pq.sides(s)[0].groupBy(F.concat_ws("_", "site", "position", "ref_nt", "obs_nt").alias("name")).agg(F.count("*").alias("conditions"))


@query("s11_available", oracle("SELECT role, v.condition, editor, count(*) AS cells FROM v_cond v JOIN v_g4 g ON v.condition = g.condition GROUP BY ALL", "v_cond", "v_g4"))
def s11_available(s: Source) -> DataFrame:
    cells = s.v_g4.groupBy("role", "condition").agg(F.count("*").alias("cells"))
    return cells.join(F.broadcast(s.v_cond.select("condition", "editor")), "condition").select("role", "condition", "editor", "cells")


@query("m9_kinds", oracle(f"SELECT {KIND} AS kind, library, count(*) AS conditions FROM v_cond WHERE condition NOT LIKE '%Cas9%' GROUP BY ALL", "v_cond"))
def m9_kinds(s: Source) -> DataFrame:
    kept = dim.without_nuclease(s.v_cond)
    return kept.groupBy(dim.editor_kind(F.col("editor")).alias("kind"), "library").agg(F.count("*").alias("conditions"))
