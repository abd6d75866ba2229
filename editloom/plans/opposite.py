"""Queries over the opposite-strand training sets (L10) and the collated tables of fits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editloom.functions import seq
from editloom.operators import counts, learners, models, stats, training
from editloom.plans import drivers as dq
from editloom.plans import models as mq
from editloom.plans import positions as pq
from editloom.plans.registry import query, rounded
from editloom.plans.summaries import HASH
from editloom.sources import dimensions as dim
from editloom.sources.fixtures import Source, oracle
from editloom.sources.shared import new_folder, written

GROUP = ["driver", "class", "condition"]
NAMED = HASH.format(x="'0|' || condition || '_' || site || '_' || position || '_' || class") + " % 4"
EARLY = pq.DENSE.replace("v_g4", "v_g4_early") + f""",
driver AS (SELECT * FROM (VALUES {dq.PARAMETERS}) AS x(driver, kind, class, substitution, first, last, radius) WHERE driver LIKE 'opposite%'),
cell AS (SELECT driver, class, f.condition, f.site, CAST(f.position AS INT) AS position, substr(seq, CAST(idx - radius + 1 AS INT), radius) || substr(seq, CAST(idx + 2 AS INT), radius) AS context, CASE WHEN sum(count / total) > 1 - 1e-12 THEN 1.0 ELSE sum(count / total) END AS frequency
  FROM freq f JOIN v_cond v ON f.condition = v.condition JOIN driver d ON d.kind = {dq.KIND} AND d.substitution = ref_nt || '_' || obs_nt AND f.position BETWEEN first AND last
  JOIN v_site ON f.site = v_site.site WHERE idx >= radius AND idx + radius < length(seq) GROUP BY ALL),
scaled AS (SELECT *, CASE WHEN {NAMED} < 3 THEN 'train' ELSE 'test' END AS split,
  CASE WHEN frequency > 0 AND stddev_pop(frequency) FILTER (frequency > 0) OVER w > 0 THEN (frequency - avg(frequency) FILTER (frequency > 0) OVER w) / stddev_pop(frequency) FILTER (frequency > 0) OVER w END AS scaled
  FROM cell WINDOW w AS (PARTITION BY driver, class, condition, position)),
aimed AS (SELECT *, CASE WHEN driver = 'opposite_context' THEN scaled WHEN frequency > 0 AND frequency < 1 THEN ln(frequency / (1 - frequency)) END AS aim,
  CASE WHEN driver = 'opposite_context' THEN context ELSE context || substr('abcde', position + 5, 1) END AS text FROM scaled),
fit AS (SELECT * FROM aimed WHERE aim IS NOT NULL AND split = 'train')"""


def rows(s: Source) -> DataFrame:
    """The opposite strand's sets of all its drivers, with split and the frequency scaled by position."""
    kinds = s.v_cond.select("condition", dim.editor_kind(F.col("editor")).alias("kind"))
    freq = counts.frequencies(counts.dense_cells(s.v_g4_early.where("role = 'T'").drop("role")), depth=100)
    sets = training.training_rows(freq, s.v_site, kinds, [d for d in training.DRIVERS if d[0].startswith("opposite")])
    # Stored, as scaling reads them twice.
    sets = written(sets.withColumn("position", F.col("position").cast("int")), new_folder(s.spark, "opposite"))
    return training.scaled_by_position(sets, GROUP).withColumn("split", models.split(F.concat_ws("_", "condition", "site", "position", "class")))


LETTERS = "ACGTabcde"


def aimed(s: Source) -> DataFrame:
    """``rows`` with ``aim`` and ``text``: one driver fits the scaled frequency on the context alone, the other the logit of frequencies between
    0 and 1 on the context and the position, which stands behind it as a letter of its own."""
    alone = F.col("driver") == "opposite_context"
    place = F.substring(F.lit("abcde"), F.col("position") + 5, F.lit(1))
    return rows(s).withColumns({
        "aim": F.when(alone, F.col("scaled")).otherwise(seq.logit(F.col("frequency"))), "text": F.when(alone, F.col("context")).otherwise(F.concat("context", place)),
    })


@query("l10_opposite_rows", oracle("SELECT driver, class, condition, site, position, text, split, round(frequency, 6) AS frequency, round(scaled, 5) AS scaled, round(aim, 5) AS aim FROM aimed", "v_g4_early", "v_cond", ctes=EARLY))
def l10_opposite_rows(s: Source) -> DataFrame:
    near = {c: F.round(F.col(c) + 1e-10, 5) for c in ("scaled", "aim")}
    return rounded(aimed(s).withColumns(near).drop("context"))


@query("l10_opposite_residuals", oracle("""
SELECT driver, class, condition, CAST(i AS VARCHAR) || substr(text, CAST(i + 1 AS INT), 1) AS feature, 0.0 AS residual FROM fit, (SELECT unnest(range(0, 13)) AS i) r WHERE i < length(text) GROUP BY ALL
UNION ALL SELECT DISTINCT driver, class, condition, 'intercept', 0.0 FROM fit""", "v_g4_early", "v_cond", ctes=EARLY))
def l10_opposite_residuals(s: Source) -> DataFrame:
    """What both drivers' linear fits leave of their normal equations: nothing."""
    table = written(learners.cells(aimed(s), GROUP, "text", "aim"), new_folder(s.spark, "opposite"))
    return rounded(learners.ridge_slopes(table, GROUP, learners.ridge_fits(table, GROUP, LETTERS), LETTERS))


@query("l10_opposite_metrics")
def l10_opposite_metrics(s: Source) -> DataFrame:
    """How ridge and trees tell what the drivers aim at, by driver, class, condition and split."""
    sets = written(aimed(s), new_folder(s.spark, "opposite"))
    told = [learners.learn_groups(sets, GROUP, kind, "text", "aim", LETTERS).withColumn("model", F.lit(kind)) for kind in ("ridge", "gbt_regressor")]
    return stats.correlation(told[0].unionByName(told[1]), "predicted", "aim", ["model", *GROUP, "split"])


MOTIF = ["editor", "class"]
MOTIFS = mq.SETS.replace("train AS MATERIALIZED", "unused AS") + f""",
motif AS (SELECT v.editor, class, condition, site, position, context, frequency, CASE WHEN {NAMED} < 3 THEN 'train' ELSE 'test' END AS split FROM cell JOIN v_cond v USING (condition)
  WHERE driver = 'efficiency' AND frequency > 0 AND frequency < 1)"""


def motif_rows(s: Source) -> DataFrame:
    """The efficiency drivers' rows of frequencies between 0 and 1 by editor, with split and logit."""
    kept = mq.training_sets(s).where("driver = 'efficiency' and frequency > 0 and frequency < 1")
    return kept.join(F.broadcast(s.v_cond.select("condition", "editor")), "condition")


@query("l11_motif_sizes", oracle("""
SELECT editor, class, count(*) AS rows, count(*) FILTER (split = 'train') AS train_rows, count(*) FILTER (split = 'test') AS test_rows, count(DISTINCT site) AS targets,
  count(DISTINCT site) FILTER (split = 'train') AS train_targets, count(DISTINCT site) FILTER (split = 'test') AS test_targets FROM motif GROUP BY ALL""", "v_g4", "v_cond", ctes=MOTIFS))
def l11_motif_sizes(s: Source) -> DataFrame:
    return training.split_counts(motif_rows(s), MOTIF)


@query("l11_motifs", oracle("""
SELECT m.editor, m.class, place, substr(context, CAST(i + 1 AS INT), 1) AS nt, any_value(z.rows) AS rows, any_value(z.targets) AS targets, 0.0 AS residual
FROM motif m, (SELECT i, CASE WHEN i < 10 THEN CAST(i - 10 AS VARCHAR) ELSE '+' || CAST(i - 9 AS VARCHAR) END AS place FROM (SELECT unnest(range(0, 20)) AS i) x) p
JOIN (SELECT editor, class, count(*) AS rows, count(DISTINCT site) AS targets FROM motif GROUP BY ALL) z ON z.editor = m.editor AND z.class = m.class
WHERE split = 'train' GROUP BY ALL""", "v_g4", "v_cond", ctes=MOTIFS))
def l11_motifs(s: Source) -> DataFrame:
    """Each editor's motif table: signed places and nucleotides of its linear fit beside the sizes of its data. Coefficients
    can't be had from SQL; the query gives what they leave of the normal equations, which is nothing."""
    sets = written(motif_rows(s), new_folder(s.spark, "motif"))
    table = written(learners.cells(sets, MOTIF, "context", "logit"), new_folder(s.spark, "motif"))
    left = learners.ridge_slopes(table, MOTIF, learners.ridge_fits(table, MOTIF)).where("feature <> 'intercept'")
    number, nt = F.regexp_extract("feature", r"^\d+", 0).cast("int"), F.regexp_extract("feature", r"[ACGT]$", 0)
    named = left.select(*MOTIF, seq.label(number, 10).alias("place"), nt.alias("nt"), "residual")
    sizes = training.split_counts(sets, MOTIF).select(*MOTIF, "rows", "targets")
    return rounded(named.join(F.broadcast(sizes), MOTIF).select(*MOTIF, "place", "nt", "rows", "targets", "residual"))  # a row an editor and class


VALID = ["editor", "celltype"]


def validation_rows(s: Source) -> DataFrame:
    """The edited fraction's rows of an editor, under its cell type and under all together; a site's rows share a split."""
    held = dq.windows(s).where("total_be >= 100").select("condition", "site", "window", "fraction_edited", "split")
    held = held.join(F.broadcast(s.v_cond.select("condition", *VALID)), "condition")
    return training.with_combined(held).withColumn("logit", seq.logit(F.col("fraction_edited")))


@query("l11_validation")
def l11_validation(s: Source) -> DataFrame:
    """One table of how the edited fraction is told on train and test rows, by editor, cell type (or all) and model."""
    sets = written(validation_rows(s), new_folder(s.spark, "validation"))
    told = [learners.learn_groups(sets, VALID, kind, "window", "logit").withColumn("model", F.lit(kind)) for kind in ("ridge", "gbt_regressor")]
    return stats.correlation(told[0].unionByName(told[1]), "predicted", "logit", ["model", *VALID, "split"])
