"""Queries over features, fits and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from editloom.functions import seq
from editloom.functions.special import hash_int
from editloom.operators import counts, covariate, learners, models, stats
from editloom.plans import drivers as dq
from editloom.plans import positions as pq
from editloom.plans.registry import query, rounded
from editloom.plans.summaries import ANNOT, HASH, V
from editloom.sources.fixtures import Source, oracle
from editloom.sources.shared import new_folder, written

RADIUS = 5
DATA = pq.DENSE + """,
data AS (SELECT f.condition, f.site, CAST(f.idx AS INT) AS idx, f.count / f.total AS frequency, substr(seq, CAST(f.idx - 4 AS INT), 5) || substr(seq, CAST(f.idx + 2 AS INT), 5) AS context,
  CASE WHEN """ + HASH.format(x="'0|' || f.condition || '_' || f.site || '_' || f.idx") + """ % 4 < 3 THEN 'train' ELSE 'test' END AS split
  FROM freq f JOIN v_site ON f.site = v_site.site WHERE ref_nt = 'C' AND obs_nt = 'T' AND f.idx >= 5 AND f.idx + 5 < length(seq))"""


def data(s: Source) -> DataFrame:
    """Frequency of C to T with its local context and split, one row a condition, site and position."""
    freq = counts.frequencies(pq.dense(s), depth=100).where("ref_nt = 'C' and obs_nt = 'T'")
    rows = freq.join(s.v_site.select("site", "seq"), "site").withColumn("context", seq.context(F.col("seq"), F.col("idx"), RADIUS)).where("context is not null")
    name = F.concat_ws("_", "condition", "site", "idx")
    return rows.select("condition", "site", F.col("idx").cast("int").alias("idx"), "frequency", "context", models.split(name).alias("split"), models.one_hot(F.col("context"), 2 * RADIUS).alias("features"))


@query("l1_onehot", oracle("SELECT condition, site, idx, feature, CASE WHEN substr(context, CAST(feature // 4 + 1 AS INT), 1) = substr('ACGT', CAST(feature % 4 + 1 AS INT), 1) THEN 1.0 ELSE 0.0 END AS value FROM data, (SELECT CAST(unnest(range(0, 40)) AS INT) AS feature) r", "v_g4", ctes=DATA))
def l1_onehot(s: Source) -> DataFrame:
    return data(s).select("condition", "site", "idx", F.posexplode("features").alias("feature", "value"))


@query("l2_split", oracle("SELECT condition, site, idx, split FROM data", "v_g4", ctes=DATA))
def l2_split(s: Source) -> DataFrame:
    return data(s).select("condition", "site", "idx", "split")


@query("a30_split_sizes", oracle("SELECT condition, split, count(*) AS rows, count(DISTINCT site) AS sites, CAST(floor(count(*) * 0.9) AS BIGINT) AS train_rows FROM data GROUP BY ALL", "v_g4", ctes=DATA))
def a30_split_sizes(s: Source) -> DataFrame:
    from editloom.operators.summary import split_sizes

    return split_sizes(data(s), "split")


@query("l9_targets", oracle("""
SELECT condition, site, idx, CAST(frequency > 0 AS INT) AS label, round(CASE WHEN frequency > 0 AND frequency < 1 THEN ln(frequency / (1 - frequency)) END, 6) AS logit,
  round((frequency - avg(frequency) OVER w) / nullif(stddev_pop(frequency) OVER w, 0), 5) AS z FROM data WINDOW w AS (PARTITION BY condition, idx)""", "v_g4", ctes=DATA))
def l9_targets(s: Source) -> DataFrame:
    w = Window.partitionBy("condition", "idx")
    z = F.try_divide(F.col("frequency") - F.avg("frequency").over(w), F.stddev_pop("frequency").over(w))
    out = data(s).select("condition", "site", "idx", (F.col("frequency") > 0).cast("int").alias("label"), seq.logit(F.col("frequency")).alias("logit"), F.round(z, 5).alias("z"))
    return rounded(out)


@query("l3_gram", oracle("""
, x AS (SELECT condition AS grp, frequency AS y, list_concat(list_transform(range(0, 40), lambda f: CASE WHEN substr(context, CAST(f // 4 + 1 AS INT), 1) = substr('ACGT', CAST(f % 4 + 1 AS INT), 1) THEN 1.0 ELSE 0.0 END), [1.0, frequency]) AS v FROM data WHERE split = 'train')
SELECT grp AS "group", CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(sum(v[i + 1] * v[j + 1]), 6) AS value FROM x, (SELECT unnest(range(0, 42)) AS i) a, (SELECT unnest(range(0, 42)) AS j) b WHERE i <= j AND v[i + 1] <> 0 AND v[j + 1] <> 0 GROUP BY ALL""", "v_g4", ctes=DATA).replace("\n\n, x AS", ",\nx AS"))
def l3_gram(s: Source) -> DataFrame:
    return rounded(models.gram(data(s).where("split = 'train'"), "condition", "features", "frequency"))


@query("l3_ridge")
def l3_ridge(s: Source) -> DataFrame:
    return models.ridge(data(s).where("split = 'train'"), "condition", "features", "frequency", models.feature_names(2 * RADIUS))


@query("l3_residuals", oracle("""
SELECT condition AS "group", CAST(i // 4 AS VARCHAR) || substr('ACGT', CAST(i % 4 + 1 AS INT), 1) AS feature, 0.0 AS residual FROM data, (SELECT unnest(range(0, 40)) AS i) r
WHERE split = 'train' AND substr(context, CAST(i // 4 + 1 AS INT), 1) = substr('ACGT', CAST(i % 4 + 1 AS INT), 1) GROUP BY ALL UNION ALL SELECT DISTINCT condition, 'intercept', 0.0 FROM data WHERE split = 'train'""", "v_g4", ctes=DATA))
def l3_residuals(s: Source) -> DataFrame:
    """What ridge leaves of its normal equations: nothing."""
    rows, names = data(s).where("split = 'train'"), models.feature_names(2 * RADIUS)
    fit = models.ridge(rows, "condition", "features", "frequency", names)
    return rounded(models.ridge_residuals(rows, "condition", "features", "frequency", names, fit))


GROUP = ["driver", "class", "condition"]


def training_sets(s: Source) -> DataFrame:
    """Rows of all drivers' training sets with split, label and logit."""
    name = F.concat_ws("_", "condition", "site", "position", "class")
    return dq.rows(s).withColumn("split", models.split(name)).withColumns({"label": (F.col("frequency") > 0).cast("int"), "logit": seq.logit(F.col("frequency"))})


def fitted(s: Source, kind: str) -> DataFrame:
    """Rows of all drivers' training sets with predictions, one fit a driver, class and condition: regressors take the
    logit of frequencies between 0 and 1, classifiers tell those above 0."""
    return learners.learn_groups(training_sets(s), GROUP, kind, "context", "logit" if kind in ("ridge", "gbt_regressor") else "label")


#: The rows of ``training_sets``, those with a target alone.
SETS = pq.DENSE + f""",
driver AS (SELECT * FROM (VALUES {dq.PARAMETERS}) AS x(driver, kind, class, substitution, first, last, radius)),
cell AS (SELECT driver, class, f.condition, f.site, position, substr(seq, CAST(idx - radius + 1 AS INT), radius) || substr(seq, CAST(idx + 2 AS INT), radius) AS context, CASE WHEN sum(count / total) > 1 - 1e-12 THEN 1.0 ELSE sum(count / total) END AS frequency
  FROM freq f JOIN v_cond v ON f.condition = v.condition JOIN driver d ON d.kind = {dq.KIND} AND d.substitution = ref_nt || '_' || obs_nt AND f.position BETWEEN first AND last
  JOIN v_site ON f.site = v_site.site WHERE idx >= radius AND idx + radius < length(seq) GROUP BY ALL),
train AS MATERIALIZED (SELECT *, row_number() OVER () AS r FROM cell WHERE """ + HASH.format(x="'0|' || condition || '_' || site || '_' || position || '_' || class") + """ % 4 < 3)"""


@query("l5_residuals", oracle("""
, mixed AS (SELECT driver, class, condition FROM train GROUP BY ALL HAVING min(frequency) <= 0 AND max(frequency) > 0)
SELECT driver, class, condition, feature, 0.0 AS residual FROM mixed JOIN (
  SELECT DISTINCT driver, class, condition, CAST(i AS VARCHAR) || substr(context, CAST(i + 1 AS INT), 1) AS feature FROM train, (SELECT unnest(range(0, 20)) AS i) x WHERE i < length(context)) f USING (driver, class, condition)
UNION ALL SELECT driver, class, condition, 'intercept', 0.0 FROM mixed""", "v_g4", "v_cond", ctes=SETS).replace("\n\n, mixed", ",\nmixed"))
def l5_residuals(s: Source) -> DataFrame:
    """What logistic fits leave of the slope of their penalised loss: nothing."""
    table = written(learners.cells(training_sets(s), GROUP, "context", "label"), new_folder(s.spark, "logistic"))
    return rounded(learners.logistic_slopes(table, GROUP, learners.logistic_fits(table, GROUP)))


def _first_tree_sql(depth: int = 3) -> str:
    """Each level: sums by node and feature, the best split of a node, and the rows below it."""
    out = [
        "target AS MATERIALIZED (SELECT driver, class, condition, r, context, ln(frequency / (1 - frequency)) - avg(ln(frequency / (1 - frequency))) OVER (PARTITION BY driver, class, condition) AS y, 1 AS node FROM train WHERE frequency > 0 AND frequency < 1)",
        "has AS MATERIALIZED (SELECT r, CAST(i * 4 + instr('ACGT', substr(context, CAST(i + 1 AS INT), 1)) - 1 AS INT) AS f FROM target, (SELECT unnest(range(0, 20)) AS i) x WHERE i < length(context))",
        "row0 AS (SELECT * FROM target)",
    ]
    for i in range(depth):
        out += [
            f"whole{i} AS MATERIALIZED (SELECT driver, class, condition, node, CAST(count(*) AS DOUBLE) AS n, sum(y) AS s FROM row{i} GROUP BY ALL)",
            f"part{i} AS (SELECT driver, class, condition, node, f, CAST(count(*) AS DOUBLE) AS n1, sum(y) AS s1 FROM row{i} JOIN has USING (r) GROUP BY ALL)",
            f"gain{i} AS MATERIALIZED (SELECT w.*, f, CASE WHEN n1 < n THEN n1 * (n - n1) / n * pow(s1 / n1 - (s - s1) / (n - n1), 2) ELSE 0 END AS gain FROM whole{i} w JOIN part{i} USING (driver, class, condition, node))",
            f"most{i} AS MATERIALIZED (SELECT driver, class, condition, node, any_value(n) AS n, max(gain) AS gain FROM gain{i} GROUP BY ALL)",
            f"split{i} AS MATERIALIZED (SELECT m.*, CASE WHEN max(m.gain) > {learners.LEAST_GAIN} THEN min(f) END AS f FROM most{i} m JOIN gain{i} g USING (driver, class, condition, node) WHERE g.gain >= m.gain * (1 - {learners.SAME_GAIN}) GROUP BY ALL)",
            f"row{i + 1} AS MATERIALIZED (SELECT t.driver, t.class, t.condition, t.r, t.context, t.y, 2 * t.node + CASE WHEN h.r IS NULL THEN 0 ELSE 1 END AS node FROM row{i} t JOIN split{i} p USING (driver, class, condition, node) LEFT JOIN has h ON h.r = t.r AND h.f = p.f)",
        ]
    picks = " UNION ALL ".join(f"SELECT driver, class, condition, CAST(node AS INT) AS node, CAST(f // 4 AS VARCHAR) || substr('ACGT', CAST(f % 4 + 1 AS INT), 1) AS feature, n, round(gain, 6) AS gain FROM split{i}" for i in range(depth))
    return ",\n".join(out) + "\n" + picks


@query("l4_first_tree", oracle(_first_tree_sql(), "v_g4", "v_cond", ctes=SETS).replace("\ntarget AS", ",\ntarget AS"))
def l4_first_tree(s: Source) -> DataFrame:
    """The splits of each group's first regression tree, from sums by node and feature."""
    table = learners.cells(training_sets(s), GROUP, "context", "logit")
    found = learners.first_tree(table, GROUP)
    return rounded(found.select(*GROUP, "node", F.when(F.col("f").isNotNull(), learners.feature_name(F.col("f"))).alias("feature"), "n", "gain"))


@query("l3_metrics")
def l3_metrics(s: Source) -> DataFrame:
    return stats.correlation(fitted(s, "ridge"), "predicted", "logit", [*GROUP, "split"])


@query("l4_gbtr")
def l4_gbtr(s: Source) -> DataFrame:
    return stats.correlation(fitted(s, "gbt_regressor"), "predicted", "logit", [*GROUP, "split"])


@query("l5_logit")
def l5_logit(s: Source) -> DataFrame:
    return models.classification_metrics(fitted(s, "logistic"), "label", "predicted", [*GROUP, "split"])


@query("l6_gbtc")
def l6_gbtc(s: Source) -> DataFrame:
    return models.classification_metrics(fitted(s, "gbt_classifier"), "label", "predicted", [*GROUP, "split"])


@query("l7_metrics", oracle("""
, scored AS (SELECT condition, CAST(frequency > 0.05 AS DOUBLE) AS y, (""" + HASH.format(x="'p|' || site || '_' || idx") + """ + 0.5) / 4294967296.0 AS p FROM data),
ranked AS (SELECT *, rank() OVER (PARTITION BY condition ORDER BY p) + (count(*) OVER (PARTITION BY condition, p) - 1) / 2.0 AS r, sum(y) OVER d AS hits, count(*) OVER d AS seen
  FROM scored WINDOW d AS (PARTITION BY condition ORDER BY p DESC RANGE UNBOUNDED PRECEDING))
SELECT condition, round((sum(y * r) - sum(y) * (sum(y) + 1) / 2) / nullif(sum(y) * sum(1 - y), 0), 6) AS auc, round(sum(y * hits / seen) / nullif(sum(y), 0), 6) AS average_precision, round(-avg(y * ln(p) + (1 - y) * ln(1 - p)), 6) AS cross_entropy FROM ranked GROUP BY ALL""", "v_g4", ctes=DATA).replace("\n\n, scored AS", ",\nscored AS"))
def l7_metrics(s: Source) -> DataFrame:
    draw = (hash_int(F.concat(F.lit("p|"), F.concat_ws("_", "site", "idx"))) + 0.5) / F.lit(4294967296.0)
    rows = data(s).select("condition", (F.col("frequency") > 0.05).cast("double").alias("y"), draw.alias("p"))
    return rounded(models.classification_metrics(rows, "y", "p", ["condition"]))


RARE = ["fraction", "condition"]
PLACES = range(3, 9)


def rare_sets(s: Source) -> DataFrame:
    """Rows of the outcome fractions of C of the C-to-T editors with split, label and logit, on the context of ten to either side and the
    position, which stands behind it as a letter of its own."""
    from editloom.operators import training
    from editloom.plans.drivers import freq
    from editloom.sources.dimensions import editor_kind

    kinds = s.v_cond.where(editor_kind(F.col("editor")) == "CBE").select("condition")
    rows = training.outcome_fractions(freq(s)).where(F.col("position").isin(*PLACES)).join(F.broadcast(kinds), "condition").join(s.v_site.select("site", "seq", "pos0_idx"), "site")
    place = F.translate(F.col("position").cast("string"), "".join(map(str, PLACES)), "abcdef")
    rows = rows.withColumn("around", seq.context(F.col("seq"), F.col("position") + F.col("pos0_idx"), 10)).where("around is not null")
    rows = rows.select(*RARE, "site", "position", F.concat("around", place).alias("context"), F.col("value").alias("frequency"))
    return rows.withColumn("split", models.split(F.concat_ws("_", "site", "position", "fraction"))).withColumns({"label": (F.col("frequency") > 0).cast("int"), "logit": seq.logit(F.col("frequency"))})


def rare(s: Source, kinds: list[str], target: str) -> DataFrame:
    """Rows of ``rare_sets`` with predictions of each kind of learner, one fit a fraction and condition. The sets are formed once."""
    sets = written(rare_sets(s), new_folder(s.spark, "rare"))
    told = [learners.learn_groups(sets, RARE, kind, "context", target, letters="ACGTabcdef").withColumn("model", F.lit(kind)) for kind in kinds]
    return told[0].unionByName(told[1])


@query("l10_rare_regress")
def l10_rare_regress(s: Source) -> DataFrame:
    return stats.correlation(rare(s, ["ridge", "gbt_regressor"], "logit"), "predicted", "logit", ["model", *RARE, "split"])


@query("l10_rare_classify")
def l10_rare_classify(s: Source) -> DataFrame:
    return models.classification_metrics(rare(s, ["logistic", "gbt_classifier"], "label"), "label", "predicted", ["model", *RARE, "split"])


@query("l11_collate")
def l11_collate(s: Source) -> DataFrame:
    """Coefficients of every condition, with signed position labels, beside the correlation of its fit on the test rows."""
    rows = data(s)
    coefficients = models.ridge(rows.where("split = 'train'"), "condition", "features", "frequency", models.feature_names(2 * RADIUS)).where("feature <> 'intercept'")
    number, nt = F.regexp_extract("feature", r"^\d+", 0).cast("int"), F.regexp_extract("feature", r"[ACGT]$", 0)
    named = coefficients.select("group", seq.label(number, RADIUS).alias("position"), nt.alias("nt"), "coefficient")
    scored = learners.learn_groups(rows.drop("features"), ["condition"], "ridge", "context", "frequency")
    told = stats.correlation(scored.where("split = 'test'"), "predicted", "frequency", ["condition"]).select(F.col("condition").alias("group"), F.col("n").alias("test_rows"), F.col("pearson").alias("test_pearson"))
    return named.join(F.broadcast(told), "group", "left")


CURVE = ["condition", "replicate"]


def curve_rows(s: Source) -> DataFrame:
    """The edited fraction's rows with split, logit and window; a training row also stands in each of three replicates with the tenth, drawn
    by a hash, from which on it is among the training rows."""
    rows = dq.windows(s).where("total_be >= 100").select("condition", "site", "window", "fraction_edited", "split")
    rows = rows.withColumn("logit", seq.logit(F.col("fraction_edited"))).where("logit is not null").withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(2))))
    draw = hash_int(F.concat_ws("|", F.lit("curve"), "replicate", "condition", "site")) * 10 / F.lit(2.0**32)
    return rows.withColumn("tenths", (F.floor(draw) + 1).cast("int"))


def curve_cells(rows: DataFrame) -> DataFrame:
    return learners.cells(rows.where("split = 'train'"), [*CURVE, "tenths"], "window", "logit")


@query("l11_curve")
def l11_curve(s: Source) -> DataFrame:
    """The learning curve of the edited fraction's fit: test correlation by share of the training rows (tenths) and replicate."""
    rows = written(curve_rows(s), new_folder(s.spark, "curve"))
    fits = written(learners.ridge_curve(curve_cells(rows), CURVE, "tenths", 10), new_folder(s.spark, "curve"))
    keys = [*CURVE, "tenths"]
    scored = rows.where("split = 'test'").drop("tenths").join(fits, CURVE).withColumn("predicted", learners.linear(F.col("window"), F.col("w")))
    told = stats.correlation(scored, "predicted", "logit", keys).join(fits.select(*keys, F.col("rows").alias("train_rows")), keys)
    return told.withColumn("fraction", F.col("tenths") / 10).drop("tenths")


@query("l11_curve_residuals", oracle(f"""
, windows AS (SELECT r.condition, r.site, {dq.WINDOW} AS w FROM ratios r JOIN v_site ON r.site = v_site.site WHERE total_be >= 100 AND fraction_edited > 0 AND fraction_edited < 1 AND {HASH.format(x="'0|' || r.condition || '_' || r.site")} % 4 < 3),
runs AS (SELECT condition, CAST(replicate AS INT) AS replicate, CAST(tenths AS INT) AS tenths, w FROM windows, (SELECT unnest(range(0, 3)) AS replicate) a, (SELECT unnest(range(1, 11)) AS tenths) b
  WHERE {HASH.format(x="'curve|' || replicate || '|' || condition || '|' || site")} * 10 / 4294967296.0 < tenths)
SELECT condition, replicate, tenths, CAST(i AS VARCHAR) || substr(w, CAST(i + 1 AS INT), 1) AS feature, 0.0 AS residual FROM runs, (SELECT unnest(range(0, 30)) AS i) r WHERE i < length(w) GROUP BY ALL
UNION ALL SELECT DISTINCT condition, replicate, tenths, 'intercept', 0.0 FROM runs""", *V, "v_site", ctes=ANNOT).replace("\n\n, windows", ",\nwindows"))
def l11_curve_residuals(s: Source) -> DataFrame:
    """What the fits of the learning curve leave of their normal equations on all rows that they were given: nothing."""
    table = written(curve_cells(curve_rows(s)), new_folder(s.spark, "curve"))
    fits = learners.ridge_curve(table, CURVE, "tenths", 10)
    return rounded(learners.curve_slopes(table, CURVE, "tenths", 10, fits))


def mutation_activity(s: Source) -> DataFrame:
    rows = pq.activity(s).withColumn("mutation", F.concat_ws(",", "ref_nt", "position", "obs_nt"))
    return rows.select("condition", "editor", "batch", "mutation", F.col("mean_activity").alias("value"))


@query("t18_covariate")
def t18_covariate(s: Source) -> DataFrame:
    return covariate.covariate_model(mutation_activity(s))


@query("t18_seeds")
def t18_seeds(s: Source) -> DataFrame:
    """The loss of each of ten starts, and which of them is the best."""
    told = covariate.losses(*covariate.covariate_fits(mutation_activity(s)))
    return told.withColumn("best", F.col("loss") == F.min("loss").over(Window.partitionBy()))  # a row a start
