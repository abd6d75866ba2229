"""Learners of groups against plain fits of single rows."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from editloom.operators import learners, trees

TEXTS = ["".join(x) for x in itertools.product("ACGT", repeat=3)]


def plain_boosted(x, y, train, classify, count=100, depth=3, step=0.1):
    """Boosting row by row."""
    mean = y[train].mean()
    score = np.full(len(x), np.log(mean / (1 - mean)) if classify else mean)
    for _ in range(count):
        p = 1 / (1 + np.exp(-score)) if classify else score
        left = y - p
        node = np.zeros(len(x), int)
        for _ in range(depth):
            then = node * 2
            for k in np.unique(node):
                here = (node == k) & train
                gains = []
                for f in range(x.shape[1]):
                    one, none = left[here & (x[:, f] == 1)], left[here & (x[:, f] == 0)]
                    gains.append(len(one) * len(none) / (len(one) + len(none)) * (one.mean() - none.mean()) ** 2 if len(one) and len(none) else 0.0)
                if gains and max(gains) > 1e-15:
                    best = next(f for f, g in enumerate(gains) if g >= max(gains) * (1 - 1e-9))
                    then[node == k] += x[node == k, best].astype(int)
            node = then
        for k in np.unique(node):
            here = (node == k) & train
            base = (p * (1 - p))[here].sum() if classify else here.sum()
            if base > 1e-150:
                score[node == k] += step * left[here].sum() / base
    return 1 / (1 + np.exp(-score)) if classify else score


def plain_logistic(x, y, train):
    """Newton's steps with halving, to rest."""
    xt, yt = np.column_stack([x[train], np.ones(train.sum())]), y[train]
    penalty = np.append(np.ones(x.shape[1]), 0.0)
    w = np.zeros(len(penalty))
    loss = lambda w: np.logaddexp(0, xt @ w).sum() - yt @ (xt @ w) + penalty @ w**2 / 2
    for _ in range(100):
        p = 1 / (1 + np.exp(-xt @ w))
        slope = xt.T @ (p - yt) + penalty * w
        if np.abs(slope).max() < 1e-8:
            break
        move, size = np.linalg.solve(xt.T @ (xt * (p * (1 - p))[:, None]) + np.diag(penalty), slope), 1.0
        while size > 1e-10 and loss(w - size * move) > loss(w):
            size /= 2
        w = w - size * move
    return 1 / (1 + np.exp(-np.column_stack([x, np.ones(len(x))]) @ w))


def plain_ridge(x, y, train):
    mean = x[train].mean(0)
    z = x[train] - mean
    w = np.linalg.solve(z.T @ z + np.eye(x.shape[1]), z.T @ (y[train] - y[train].mean()))
    return (x - mean) @ w + y[train].mean()


@pytest.fixture(scope="module")
def rows():
    """Two groups of opposite sense, whose texts repeat, and one of other length; labels and numbers."""
    draw = np.random.default_rng(4)
    out = []
    for g, sign, length in (("one", 1, 3), ("two", -1, 3), ("long", 1, 5)):
        for i in range(260):
            text = "".join(draw.choice(list("ACGT"), length))
            y = sign * (text[0] in "AC") + 0.5 * (text[1] == "G") + draw.normal() * 0.4
            out.append((g, i, text, "test" if i % 4 == 0 else "train", float(y), int(y > 0.3)))
    return out


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "grp string, i int, context string, split string, y double, label int").repartition(5).cache()


def by_group(rows, target):
    for g in sorted({r[0] for r in rows}):
        part = [r for r in rows if r[0] == g]
        x = trees.encoded([r[2] for r in part])
        yield g, part, x, np.array([r[target] for r in part], float), np.array([r[3] == "train" for r in part])


@pytest.mark.parametrize("kind,column,number,plain,close", [
    ("ridge", "y", 4, plain_ridge, 1e-9), ("logistic", "label", 5, plain_logistic, 1e-6),
    ("gbt_regressor", "y", 4, lambda x, y, t: plain_boosted(x, y, t, False, 20), 1e-9), ("gbt_classifier", "label", 5, lambda x, y, t: plain_boosted(x, y, t, True, 20), 1e-9),
])
def test_groups_are_fitted_like_their_rows(frame, rows, kind, column, number, plain, close):
    got = {(r.grp, r.i): r.predicted for r in learners.learn_groups(frame, ["grp"], kind, "context", column, count=20).collect()}
    assert len(got) == len(rows)
    for g, part, x, y, train in by_group(rows, number):
        want = plain(x, y, train)
        assert np.abs(np.array([got[g, r[1]] for r in part]) - want).max() < close


@pytest.mark.parametrize("kind,column", [("gbt_regressor", "y"), ("gbt_classifier", "label")])
def test_trees_of_large_groups_are_those_of_a_worker(frame, kind, column):
    """The same predictions where no group fits a worker, and where some do."""
    told = {}
    for most in (10**9, 0, 64):  # groups of 3 letters have at most 64 cells
        found = learners.learn_groups(frame, ["grp"], kind, "context", column, fit_cells=most, count=4)
        told[most] = {(r.grp, r.i): r.predicted for r in found.collect()}
    for most in (0, 64):
        assert told[most] == pytest.approx(told[10**9], abs=1e-9)


def test_a_group_of_a_million_rows(spark):
    """More cells than a worker takes: grown over all tasks, and what is planted comes out."""
    text = F.translate(F.substring(F.md5(F.col("id").cast("string")), 1, 10), "0123456789abcdef", "ACGTACGTACGTACGT")
    df = spark.range(1_000_000).select(F.lit("g").alias("grp"), "id", text.alias("context"), F.when(F.col("id") % 4 == 0, "test").otherwise("train").alias("split"))
    df = df.withColumn("y", F.when(F.substring("context", 2, 1) == "C", 2.0).otherwise(0.0) + F.when(F.substring("context", 5, 1) == "T", 1.0).otherwise(0.0))
    assert df.select("context").distinct().count() > learners.FIT_CELLS
    found = learners.learn_groups(df, ["grp"], "gbt_regressor", "context", "y", count=2)
    told = {(r.a, r.b): r.p for r in found.groupBy((F.substring("context", 2, 1) == "C").alias("a"), (F.substring("context", 5, 1) == "T").alias("b")).agg(F.avg("predicted").alias("p")).collect()}
    assert found.count() == 1_000_000
    mean = 0.5 + 0.25
    assert told[True, True] == pytest.approx(mean + (3 - mean) * (1 - 0.9**2), abs=0.01) and told[False, False] == pytest.approx(mean * 0.9**2, abs=0.01)


def test_defined_cases(spark):
    """One label alone, no training rows, letters that are none, null targets, and an empty table."""
    schema = "grp string, context string, split string, y double"
    rows = [("same", t, "train", 1.0) for t in TEXTS[:9]] + [("none", t, "test", 0.5) for t in TEXTS[:5]] + [("odd", t.replace("A", "N"), "train", float(i % 2)) for i, t in enumerate(TEXTS)] + [("odd", "CCC", "train", None)]
    df = spark.createDataFrame(rows, schema)
    for kind in ("ridge", "logistic", "gbt_regressor", "gbt_classifier"):
        for most in (10**9, 0) if kind.startswith("gbt") else (0,):
            got = learners.learn_groups(df, ["grp"], kind, "context", "y", fit_cells=most, count=2).collect()
            assert len(got) == len(rows) - 1
            assert all(r.predicted == pytest.approx(1.0) for r in got if r.grp == "same") and all(r.predicted is None for r in got if r.grp == "none")
            assert all(r.predicted is not None for r in got if r.grp == "odd")
        assert learners.learn_groups(df.limit(0), ["grp"], kind, "context", "y").count() == 0


def test_slopes_vanish_and_names(spark, frame):
    table = learners.cells(frame, ["grp"], "context", "label")
    slopes = learners.logistic_slopes(table, ["grp"], learners.logistic_fits(table, ["grp"])).collect()
    assert {r.feature for r in slopes if r.grp == "one"} == {f"{i}{n}" for i in range(3) for n in "ACGT"} | {"intercept"}
    assert max(abs(r.residual) for r in slopes) < 1e-7
    row = spark.createDataFrame([("AXT",), ("",), (None,)], "t string").select(learners.active(F.col("t")).alias("a")).collect()
    assert [r.a for r in row] == [[0, 11], [], None] or [r.a for r in row] == [[0, 11], [], []]


def test_trees_on_bytes_hold_few_features_as_doubles():
    """The same scores as on doubles, in a fraction of the memory that the features take as such."""
    import tracemalloc

    draw = np.random.default_rng(4)
    texts = ["".join(t) for t in draw.choice(list("ACGT"), (40_000, 20))]
    n, y = draw.integers(1, 5, len(texts)).astype(float), draw.random(len(texts))
    tracemalloc.start()
    got = trees.boosted(trees.encoded(texts, kind=np.uint8), n, y, False, 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40_000 * 80 * 8 and np.allclose(got, trees.boosted(trees.encoded(texts), n, y, False, 2), atol=1e-12)


def test_slopes_send_no_row_a_cell_and_feature(spark, frame):
    """What is left at arbitrary coefficients equals a plain sum, and no cell is written out by feature on the way."""
    table = learners.cells(frame, ["grp"], "context", "y").cache()
    draw = np.random.default_rng(7)
    w = {g: draw.normal(size=4 * n + 1) for g, n in (("one", 3), ("two", 3), ("long", 5))}
    fits = spark.createDataFrame([(g, v.tolist()) for g, v in w.items()], "grp string, w array<double>")
    got = learners.ridge_slopes(table, ["grp"], fits, alpha=2.0)
    assert "Generate explode" not in got._jdf.queryExecution().executedPlan().toString()
    found = {(r.grp, r.feature): r.residual for r in got.collect()}
    for g, v in w.items():
        part = [r for r in table.where(F.col("n") > 0).collect() if r.grp == g]
        x = np.column_stack([trees.encoded([r.context for r in part]), np.ones(len(part))])
        left = x.T @ (np.array([r.n for r in part]) * (x @ v) - np.array([r.y for r in part])) + 2.0 * np.append(v[:-1], 0)
        names = [f"{i // 4}{'ACGT'[i % 4]}" for i in range(len(v) - 1)] + ["intercept"]
        assert {f: found[g, f] for f in names if (g, f) in found} == pytest.approx({f: y for f, y, n in zip(names, left, x.sum(0)) if n})


def test_curve_slopes_are_those_of_the_rows_of_each_share(spark, frame):
    """Cells by tenth, met by the fits of later tenths, leave what the cells written out for each share leave."""
    tenths = frame.where("split = 'train'").withColumn("tenths", (F.col("i") % 7 + 2).cast("int"))
    table = learners.cells(tenths, ["grp", "tenths"], "context", "y").cache()
    fits = learners.ridge_curve(table, ["grp"], "tenths", 10).withColumn("w", F.transform("w", lambda b, i: b + i / 10)).cache()
    runs = table.withColumn("tenths", F.explode(F.sequence("tenths", F.lit(10))))
    told = lambda df: {(r.grp, r.tenths, r.feature): r.residual for r in df.collect()}
    assert told(learners.curve_slopes(table, ["grp"], "tenths", 10, fits)) == pytest.approx(told(learners.ridge_slopes(runs, ["grp", "tenths"], fits)))


def test_newton_steps_meet_few_groups_a_task(spark, monkeypatch):
    """The cells of the steps are dealt by ranges of group and text, so that a task's sums do not hold every group."""
    rows = [(f"g{g:02}", t, "train", float((i + g) % 2)) for g in range(24) for i, t in enumerate(TEXTS)]
    table = learners.cells(spark.createDataFrame(rows, "grp string, context string, split string, y double").repartition(4), ["grp"], "context", "y")
    seen, plain = [], learners._solved
    monkeypatch.setattr(learners, "_solved", lambda train, *rest: seen.append(train.groupBy(F.input_file_name()).agg(F.count_distinct("grp").alias("n")).agg(F.max("n")).first()[0]) or plain(train, *rest))
    assert learners.logistic_fits(table, ["grp"]).count() == 24 and max(seen) <= 12


def test_both_models_of_the_rare_fractions_form_their_sets_once(spark, sf, monkeypatch):
    from editloom.plans import models as mq
    from editloom.sources.fixtures import Source

    made, plain = [], mq.rare_sets
    monkeypatch.setattr(mq, "rare_sets", lambda s: made.append(1) or plain(s))
    monkeypatch.setattr(mq.learners, "learn_groups", lambda df, by, kind, *rest, **more: df.select(*by, F.lit(0.0).alias("predicted")))
    got = mq.rare(Source(spark, sf), ["ridge", "gbt_regressor"], "logit")
    assert len(made) == 1 and {r.model for r in got.select("model").distinct().collect()} <= {"ridge", "gbt_regressor"}


def test_opposite_sets_are_stored_before_they_are_scaled(spark, sf):
    from editloom.plans import opposite
    from editloom.sources.fixtures import Source

    assert "lineitem" not in opposite.rows(Source(spark, sf))._jdf.queryExecution().executedPlan().toString()
