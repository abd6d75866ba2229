"""Hand-sized cases: one row per hazard, worked out by hand."""

import random
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from editloom.operators import batch, counts, covariate, haplotypes, indels, models, stats, summary

G4 = "condition string, site int, idx int, position int, ref_nt string, obs_nt string, count double"
H6 = "condition string, site int, category string, indel_start int, indel_end int, indel_length int, mh_length int, inserted_bases string, count double"


def p_values(spark, values):
    return spark.createDataFrame([("c", i, v) for i, v in enumerate(values)], "condition string, k int, p double")


def accepted(df, mode):
    return [r.accept for r in stats.fdr_flag(df, "p", ["condition"], ["k"], 0.05, mode).orderBy("k").collect()]


@pytest.mark.parametrize("mode", ["pointwise", "step_down", "step_up"])
def test_fdr_of_a_hot_group_over_tasks(spark, mode):
    """One group with nearly all rows, a null group, ties and nulls, against ranks worked out row by row."""
    draw = random.Random(7)
    groups = ["hot"] * 3000 + ["b"] * 40 + [None] * 40
    rows = [(g, i, None if draw.random() < 0.02 else round(draw.random() ** 4, 3)) for i, g in enumerate(groups)]
    df = spark.createDataFrame(rows, "g string, i int, p double").repartition(6)
    want = set()
    for group in ("hot", "b", None):
        held = sorted((p, i) for g, i, p in rows if g == group and p is not None and p <= 0.995)
        ok = [p <= (r + 1) / len(held) * 0.2 for r, (p, _) in enumerate(held)]
        if mode == "step_down":
            ok = [all(ok[: r + 1]) for r in range(len(ok))]
        elif mode == "step_up":
            ok = [any(ok[r:]) for r in range(len(ok))]
        want |= {i for yes, (_, i) in zip(ok, held) if yes}
    told = stats.fdr_flag(df, "p", ["g"], ["i"], 0.2, mode)
    assert told.columns == ["g", "i", "p", "accept"] and told.count() == len(rows)
    assert want and {r.i for r in told.where("accept").collect()} == want


def test_fdr_modes(spark):
    df = p_values(spark, [0.001, 0.04, 0.03, 0.2])
    assert accepted(df, "pointwise") == [True, False, False, False] and accepted(df, "step_down") == [True, False, False, False]
    df = p_values(spark, [0.02, 0.021, 0.9, 0.91, None])
    assert accepted(df, "pointwise") == [False, True, False, False, False]
    assert accepted(df, "step_down") == [False] * 5 and accepted(df, "step_up") == [True, True, False, False, False]
    assert accepted(p_values(spark, [0.024, 0.049, 0.999]), "pointwise") == [True, True, False]  # the last isn't counted in n


def test_subtraction_and_thin_controls(spark):
    t = spark.createDataFrame([("c", 1, 15, 5, "C", "C", 80.0), ("c", 1, 15, 5, "C", "T", 20.0), ("c", 2, 15, 5, "C", "T", 7.0), ("c", 1, 16, 6, "A", "G", 1.0), ("c", 1, 16, 6, "A", "A", 99.0)], G4)
    c = spark.createDataFrame([("c", 1, 15, 5, "C", "C", 45.0), ("c", 1, 15, 5, "C", "T", 5.0), ("c", 2, 15, 5, "C", "C", 0.0), ("c", 1, 16, 6, "A", "G", 10.0), ("c", 1, 16, 6, "A", "A", 90.0)], G4)
    got = {(r.site, r.idx, r.obs_nt): r["count"] for r in counts.subtract(t, c).collect()}
    assert got == {(1, 15, "C"): 80.0, (1, 15, "T"): 10.0, (2, 15, "T"): 7.0, (1, 16, "G"): 0.0, (1, 16, "A"): 99.0}
    wiped = {(r.site, r.idx): r.wiped for r in counts.wipe_high_control(t, c).collect()}
    assert wiped == {(1, 15): True, (2, 15): False, (1, 16): True}


def test_a_removed_cell_propagates_or_is_skipped(spark):
    g4 = spark.createDataFrame([("c", 1, 15, 5, "C", "C", 80.0), ("c", 1, 15, 5, "C", "T", None)], G4)
    assert {r.total for r in counts.frequencies(g4).collect()} == {80.0}
    assert counts.frequencies(g4, depth=1, nan_total="propagate").count() == 0


def test_masking_modes(spark):
    g4 = spark.createDataFrame([("c", 1, 15, 5, "C", "C", 80.0), ("c", 1, 15, 5, "C", "T", 20.0)], G4)
    rules = spark.createDataFrame([("c", 1, 15, "T")], "condition string, site int, idx int, obs_nt string")
    keys = ["condition", "site", "idx", "obs_nt"]
    cells = lambda mode: {r.obs_nt: r["count"] for r in counts.mask(g4, rules, keys, mode).collect()}
    assert cells("zero") == {"C": 80.0, "T": 0.0} and cells("null") == {"C": 80.0, "T": None} and cells("fold") == {"C": 100.0}


def test_haplotypes_only_in_control_go_and_wildtype_stays(spark):
    schema = "condition string, site int, hap map<string,string>, count double"
    t = spark.createDataFrame([("c", 1, {"C6": "C"}, 50.0), ("c", 1, {"C6": "T"}, 50.0)], schema)
    c = spark.createDataFrame([("c", 1, {"C6": "C"}, 180.0), ("c", 1, {"C6": "T"}, 10.0), ("c", 1, {"C6": "G"}, 10.0)], schema)
    assert {r.hap["C6"]: r["count"] for r in haplotypes.subtract(t, c).collect()} == {"C": 50.0, "T": 45.0}


def test_null_signatures_match(spark):
    wild = ("c", 1, "wildtype", None, None, None, None, None)
    cut = ("c", 1, "del", 5, 6, 1, 0, None)
    t, c = spark.createDataFrame([(*wild, 90.0), (*cut, 10.0)], H6), spark.createDataFrame([(*wild, 98.0), (*cut, 2.0)], H6)
    assert {r.category: r["count"] for r in indels.subtract(t, c).collect()} == {"wildtype": 90.0, "del": 8.0}
    assert indels.subtract(t, c.where("category = 'wildtype'")).count() == 2
    assert [r.matched for r in indels.control_explained(t, c).collect()] == [100.0]


def test_indel_anova_zero_fills_only_conditions_with_an_indel_at_the_site(spark):
    wild, a, b = ("wildtype", None, None, None, None, None), ("del", 5, 6, 1, 0, None), ("ins", 5, 6, 1, 0, "A")
    rows = [(c, 1, *wild, 90.0) for c in ("c0", "c1", "c2", "c3", "c4", "c5")]
    rows += [(c, 1, *a, n) for c, n in (("c0", 10.0), ("c1", 12.0), ("c2", 2.0), ("c3", 1.0))] + [("c4", 1, *b, 5.0)]
    conditions = spark.createDataFrame([("c0", "b0"), ("c1", "b0"), ("c2", "b1"), ("c3", "b1"), ("c4", "b1"), ("c5", "b1")], "condition string, batch string")
    tests, _ = batch.indel_batch_effects(spark.createDataFrame(rows, H6), conditions)
    found = {r.category: (r.df_between, r.df_within) for r in tests.collect()}
    assert found["del"] == (1, 3)  # c4 counts as 0, c5 is no observation


def test_islands(spark):
    pool = spark.createDataFrame([("b", p, "C", "T", 1.0) for p in (4, 5, 6, 8, 9)] + [("b", 7, "C", "T", 0.1), ("b", 6, "G", "A", 1.0)], "batch string, position int, ref_nt string, obs_nt string, pool_fraction double")
    assert sorted((r.position, r.ref_nt) for r in batch.drop_islands(pool, "batch").collect()) == [(6, "G"), (8, "C"), (9, "C")]


def test_reduced_single_base_share(spark):
    rows = [("c", 1, "del", 5, 6, 1, 0, None, 60.0), ("c", 1, "del", 5, 8, 3, 0, None, 40.0), ("c", 1, "wildtype", None, None, None, None, None, 10.0)]
    got = {(r.category, r.indel_length): r.reduced for r in indels.reduce_single(spark.createDataFrame(rows, H6)).collect()}
    assert got[("del", 1)] / (got[("del", 1)] + got[("del", 3)]) == pytest.approx(0.3) and got[("wildtype", None)] == 10.0


def test_ridge_is_the_closed_form(spark):
    import numpy as np

    draw = np.random.default_rng(0)
    x, y = draw.standard_normal((40, 3)), draw.standard_normal(40)
    df = spark.createDataFrame([("g", r.tolist(), float(v)) for r, v in zip(x, y)], "g string, x array<double>, y double")
    got = {r.feature: r.coefficient for r in models.ridge(df, "g", "x", "y", ["a", "b", "c"]).collect()}
    mean = x.mean(0)
    want = np.linalg.solve((x - mean).T @ (x - mean) + np.eye(3), (x - mean).T @ (y - y.mean()))
    assert [got["a"], got["b"], got["c"]] == pytest.approx(want.tolist()) and got["intercept"] == pytest.approx(y.mean() - mean @ want)


def test_two_way_recovers_an_additive_model(spark):
    from math import exp

    rows = [(e, b, exp({"x": 1.0, "y": 2.0}[e] + {"p": 0.0, "q": 0.5}[b])) for e in "xy" for b in "pq"]
    got = {r.level: r.coefficient for r in models.two_way(spark.createDataFrame(rows, "e string, b string, v double"), "v", ("e", "b")).collect()}
    assert got["y"] - got["x"] == pytest.approx(1.0) and got["q"] - got["p"] == pytest.approx(0.5)


def test_covariate_model_lowers_the_error(spark):
    rows = [(c, e, b, m, v) for c, e, b in (("c0", "x", "p"), ("c1", "x", "q"), ("c2", "y", "p")) for m, v in (("m1", 0.3), ("m2", 0.05))]
    data = spark.createDataFrame(rows, "condition string, editor string, batch string, mutation string, value double")

    def error(steps):
        p = {(r.kind, r.key): r.value for r in covariate.covariate_model(data, steps=steps).collect()}
        return sum((p["a", c] ** 2 * p["e", f"{e}|{m}"] ** 2 + p["b", f"{b}|{m}"] ** 2 + p["g", "all"] ** 2 - v) ** 2 for c, e, b, m, v in rows)

    assert error(6) < error(1)


def covariate_error(data, fit):
    p = {(r.kind, r.key): r.value for r in fit.collect()}
    cells = [(r.value, p["a", r.condition], p["e", f"{r.editor}|{r.mutation}"], p["b", f"{r.batch}|{r.mutation}"], p["g", "all"]) for r in data.collect()]
    return sum((a**2 * e**2 + b**2 + g**2 - v) ** 2 for v, a, e, b, g in cells) / len(cells)


def test_covariate_model_fits_data_of_its_own_form(spark):
    rows = [(f"c{i}", "xy"[i % 2], "pq"[i // 2 % 2], f"m{j}", (0.3 + 0.1 * i) * (0.2 + 0.1 * j) + 0.02 * (i // 2 % 2) * j + 0.05) for i in range(8) for j in range(6)]
    data = spark.createDataFrame(rows, "condition string, editor string, batch string, mutation string, value double")
    assert covariate_error(data, covariate.covariate_model(data)) < 1e-6


def test_covariate_model_takes_equal_steps_at_any_size(spark):
    rows = [(c, e, b, m, v) for c, e, b in (("c0", "x", "p"), ("c1", "x", "q"), ("c2", "y", "p")) for m, v in (("m1", 0.3), ("m2", 0.05), ("m2", 0.15))]
    data = spark.createDataFrame(rows, "condition string, editor string, batch string, mutation string, value double")
    one, many = ({(r.kind, r.key): r.value for r in covariate.covariate_model(data, steps=3, fit_cells=n).collect()} for n in (covariate.FIT_CELLS, 0))
    assert one == pytest.approx(many, abs=1e-12)


def test_covariate_runs_go_on_from_their_snapshots(spark, tmp_path, monkeypatch):
    rows = [(f"c{i}", "xy"[i % 2], "pq"[i // 2 % 2], f"m{j}", 0.1 * i + 0.03 * j) for i in range(4) for j in range(3) for _ in range(2)]
    data = spark.createDataFrame(rows, "condition string, editor string, batch string, mutation string, value double")
    plain = lambda state: {(r.seed, r.kind, r.key): (r.p, r.m, r.v) for r in state.collect()}
    whole = plain(covariate.covariate_fits(data, 3, steps=8, every=8)[0])
    real, calls = covariate._kept, []

    def killed(df, path):
        calls.append(path)
        if path.endswith("step-6"):
            df.limit(1).write.parquet(path + "/_temporary")  # a part of a snapshot
            raise RuntimeError("killed")
        return real(df, path)

    for most in (covariate.FIT_CELLS, 0):
        folder = f"file://{tmp_path}/{most}"
        monkeypatch.setattr(covariate, "_kept", killed)
        with pytest.raises(RuntimeError):
            covariate.covariate_fits(data, 3, steps=8, every=3, folder=folder, fit_cells=most)
        monkeypatch.setattr(covariate, "_kept", real)
        assert covariate.last_step(spark, folder) == (3 if most else 5)
        again = plain(covariate.covariate_fits(data.limit(0), 3, steps=8, every=3, folder=folder, fit_cells=most)[0])
        assert {k: pytest.approx(v, rel=1e-9, abs=1e-12) for k, v in whole.items()} == again
    assert plain(covariate.covariate_fits(data.limit(0), 2)[0]) == {}


def test_covariate_losses_are_those_of_the_rows(spark):
    rows = [(f"c{i}", "xy"[i % 2], "pq"[i // 2], f"m{j}", 0.1 * i + 0.03 * j + 0.01 * k) for i in range(4) for j in range(3) for k in range(2)]
    data = spark.createDataFrame(rows, "condition string, editor string, batch string, mutation string, value double")
    state, cells = covariate.covariate_fits(data, 2, steps=3)
    for r in covariate.losses(state, cells).collect():
        p = {(x.kind, x.key): x.p for x in state.where(F.col("seed") == r.seed).collect()}
        want = sum((p["a", c] ** 2 * p["e", f"{e}|{m}"] ** 2 + p["b", f"{b}|{m}"] ** 2 + p["g", "all"] ** 2 - v) ** 2 for c, e, b, m, v in rows) / len(rows)
        assert r.loss == pytest.approx(want) and r.rows == len(rows)


def test_covariate_query_takes_the_reference_number_of_steps(spark, sf):
    from editloom.plans import models as plans
    from editloom.plans import positions as pq
    from editloom.sources.fixtures import Source

    s = Source(spark, sf)
    data = pq.activity(s).withColumn("mutation", F.concat_ws(",", "ref_nt", "position", "obs_nt")).withColumn("value", F.col("mean_activity")).where("value is not null").cache()
    fit = plans.t18_covariate(s)
    assert fit.orderBy("kind", "key").collect() == covariate.covariate_model(data, steps=1200, step_size=0.1).orderBy("kind", "key").collect()
    assert covariate_error(data, fit) < 0.5 * covariate_error(data, covariate.covariate_model(data, steps=8, step_size=0.05))


def test_bootstraps_cover_their_mean(spark):
    df = spark.createDataFrame([("c", i, float(i % 7)) for i in range(60)], "condition string, k int, v double")
    for found in (stats.bootstrap(df, "v", ["condition"], ["k"], 100), stats.bootstrap_poisson(df, "v", ["condition"], ["k"], 100)):
        row = found.first()
        mean = df.agg(F.avg("v")).first()[0]
        assert row.p025 <= row.p16 <= mean <= row.p84 <= row.p975


def test_bootstrap_of_the_median_is_not_moved_by_an_outlier(spark):
    df = spark.createDataFrame([("c", i, 1e6 if i == 0 else float(i % 7)) for i in range(60)], "condition string, k int, v double")
    row = stats.bootstrap(df, "v", ["condition"], ["k"], 100, kind="median").first()
    assert 1 <= row.p025 <= row.p16 <= 3 <= row.p84 <= row.p975 <= 5


def test_bootstrap_queries_draw_as_often_as_the_reference(spark, sf, monkeypatch):
    from editloom.plans import registry

    asked = {}
    real = stats.bootstrap, stats.bootstrap_poisson
    monkeypatch.setattr(stats, "bootstrap", lambda *a, **k: asked.__setitem__(k.get("kind", "mean"), k["replicates"]) or real[0](*a, **k))
    monkeypatch.setattr(stats, "bootstrap_poisson", lambda *a, **k: asked.__setitem__("poisson", k["replicates"]) or real[1](*a, **k))
    for name in ("t12_mean", "t12_gmean", "t12_median", "t12_bootstrap_poisson"):
        registry.queries()[name](spark, sf)
    assert asked == {"mean": 5000, "gmean": 10000, "median": 10000, "poisson": 5000}


def test_rows_do_not_depend_on_partitions(spark):
    t = spark.createDataFrame([("c", s, 15, 5, "C", o, float(10 * s + len(o))) for s in range(9) for o in "CTG"], G4)
    c = t.withColumn("count", F.col("count") / 3 + F.col("site"))
    one = sorted(map(tuple, counts.subtract(t.coalesce(1), c.coalesce(1)).collect()))
    assert one == sorted(map(tuple, counts.subtract(t.repartition(8), c.repartition(8)).collect()))


def test_pairs_and_folds(spark):
    df = spark.createDataFrame([("c0", 1, 2.0), ("c1", 1, 8.0), ("c0", 2, None)], "condition string, site int, v double")
    pairs = spark.createDataFrame([("c0", "c1")], "rep1 string, rep2 string")
    assert [(r.difference, r.log2_fold) for r in summary.replicates(df, pairs, ["site"], "v").collect()] == [(6.0, 2.0)]
    assert {r.site: r.row_mean for r in summary.fold(df, ["site"], "v", ["c0", "c1"]).collect()} == {1: 5.0, 2: None}


@pytest.mark.parametrize("mode", ["pointwise", "step_down", "step_up"])
def test_global_fdr_equals_the_window_form(spark, mode):
    draw = random.Random(4)
    values = [(i, draw.choice([None, 0.999, 0.001, draw.random() ** 3, draw.random() / 50])) for i in range(300)]
    df = spark.createDataFrame(values, "i int, p double").repartition(3)
    want = {r.i for r in stats.fdr_flag(df.withColumn("all", F.lit(1)), "p", ["all"], ["i"], 0.2, mode).where("accept").collect()}
    rows = stats.fdr_global(df, "p", ["i"], 0.2, mode).collect()
    assert {r.i for r in rows if r.accept} == want and len(rows) == 300 and want
    assert stats.fdr_global(df.where("p > 0.995"), "p", ["i"], 0.2, mode).where("accept").count() == 0


def test_error_tail_takes_the_quality_of_each_side(spark):
    rows = [("c", 1, 15, 5, "C", "C", 198.0), ("c", 1, 15, 5, "C", "T", 2.0), ("c", 2, 15, 5, "C", "C", 99.0), ("c", 2, 15, 5, "C", "G", 1.0)]
    t = spark.createDataFrame(rows, "condition string, site long, idx int, position int, ref_nt string, obs_nt string, count double")
    quality = spark.createDataFrame([(1, 15, 20, 30)], "site long, idx int, t_quality int, c_quality int")
    pmf = lambda j, n, p: comb(n, j) * p**j * (1 - p) ** (n - j)
    tail = lambda k, n, tp, cp: sum(pmf(i, n, cp) * sum(pmf(j, n, tp) for j in range(i + k, n + 1)) for i in range(n + 1))
    got = {r.site: r.p_value for r in stats.sequencing_error(t, quality).collect()}
    assert abs(got[1] - tail(2, 200, 1e-2, 1e-3)) < 1e-5 and abs(got[2] - tail(1, 100, 1e-3, 1e-3)) < 1e-5


@pytest.mark.parametrize("keys", [["site", "idx"], ["condition", "site", "idx"]])
def test_qualities_are_not_broadcast(spark, keys):
    """They grow with the sites; counts and qualities are shuffled once each, by what both share."""
    rows = [("c", i, 15 + i % 7, 5, "C", "T", 2.0) for i in range(9)]
    t = spark.createDataFrame(rows, "condition string, site long, idx int, position int, ref_nt string, obs_nt string, count double")
    quality = t.selectExpr(*keys, "20 t_quality", "30 c_quality")
    plan = stats.sequencing_error(t, quality)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("Exchange hashpartitioning") == 2


def test_ridge_of_groups_against_numpy(spark):
    draw = np.random.default_rng(1)
    x = (draw.random((120, 5)) < 0.4).astype(float)
    x[:60, 4] = 0  # a feature that the first group lacks
    y = x @ [1.0, -2.0, 0.5, 0.0, 3.0] + draw.standard_normal(120)
    df = spark.createDataFrame([("ab"[i >= 60], x[i].tolist(), float(y[i])) for i in range(120)], "g string, x array<double>, y double").repartition(4)
    names = list("vwxyz")
    fit = models.ridge(df, "g", "x", "y", names)
    got = {(r.group, r.feature): r.coefficient for r in fit.collect()}
    assert ("a", "z") not in got and len(got) == 11
    for g, part in (("a", slice(0, 60)), ("b", slice(60, 120))):
        has = [i for i in range(5) if (g, names[i]) in got]
        z = np.column_stack([x[part][:, has], np.ones(60)])
        want = np.linalg.solve(z.T @ z + np.diag([1.0] * len(has) + [0.0]), z.T @ y[part])
        assert np.allclose([got[g, names[i]] for i in has] + [got[g, "intercept"]], want)
    left = models.ridge_residuals(df, "g", "x", "y", names, fit).collect()
    assert len(left) == 11 and max(abs(r.residual) for r in left) < 1e-9


def test_indels_tied_but_for_rounding_are_ranked_by_site(spark):
    shares = [0.1, 0.1 + 1 / 30, 0.2, 0.3, 0.15, 0.25]
    rows = [(f"c{i}", s, kind, *((7, 8, 1, 0, "T") if kind == "ins" else (None,) * 5), scale * (x if kind == "ins" else 1 - x)) for s, scale in enumerate((1.0, 3.0, 7.0, 0.1, 0.3, 11.0, 1 / 3, 0.7)) for i, x in enumerate(shares) for kind in ("ins", "wildtype")]
    df = spark.createDataFrame(rows, "condition string, site long, category string, indel_start int, indel_end int, indel_length int, mh_length int, inserted_bases string, count double")
    conditions = spark.createDataFrame([(f"c{i}", f"b{i // 2}") for i in range(6)], "condition string, batch string")
    p = [r.p_value for r in batch.indel_anova(df, conditions).collect()]
    assert len(p) == 8 and max(p) - min(p) < 1e-12
    tests, found = batch.indel_batch_effects(df, conditions, alpha=p[0] * 8 / 4.5)
    assert {r.site for r in tests.where("accept").collect()} == {4, 5, 6, 7} == {r.site for r in found.collect()}
