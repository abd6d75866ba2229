"""Training sets on hand-made cells."""

import pytest
from pyspark.sql import functions as F

from editloom.operators import models, training

CELLS = "condition string, site long, idx int, position int, ref_nt string, obs_nt string, frequency double"


def cells(spark, rows):
    return spark.createDataFrame(rows, CELLS)


def test_training_rows_take_kind_position_class_and_whole_contexts(spark):
    found = cells(spark, [
        ("c0", 1, 2, 3, "C", "T", 0.5), ("c0", 1, 2, 3, "C", "G", 0.25), ("c0", 1, 2, 9, "C", "T", 0.9), ("c0", 1, 1, 3, "C", "T", 0.1), ("c1", 1, 2, 3, "C", "T", 0.7), ("c9", 1, 2, 3, "C", "T", 0.7),
    ])
    sites = spark.createDataFrame([(1, "AACGT")], "site long, seq string")
    kinds = spark.createDataFrame([("c0", "CBE"), ("c1", "ABE")], "condition string, kind string")
    drivers = [("d", "CBE", "C_T", ["C_T"], 3, 8, 2), ("d", "CBE", "C_TG", ["C_T", "C_G"], 3, 8, 2)]
    got = {(r["class"], r.condition, r.context): r.frequency for r in training.training_rows(found, sites, kinds, drivers).collect()}
    assert got == {("C_T", "c0", "AAGT"): 0.5, ("C_TG", "c0", "AAGT"): 0.75}
    assert training.training_rows(found.limit(0), sites, kinds, drivers).count() == 0


def test_outcome_fractions_leave_out_fractions_of_nothing(spark):
    found = cells(spark, [("c0", 1, 2, 3, "C", "T", 0.5), ("c0", 1, 2, 3, "C", "C", 0.5), ("c0", 2, 2, 3, "C", "G", 0.1), ("c0", 2, 2, 3, "C", "A", 0.3), ("c0", 3, 2, 3, "C", "T", 0.0)])
    got = {(r.site, r.fraction): round(r.value, 9) for r in training.outcome_fractions(found).collect()}
    assert {k: v for k, v in got.items() if k[0] == 1} == {(1, "C_GA_over_C_D"): 0, (1, "C_T_over_C_D"): 1, (1, "C_G_over_C_D"): 0, (1, "C_A_over_C_D"): 0}
    assert got[2, "C_G_over_C_GA"] == 0.25 and got[2, "C_GA_over_C_D"] == 1
    assert not any(k[0] == 3 for k in got)


def test_features_count_and_place(spark):
    row = spark.createDataFrame([("ACCA", 4)], "w string, p int").select(
        training.window_features(F.col("w"), 4).alias("f"), training.with_position(F.array(F.lit(2.0)), F.col("p"), range(3, 6)).alias("g")
    ).first()
    assert row.f == [1, 0, 0, 0, 0, 1, 0, 0, 0, 1, 0, 0, 1, 0, 0, 0, 2, 2, 0, 0] and row.g == [2, 0, 1, 0]
    assert len(training.window_names()) == 124 and training.window_names()[0] == "-9A"


def test_selections(spark):
    sites = spark.createDataFrame([(1, "satmut"), (2, "flagged"), (3, None)], "site long, category string")
    rows = spark.createDataFrame([(1, 5), (2, 22), (4, 6)], "site long, position int")
    assert [r.site for r in training.labelled(rows, sites, ["satmut", "flagged"], ["flagged"]).collect()] == [1]
    assert sorted(r.position for r in training.reliable(rows).collect()) == [5, 6]
    assert training.with_prefix(rows, "obs_", ["site"]).columns == ["site", "obs_position"]
    both = {r.site: (r.designed, r.measured) for r in training.design_stats(sites, rows).collect()}
    assert both == {1: (True, True), 2: (True, True), 3: (True, False), 4: (False, True)}
    assert spark.range(1).select(training.error_rate(F.lit(20)), training.error_rate(F.lit(None))).first() == (0.01, 0.001)


def test_learner_queries_cover_drivers_classes_and_conditions(spark, sf):
    from editloom.plans import drivers
    from editloom.plans import models as plans
    from editloom.sources.fixtures import Source

    s = Source(spark, sf)
    sets = drivers.rows(s).cache()
    groups = {(r.driver, r["class"], r.condition) for r in sets.select("driver", "class", "condition").distinct().collect()}
    assert len({c for _, _, c in groups}) > 1 and len(groups) > 8
    got = plans.l5_logit(s).collect()
    assert {(r.driver, r["class"], r.condition) for r in got} == groups and {r.split for r in got} == {"train", "test"}
    inner = {(r.driver, r["class"], r.condition) for r in sets.where("frequency > 0 and frequency < 1").select("driver", "class", "condition").distinct().collect()}
    rows = plans.l4_gbtr(s).collect()
    assert {(r.driver, r["class"], r.condition) for r in rows} <= inner and sum(r.n for r in rows) <= sets.where("frequency > 0 and frequency < 1").count()
