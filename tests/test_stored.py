"""Tables on disk: ordered files, buckets by site, side tables; and what is fitted on them."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from editloom.operators import batch, models, stats, training
from editloom.sources import bucketed, ordered
from editloom.sources import dimensions as dim

CELLS = "condition string, site long, idx int, obs_nt string, count double"


def test_ordered_files_tell_places_without_a_sort(spark, tmp_path):
    rows = [(i % 7, i, None if i % 50 == 0 else f"t{i % 13}") for i in range(1000)]
    path = f"file://{tmp_path}/o"
    df = spark.createDataFrame(rows, "k int, i int, t string").repartition(5)
    ordered.store_ordered(df, path, [F.desc("k"), F.col("t"), F.col("i")], rows_per_file=90)
    got = ordered.read_ordered(spark, path)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 1 and "Sort" not in plan
    want = sorted(rows, key=lambda r: (-r[0], r[2] is not None, r[2] or "", r[1]))
    assert [(r.k, r.i, r.t) for r in sorted(got.collect(), key=lambda r: r.place)] == want
    assert sorted(r.place for r in got.collect()) == list(range(1, 1001))


def test_ordered_tables_may_be_empty_tied_and_clash(spark, tmp_path):
    path = f"file://{tmp_path}/o"
    ordered.store_ordered(spark.createDataFrame([], "k int"), path, [F.col("k")])
    assert ordered.read_ordered(spark, path).count() == 0
    ordered.store_ordered(spark.createDataFrame([(1, "a")] * 5 + [(None, "b")], "k int, v string"), path, [F.col("k")])
    got = sorted((r.place, r.k) for r in ordered.read_ordered(spark, path).collect())
    assert got == [(1, None), *[(i, 1) for i in range(2, 7)]]
    ordered.store_ordered(spark.createDataFrame([(1,)], "place int"), path, [F.col("place")])
    with pytest.raises(ValueError):
        ordered.read_ordered(spark, path)
    assert [tuple(r) for r in ordered.read_ordered(spark, path, "at").collect()] == [(1, 1)]


def cells(conditions, sites, plus=0.0):
    return [(c, s, i, n, float(s + i) + plus) for c in conditions for s in sites for i in range(3) for n in "AC"]


def test_buckets_join_without_a_shuffle_and_slices_are_replaced(spark, tmp_path):
    names = [f"t_{uuid.uuid4().hex}" for _ in range(2)]
    for name, plus in zip(names, (0.0, 0.5)):
        bucketed.store_bucketed(spark.createDataFrame(cells(("c0", "c1"), range(20), plus), CELLS), name, f"file://{tmp_path}/{name}", 4)
    bucketed.replace_slices(spark.createDataFrame(cells(("c1",), range(5), 100.0), CELLS).select("count", "obs_nt", "idx", "site", "condition"), names[0], 4)
    beside = bucketed.co_located(spark)
    beside.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    a, b = (beside.table(n) for n in names)
    totals = b.groupBy("condition", "site", "idx").agg(F.sum("count").alias("total"))
    both = a.join(b.withColumnRenamed("count", "other"), ["condition", "site", "idx", "obs_nt"]).join(totals, ["condition", "site", "idx"])
    assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString()
    got = both.collect()
    assert len(got) == 20 * 6 + 5 * 6
    assert all(r.count_ == r.other - 0.5 + (100 if r.condition == "c1" else 0) for r in both.withColumnRenamed("count", "count_").collect())
    assert {r.total for r in got if r.site == 2 and r.idx == 1} == {7.0}
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"
    for n in names:
        spark.sql(f"DROP TABLE {n}")


def test_bucketed_tables_keep_rows_without_a_site_and_may_be_empty(spark, tmp_path):
    name = f"t_{uuid.uuid4().hex}"
    bucketed.store_bucketed(spark.createDataFrame([("c0", None, 1, "A", 2.0), ("c0", 1, 1, "A", 3.0)] * 2, CELLS), name, f"file://{tmp_path}/{name}", 3)
    assert sorted((r.site is None, r["count"]) for r in spark.table(name).collect()) == [(False, 3.0)] * 2 + [(True, 2.0)] * 2
    spark.sql(f"DROP TABLE {name}")
    bucketed.store_bucketed(spark.createDataFrame([], CELLS), name, f"file://{tmp_path}/empty", 3)
    assert spark.table(name).count() == 0
    spark.sql(f"DROP TABLE {name}")


def test_side_tables_are_of_the_first_level(spark, tmp_path):
    calls = spark.createDataFrame([("c0", 1, 5, 33), ("c0", 1, 5, 21), ("c0", 1, 6, None), ("c1", 1, 5, 40)], "condition string, site long, idx int, quality int")
    least = dim.least_qualities(calls)
    for name in ("t", "c"):
        dim.store(least if name == "t" else least.where("condition = 'c1'"), f"file://{tmp_path}/{name}")
    levels = spark.createDataFrame([("c0", "L1"), ("c1", "L2")], "name string, level string")
    quality = dim.load_qualities(spark, f"file://{tmp_path}/t", f"file://{tmp_path}/c", levels)
    assert [(r.condition, r.t_quality, r.c_quality) for r in quality.collect()] == [("c0", 21, None)]
    g4 = spark.createDataFrame([(c, 1, 5, "C", n, x) for c in ("c0", "c1") for n, x in (("C", 90.0), ("T", 3.0))], "condition string, site long, idx int, ref_nt string, obs_nt string, count double")
    p = {r.condition: r.p_value for r in stats.sequencing_error(g4, quality).collect()}
    alone = {r.condition: r.p_value for r in stats.sequencing_error(g4, quality.limit(0)).collect()}
    assert p["c1"] == alone["c1"] == alone["c0"] and p["c0"] > p["c1"]


def test_scaling_by_position_leaves_out_zeros_and_constants(spark):
    rows = spark.createDataFrame([("g", 1, 0.0), ("g", 1, 0.2), ("g", 1, 0.4), ("g", 2, 0.3), ("g", 2, 0.3), ("h", 1, None)], "k string, position int, frequency double")
    got = sorted(((r.k, r.position, r.frequency, r.scaled) for r in training.scaled_by_position(rows, ["k"]).collect()), key=str)
    told = [(k, p, f, None if s is None else round(s, 9)) for k, p, f, s in got]
    assert told == [("g", 1, 0.0, None), ("g", 1, 0.2, -1.0), ("g", 1, 0.4, 1.0), ("g", 2, 0.3, None), ("g", 2, 0.3, None), ("h", 1, None, None)]


def test_rows_stand_under_their_cell_type_and_all(spark):
    rows = spark.createDataFrame([("a", 1, "train"), ("a", 1, "test"), ("b", 2, "train")], "celltype string, site int, split string")
    got = {r.celltype: tuple(r)[1:] for r in training.split_counts(training.with_combined(rows), ["celltype"]).collect()}
    assert got == {"a": (2, 1, 1, 1, 1, 1), "b": (1, 1, 0, 1, 1, 0), "Combined": (3, 2, 1, 2, 2, 1)}


def test_whole_frequencies_are_whole(spark):
    found = spark.createDataFrame([("c0", 1, 2, 3, "C", n, f) for n, f in (("A", 0.1), ("G", 0.2), ("T", 0.7))], "condition string, site long, idx int, position int, ref_nt string, obs_nt string, frequency double")
    sites, kinds = spark.createDataFrame([(1, "AACGT")], "site long, seq string"), spark.createDataFrame([("c0", "CBE")], "condition string, kind string")
    for order in (["C_T", "C_G", "C_A"], ["C_A", "C_G", "C_T"]):
        assert [r.frequency for r in training.training_rows(found, sites, kinds, [("d", "CBE", "C_TGA", order, 3, 8, 2)]).collect()] == [1.0]


def test_adjusting_by_the_fit_takes_a_planted_batch_effect_out(spark):
    rng = np.random.default_rng(5)
    shift, kind = {"b0": 0.0, "b1": 0.5, "b2": -0.7}, {"X": 1.0, "Y": 2.0, "Z": 0.3}
    rows = [(e, b, float(np.exp(kind[e] + shift[b]))) for e in kind for b in shift if (e, b) != ("Z", "b0") for _ in range(int(rng.integers(2, 9)))]
    df = spark.createDataFrame(rows, "editor string, batch string, ratio double")
    fit = models.two_way(df, "ratio", ("editor", "batch")).where("factor = 'batch'").select(F.col("level").alias("batch"), "coefficient")
    got = batch.adjust_ratio(df, fit, "batch", "ratio").groupBy("editor").agg(F.min("adjusted").alias("low"), F.max("adjusted").alias("high")).collect()
    mean = sum(shift.values()) / 3
    assert {r.editor for r in got} == set(kind)
    for r in got:
        assert r.low == pytest.approx(np.exp(kind[r.editor] + mean), rel=1e-6) and r.high == pytest.approx(r.low, rel=1e-6)
