"""Order within groups by ranges, and resampling without joining draws with rows."""

import hashlib
import itertools
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from editloom.functions.draws import Draws
from editloom.operators import ranges, resample, stats


@pytest.fixture(scope="module")
def skewed(spark):
    """One group with nearly all rows, many ties, a null value, and small groups."""
    draw = np.random.default_rng(1)
    rows = [("big", i, float(x)) for i, x in enumerate(np.round(draw.normal(size=5000), 1))] + [("small", i, float(i)) for i in range(3)] + [("one", 0, 7.5), ("big", 9999, None)]
    return rows, spark.createDataFrame(rows, "g string, i int, v double").repartition(6).cache()


def values(rows, g):
    return np.array(sorted(v for k, _, v in rows if k == g and v is not None))


def test_order_statistics_fall_between_values(skewed):
    rows, df = skewed
    shares = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.975, "e": 1.0}
    got = {r.g: r for r in ranges.order_statistics(df, ["g"], "v", shares).collect()}
    assert set(got) == {"big", "small", "one"}
    for g, r in got.items():
        assert [r[n] for n in shares] == pytest.approx(list(np.quantile(values(rows, g), list(shares.values()))))


def test_tied_ranks_share_their_mean(skewed):
    rows, df = skewed
    got = ranges.with_average_rank(df, ["g"], "v", "rank").collect()
    assert len(got) == len(rows)
    for r in got:
        if r.v is None:
            assert r.rank is None
            continue
        all_ = values(rows, r.g)
        assert r.rank == (all_ < r.v).sum() + ((all_ == r.v).sum() + 1) / 2


def test_places_of_one_large_group_come_from_many_ranges(spark):
    df = spark.range(20_000).select(F.lit("g").alias("g"), (F.col("id") * 7919 % 20_000).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be one range
    try:
        got = ranges.placed(df, ["g"], ["v"])
        assert got.where("place <> v or size <> 20000").count() == 0
        assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_multinomial_draws_have_the_law_of_resampling(spark):
    """Means and spreads over replicates; every replicate has as many draws as rows."""
    rows = [("a", i, float(i % 7 == 0)) for i in range(400)] + [("b", 0, 3.0), ("c", 0, 1.0), ("c", 1, 5.0)] + [("a", 400, None)]
    df = spark.createDataFrame(rows, "g string, i int, v double").repartition(4)
    ones = resample.multinomial_means(df.withColumn("v", F.when(F.col("v").isNotNull(), 1.0)), "v", ["g"], ["i"], 500)
    assert ones.count() == 1500 and ones.where(F.abs(F.col("mean") - 1) > 1e-12).count() == 0
    got = resample.multinomial_means(df, "v", ["g"], ["i"], 4000).groupBy("g").agg(F.avg("mean").alias("m"), F.stddev_pop("mean").alias("s")).collect()
    told = {r.g: (r.m, r.s) for r in got}
    x = np.array([v for g, _, v in rows if g == "a" and v is not None])
    assert told["a"][0] == pytest.approx(x.mean(), abs=5 * x.std() / 20 / 63) and told["a"][1] == pytest.approx(x.std() / 20, rel=0.06)
    assert told["b"] == (3.0, 0.0) and told["c"][0] == pytest.approx(3.0, abs=0.12) and told["c"][1] == pytest.approx(2 / 2**0.5, rel=0.05)


def test_picks_are_added_up_by_blocks_of_places(spark):
    """No pick is joined as a row, which a small table's estimate would have broadcast; blocks of any size give the same means."""
    df = spark.createDataFrame([("ab"[i % 3 == 0], i, float(i % 7)) for i in range(900)], "g string, i int, v double").repartition(5)
    means = resample.multinomial_means(df, "v", ["g"], ["i"], 50, places=64)
    plan = means._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and plan.count("Join") == 1  # of the replicates' sums
    told = {(r.g, r.rep): r["mean"] for r in resample.multinomial_means(df, "v", ["g"], ["i"], 50, block=200).collect()}
    assert len(told) == 100 and {(r.g, r.rep): r["mean"] for r in means.collect()} == pytest.approx(told, abs=1e-12)


def test_rows_of_value_0_may_be_left_out(spark):
    """Two lengths of one editor's sites, of which few have the second; a group held alone or with others has the same means."""
    sites = [("e", "c%d" % (i % 2), i) for i in range(500)] + [("f", "c2", i) for i in range(40)]
    rows = [(*s, k, float(s[2] % 9 + 1) if s[2] % k == 0 else 0.0) for s in sites for k in (1, 7, 11)]
    df = spark.createDataFrame(rows, "e string, c string, site int, k int, v double").repartition(5)
    over = spark.createDataFrame(sites, "e string, c string, site int").repartition(3)
    told = lambda means: {(r.e, r.k, r.rep): r["mean"] for r in means.collect()}
    dense = told(resample.multinomial_means(df, "v", ["e", "k"], ["c", "site"], 40))
    assert len(dense) == 240 and len(set(dense.values())) > 100
    for kept in ({}, {"sums": 40, "places": 64}):
        assert told(resample.multinomial_means(df.where("v > 0"), "v", ["e", "k"], ["c", "site"], 40, over=over, **kept)) == pytest.approx(dense, abs=1e-12)


def test_no_table_with_places_is_broadcast(spark):
    """What is small as stored may be many rows; the driver would hold them."""
    df = spark.createDataFrame([("ab"[i % 2], i) for i in range(50)], "g string, i int").repartition(3)
    plan = ranges.placed(df, ["g"], ["i"])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_draws_are_even():
    first = resample.mixed((np.arange(2000, dtype=np.uint64) * np.uint64(resample.ROW) + np.uint64(resample.SHIFT)).astype(np.uint32))
    whole = resample.mixed(first[:, None] + (np.arange(500, dtype=np.uint64) * np.uint64(resample.REP)).astype(np.uint32))
    for n in (1, 9, 10, 400, 10**6):
        assert (resample.Counts(n)(whole[:50]) == np.searchsorted(np.array(resample.cuts(n), np.uint64), whole[:50].astype(np.uint64), "right")).all()
    u = whole / resample.SPAN
    cells = np.histogram(u.ravel(), 100)[0]
    assert ((cells - u.size / 100) ** 2 / (u.size / 100)).sum() < 160
    assert abs(np.corrcoef(u[:-1].ravel(), u[1:].ravel())[0, 1]) < 0.005 and abs(np.corrcoef(u[:, :-1].ravel(), u[:, 1:].ravel())[0, 1]) < 0.005


@pytest.mark.parametrize("x", [[4.0], [1.0, 2.0], [5.0, 1.0, 2.5], [1.0, 2.0, 4.0, 8.0], [3.0, 3.0, 1.0, 9.0, 2.0], [1.0, 5.0, 2.0, 7.0, 7.0, 0.5]])
def test_law_of_the_median_equals_all_resamples(spark, x):
    df = spark.createDataFrame([("g", v) for v in x] + [("g", None)], "g string, v double")
    law = {}
    for r in resample.median_law(df, "v", ["g"]).collect():
        law[r.median] = law.get(r.median, 0.0) + r.chance
    want = {}
    for draws in itertools.product(x, repeat=len(x)):
        m = float(np.median(draws))
        want[m] = want.get(m, 0.0) + len(x) ** -len(x)
    assert {k: v for k, v in law.items() if v > 1e-12} == pytest.approx(want, abs=1e-9)


def test_median_intervals_of_many_rows(spark):
    """Against the law of the middle draws by exact sums, and within the spread of drawn medians."""
    draw = np.random.default_rng(3)
    x = np.sort(draw.exponential(size=1500))
    df = spark.createDataFrame([("even", float(v)) for v in x] + [("odd", float(v)) for v in x[:-1]], "g string, v double")
    law = resample.median_law(df, "v", ["g"]).groupBy("g").agg(F.sum("chance").alias("p")).collect()
    assert all(r.p == pytest.approx(1, abs=1e-8) for r in law)
    got = {r.g: r for r in resample.median_intervals(df, "v", ["g"]).collect()}
    medians = np.median(draw.choice(x, (4000, len(x))), axis=1)
    for name, q in resample.INTERVAL.items():
        near = np.quantile(medians, [max(q - 0.02, 0), min(q + 0.02, 1)])
        assert near[0] <= got["even"][name] <= near[1] and abs(got["odd"][name] - got["even"][name]) < 0.05
    n, m = 1499, 750
    tail = lambda k: sum(comb(n, j) * k**j * (n - k) ** (n - j) for j in range(m, n + 1)) / n**n  # noqa: E731  in whole numbers
    k = int(np.searchsorted(x, got["odd"]["p025"])) + 1
    assert tail(k) >= 0.025 > tail(k - 1)


def test_intervals_by_kind(spark):
    df = spark.createDataFrame([("g", i, float(2 ** (i % 3))) for i in range(300)] + [("g", 300, -1.0)], "g string, i int, v double")
    row = resample.bootstrap_means(df, "v", ["g"], ["i"], 400, "gmean").first()
    assert row.p025 < row.p16 < 2.0 < row.p84 < row.p975 and row.p975 - row.p025 < 0.5


def hashed(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def test_draws_of_many_texts_are_those_of_md5():
    ends = [*map(str, range(0, 3000, 7)), "", "c1|12", "x" * 47, "y" * 60, "é"]
    draws = Draws([e.encode() for e in ends])
    for begin in ("boot|1|", "boot|12|", "boot|123|", "boot|1234|", ""):
        assert draws(begin.encode()).tolist() == [hashed(begin + e) for e in ends]


@pytest.mark.parametrize("kind", ["mean", "gmean", "median"])
def test_resamples_of_held_and_of_joined_groups_agree(spark, kind):
    """A group's draws are numbers in a task up to a bound, and rows beyond it; both give the same intervals."""
    rows = [("ab"[i % 3 == 0], i, float(i * 37 % 101)) for i in range(90)] + [("c", 0, 2.5), ("a", 99, None), (None, 1, 1.0)]
    df = spark.createDataFrame(rows, "g string, i int, v double").repartition(3)
    some, none = (stats.bootstrap(df, "v", ["g"], ["i"], 40, kind, held=held).orderBy("g").collect() for held in (40, 0))
    assert [r.g for r in some] == ["a", "b", "c"]
    for x, y in zip(some, none):
        assert list(x)[1:] == pytest.approx(list(y)[1:], abs=1e-12)


def test_poisson_weights_are_those_of_each_row(spark):
    rows = [("a", i, float(i % 7)) for i in range(40)] + [(None, i, 2.0 * i) for i in range(3)] + [("a", 99, None)]
    row = {r.g: r for r in stats.bootstrap_poisson(spark.createDataFrame(rows, "g string, i int, v double").repartition(3), "v", ["g"], ["g", "i"], 60).collect()}
    cuts = np.cumsum([np.exp(-1) / np.prod(np.arange(1, k + 1)) for k in range(8)])
    for g in ("a", None):
        means = []
        for rep in range(1, 61):
            w = [(sum((hashed("|".join(["boot", str(rep), *([g] if g else []), str(i)])) + 0.5) / 2**32 > cuts), v) for h, i, v in rows if h == g and v is not None]
            means += [sum(n * v for n, v in w) / sum(n for n, _ in w)] if any(n for n, _ in w) else []
        assert list(row[g])[1:] == pytest.approx(list(np.quantile(means, [0.025, 0.16, 0.84, 0.975])), abs=1e-9)
