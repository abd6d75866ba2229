"""Tests and statistics, table in and table out."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, exp, factorial

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from editloom.functions import tails
from editloom.functions.draws import Draws
from editloom.functions.special import binom_cdf, binom_sf, f_sf, hash_int, normal_two_sided, pearson, t_two_sided
from editloom.operators.counts import paired
from editloom.operators.ranges import placed, value_counts, with_average_rank
from editloom.operators.resample import Counts
from editloom.sources.shared import new_folder, written

MUTATION = ["position", "ref_nt", "obs_nt"]


def control_explained(t: DataFrame, c: DataFrame) -> DataFrame:
    """For mutations seen in both, P(X >= treatment count) at the control's frequency."""
    rows = paired(t, c).where("obs_nt <> ref_nt and t_count > 0 and c_count > 0")
    rate = F.col("c_count") / F.col("c_total")
    return rows.withColumn("p_value", binom_sf(F.col("t_count"), F.col("t_total"), rate))


def sequencing_error(t: DataFrame, quality: DataFrame) -> DataFrame:
    """P(treatment errors exceed control errors by the count) at the least Phred qualities of either side.
    ``quality``: site, idx (and condition, where it differs by that), t_quality, c_quality; what it lacks is taken as 30."""
    keys = [k for k in ("condition", "site", "idx") if k in quality.columns]
    # One shuffle by what both share serves the totals and the join; qualities grow with the sites, so they are not broadcast.
    rows = t.repartition(*keys).withColumn("t_total", F.sum("count").over(Window.partitionBy("condition", "site", "idx"))).where("obs_nt <> ref_nt and count > 0")
    rows = rows.join(quality.select(*keys, "t_quality", "c_quality").hint("merge"), keys, "left")
    t_p, c_p = (F.pow(F.lit(10.0), -F.coalesce(q, F.lit(30)) / 10.0) for q in ("t_quality", "c_quality"))
    return rows.withColumn("p_value", tails.binom_minus_binom(F.col("count"), t_p, c_p, F.col("t_total"))).drop("t_quality", "c_quality")


def fdr_flag(df: DataFrame, p: str, by: list[str], order: list[str], alpha: float, mode: str = "pointwise", carve: float | None = 0.995) -> DataFrame:
    """T4: ``accept`` by rank p values. ``pointwise``: each on its own p <= rank / n * alpha; ``step_down``: the
    prefix before the first failure; ``step_up``: everything up to the last success. Rows with p above
    ``carve`` (or null) don't count in n and are not accepted; ties are broken by ``order``. Null group columns make a group
    of their own. Ranks come from ranges (``ranges.placed``), so one group may hold most rows."""
    counts = F.coalesce(F.col(p) <= carve, F.lit(False)) if carve is not None else F.col(p).isNotNull()
    # A struct, since fields of structs that are null are equal, as groups are; rows that don't count are a group of their own.
    group = F.struct(*by, counts.alias("__in"))
    rows = placed(df.withColumn("__group", group), ["__group"], [p, *order], "__place", "__n")
    told = F.col("__group.__in") & (F.col(p) <= (F.col("__place") + 1) / F.col("__n") * alpha)
    rows = rows.withColumn("__ok", F.coalesce(told, F.lit(False)))
    if mode != "pointwise":
        edge = F.min(F.when(~F.col("__ok"), F.col("__place"))) if mode == "step_down" else F.max(F.when(F.col("__ok"), F.col("__place")))
        rows = rows.join(rows.groupBy("__group").agg(edge.alias("__edge")), "__group")  # a row a group
        kept = F.col("__edge").isNull() | (F.col("__place") < F.col("__edge")) if mode == "step_down" else F.col("__place") <= F.col("__edge")
        rows = rows.withColumn("__ok", F.col("__group.__in") & F.coalesce(kept, F.lit(False))).drop("__edge")
    return rows.withColumnRenamed("__ok", "accept").drop("__group", "__place", "__n")


def fdr_global(df: DataFrame, p: str, order: list[str], alpha: float, mode: str = "pointwise", carve: float | None = 0.995) -> DataFrame:
    """``fdr_flag`` over the whole table: ranks come from ranges of p, each sorted by a task of its own, and the rows that
    earlier ranges hold; which prefix is accepted is one number."""
    spark = df.sparkSession
    counts = F.coalesce(F.col(p) <= carve, F.lit(False)) if carve is not None else F.col(p).isNotNull()
    ranged = df.withColumn("__in", counts).repartitionByRange(F.desc("__in"), F.col(p), *order).withColumn("__range", F.spark_partition_id())
    rows = written(ranged, new_folder(spark, "fdr"))
    sizes = rows.where("__in").groupBy("__range").agg(F.count("*").alias("__size"))  # a row a range
    base = sizes.withColumn("__base", F.sum("__size").over(Window.orderBy("__range")) - F.col("__size")).withColumn("__n", F.sum("__size").over(Window.partitionBy()))
    place = F.row_number().over(Window.partitionBy("__range").orderBy(F.desc("__in"), p, *order))
    rows = rows.withColumn("__place", place).join(F.broadcast(base), "__range", "left").withColumn("__rank", F.col("__base") + F.col("__place"))
    rows = rows.withColumn("__ok", F.coalesce(F.col("__in") & (F.col(p) <= F.col("__rank") / F.col("__n") * alpha), F.lit(False)))
    if mode != "pointwise":
        edge = F.min(F.when(F.col("__in") & ~F.col("__ok"), F.col("__rank"))) if mode == "step_down" else F.max(F.when(F.col("__ok"), F.col("__rank")))
        rows = rows.join(F.broadcast(rows.agg(edge.alias("__edge"))))
        kept = F.col("__edge").isNull() | (F.col("__rank") < F.col("__edge")) if mode == "step_down" else F.col("__rank") <= F.col("__edge")
        rows = rows.withColumn("__ok", F.coalesce(F.col("__in") & kept, F.lit(False))).drop("__edge")
    return rows.withColumn("accept", F.col("__ok")).drop("__in", "__range", "__size", "__base", "__n", "__place", "__rank", "__ok")


def background_test(zero: DataFrame, last: int = 5, most_mean: float = 0.025, least_sites: int = 50, alpha: float = 0.001) -> DataFrame:
    """T5: few zeros mark real signal. The baseline is the mean zero share of the last positions' quiet
    mutations; p is the lower tail of the zero count; rows not accepted are background."""
    place = F.dense_rank().over(Window.partitionBy("condition").orderBy(F.desc("position")))
    quiet = zero.withColumn("__place", place).where((F.col("__place") <= last) & (F.col("mean_activity") <= most_mean) & (F.col("sites") >= least_sites))
    base = quiet.groupBy("condition").agg(F.avg("zero_fraction").alias("baseline"))
    rows = zero.join(base, "condition").withColumn("p_value", binom_cdf(F.col("zero_sites"), F.col("sites"), F.col("baseline")))
    return fdr_flag(rows, "p_value", ["condition"], MUTATION, alpha)


def anova(df: DataFrame, value: str, group: str, by: list[str]) -> DataFrame:
    """One-way ANOVA of ``value`` by ``group`` for each key: F, degrees of freedom and p, from sums alone."""
    return anova_parts(df.where(F.col(value).isNotNull()).groupBy(*by, group).agg(F.count("*").alias("n"), F.avg(value).alias("m"), (F.var_pop(value) * F.count("*")).alias("ss")), by)


def anova_parts(parts: DataFrame, by: list[str]) -> DataFrame:
    """``anova`` from each group's count n, mean m and sum of squared deviations ss."""
    sums = parts.groupBy(*by).agg(
        F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("ss").alias("within"), (F.sum(F.col("n") * F.col("m") * F.col("m")) - F.pow(F.sum(F.col("n") * F.col("m")), 2) / F.sum("n")).alias("between")
    )
    return anova_test(sums, F.col("k"), F.col("n"), F.col("within"), F.col("between")).select(*by, "f_stat", "df_between", "df_within", "p_value")


def anova_test(df: DataFrame, k: Column, n: Column, within: Column, between: Column, tail: Callable[[Column, Column, Column], Column] = f_sf) -> DataFrame:
    """``df`` with F, degrees of freedom and p from k groups of n rows and their sums of squares; ``tails.f_sf`` for many rows."""
    rows = df.withColumn("df_between", k - 1).withColumn("df_within", n - k)
    ratio = F.try_divide(F.try_divide(F.greatest(between, F.lit(0.0)), F.col("df_between")), F.try_divide(within, F.col("df_within")))
    rows = rows.withColumn("f_stat", F.when((F.col("df_between") > 0) & (F.col("df_within") > 0), ratio))
    return rows.withColumn("p_value", tail(F.col("f_stat"), F.col("df_between").cast("double"), F.col("df_within").cast("double")))


def bonferroni(df: DataFrame, p: str = "p_value", alpha: float = 0.005) -> DataFrame:
    """Accept p <= alpha / rows; the count is one scalar joined back."""
    size = df.agg(F.count("*").alias("__m"))
    return df.join(F.broadcast(size)).withColumn("accept", F.coalesce(F.col(p) <= alpha / F.col("__m"), F.lit(False))).drop("__m")


def rank_aggregation(df: DataFrame, value: str, keys: list[str], condition: str = "condition", alpha: float = 0.01) -> DataFrame:
    """Robust rank aggregation over mutations present in every condition. Each condition ranks them by
    descending value (ties by key); rho = n * min over k of the summed beta tails, an upper bound that may pass 1."""
    from editloom.functions.special import betainc

    many = df.agg(F.count_distinct(condition).alias("__n"))
    rows = df.join(F.broadcast(many)).withColumn("__seen", F.count("*").over(Window.partitionBy(*keys))).where("__seen = __n")
    order = Window.partitionBy(condition).orderBy(F.desc(value), *keys)
    rows = rows.withColumn("rank", F.row_number().over(order) / F.count("*").over(Window.partitionBy(condition)))
    per = rows.groupBy(*keys).agg(F.array_sort(F.collect_list("rank")).alias("ranks"))  # one a condition
    n = F.size("ranks")
    tail = lambda r, k: F.when(r >= 1, F.lit(1.0)).otherwise(betainc(k.cast("double"), (n + 1 - k).cast("double"), r))
    sums = F.transform("ranks", lambda r, i: F.aggregate(F.transform(F.sequence(i + 1, n), lambda k: tail(r, k)), F.lit(0.0), lambda a, x: a + x))
    found = per.select(*keys, (F.array_min(sums) * n).alias("rho"))
    return fdr_global(found, "rho", keys, alpha, "step_down", None)


def correlation(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Pearson with its two-sided p, Spearman over average ranks, and R2 of y predicted by x."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, x, y)
    rows = written(rows, new_folder(df.sparkSession, "correlation"))
    for c in (x, y):
        rows = with_average_rank(rows, by, c, f"__r_{c}")
    out = rows.groupBy(*by).agg(
        F.count("*").alias("n"), pearson(x, y).alias("pearson"), pearson(f"__r_{x}", f"__r_{y}").alias("spearman"),
        (1 - F.try_divide(F.sum(F.pow(F.col(y) - F.col(x), 2)), F.var_pop(y) * F.count("*"))).alias("r2"),
    )
    r, n = F.col("pearson"), F.col("n").cast("double")
    return out.withColumn("p_value", F.when((n > 2) & (F.abs(r) < 1), t_two_sided(r * F.sqrt((n - 2) / (1 - r * r)), n - 2)))


def mann_whitney(df: DataFrame, value: str, label: str, by: list[str]) -> DataFrame:
    """U of label 1 against 0, two-sided by the tie-corrected normal approximation, from counts by value."""
    counts = value_counts(df, by, value, label)
    ones = F.col("ones")
    sums = counts.groupBy(*by).agg(
        F.sum("ones").alias("n1"), F.sum(F.col("n") - ones).alias("n0"), F.sum(ones * (F.col("before") + (F.col("n") + 1) / 2.0)).alias("r1"),
        F.sum(F.col("n") * (F.pow("n", F.lit(2)) - 1)).alias("tied"),
    )
    n = (F.col("n1") + F.col("n0")).cast("double")
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2.0
    spread = F.sqrt(F.col("n1") * F.col("n0") / 12.0 * ((n + 1) - F.try_divide(F.col("tied"), n * (n - 1))))
    return sums.select(*by, "n1", "n0", u.alias("u"), F.try_divide(u - F.col("n1") * F.col("n0") / 2.0, spread).alias("z")).withColumn("p_value", normal_two_sided(F.col("z")))


def bootstrap(df: DataFrame, value: str, by: list[str], row_order: list[str], replicates: int = 1000, kind: str = "mean", seed: str = "boot", held: int = 1 << 20) -> DataFrame:
    """Percentile intervals of the mean, geometric mean or median from ``replicates`` resamples.

    Draws are hashes of (replicate, draw), so every engine draws alike, and groups share them before they are taken modulo their rows. A task
    takes some of the replicates; a group of up to ``held`` rows is held there as numbers, larger ones join each draw with its row."""
    x = F.ln(value) if kind == "gmean" else F.col(value)
    rows = df.where(F.col(value).isNotNull() & ((F.col(value) > 0) if kind == "gmean" else F.lit(True)))
    narrow = rows.dropna(subset=by).select(*by, *[c for c in row_order if c not in by], x.cast("double").alias("__x"))
    rows = written(placed(narrow, by, row_order, "__at", "__n").select(*by, "__at", "__n", "__x"), new_folder(df.sparkSession, "bootstrap"))
    means = _resampled(rows.where(F.col("__n") <= held), by, replicates, kind, seed)
    large = rows.where(F.col("__n") > held)
    if not large.isEmpty():
        means = means.unionByName(_joined(large, by, replicates, kind, seed))
    return _percentiles(means.withColumn("__m", F.exp("__m")) if kind == "gmean" else means, by)


def _percentiles(means: DataFrame, by: list[str]) -> DataFrame:
    return means.groupBy(*by).agg(*[F.percentile("__m", q).alias(f"p{n}") for q, n in ((0.025, "025"), (0.16, "16"), (0.84, "84"), (0.975, "975"))])


def _joined(rows: DataFrame, by: list[str], replicates: int, kind: str, seed: str) -> DataFrame:
    """``by``, __m by joining every draw with its row."""
    drawn = rows.select(*by, "__n", F.col("__at").alias("__i")).withColumn("__rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    drawn = drawn.withColumn("__at", F.pmod(hash_int(F.concat_ws("|", F.lit(seed), F.col("__rep"), F.col("__i"))), F.col("__n"))).drop("__n", "__i")
    means = drawn.join(rows.drop("__n"), [*by, "__at"]).groupBy(*by, "__rep").agg((F.percentile("__x", 0.5) if kind == "median" else F.avg("__x")).alias("__m"))
    return means.drop("__rep")


def _resampled(rows: DataFrame, by: list[str], replicates: int, kind: str, seed: str, tasks: int = 64) -> DataFrame:
    """``by``, __m from groups held as arrays, a share of the replicates a task."""
    import pandas as pd

    tasks, kinds = min(tasks, replicates), dict(rows.dtypes)

    def resample(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        draws = Draws([])
        for frame in frames:
            most = int(frame["__n"].max())
            if len(draws.ends) < most:
                draws = Draws([str(i).encode() for i in range(most)])
            groups = [(key, np.asarray(xs, float)) for *key, xs in frame[[*by, "xs"]].itertuples(index=False)]
            out = []
            for rep in range(1 + int(frame["__task"].iloc[0]), replicates + 1, tasks):
                drawn = draws(f"{seed}|{rep}|".encode())
                for key, xs in groups:
                    picked = xs[drawn[: len(xs)] % np.uint32(len(xs))]
                    out.append((*key, float(np.median(picked) if kind == "median" else picked.mean())))
            yield pd.DataFrame(out, columns=[*by, "__m"])

    packed = rows.groupBy(*by, "__n").agg(F.transform(F.array_sort(F.collect_list(F.struct("__at", "__x"))), lambda r: r["__x"]).alias("xs"))
    packed = written(packed, new_folder(rows.sparkSession, "bootstrap"))
    dealt = packed.withColumn("__task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)))).repartitionById(tasks, F.col("__task"))
    return dealt.mapInPandas(resample, "".join(f"`{c}` {kinds[c]}, " for c in by) + "__m double")


def bootstrap_poisson(df: DataFrame, value: str, by: list[str], row_order: list[str], replicates: int = 1000, seed: str = "boot") -> DataFrame:
    """T12 for large groups: each row weighs Poisson(1) in each replicate, so no row meets another. Draws are hashes of (replicate, row),
    made where the row lies; only sums a replicate leave a task."""
    import pandas as pd

    total, cuts = 0.0, []
    for k in range(8):
        total += exp(-1) / factorial(k)
        cuts.append(ceil(total * 2.0**32 - 0.5))
    kinds = dict(df.dtypes)
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("__x"), F.concat_ws("|", *row_order).alias("__end"))
    most = max(1, (1 << 22) // replicates)  # groups whose sums a task holds at once

    def weigh(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {}
        out = lambda: pd.DataFrame([(*(None if pd.isna(k) else k for k in key), *held) for key, held in sums.items()], columns=[*by, "weights", "held"])
        for frame in frames:
            groups = list(frame.groupby(by, sort=False, dropna=False).indices.items())
            order = np.concatenate([at for _, at in groups])
            starts = np.cumsum([0] + [len(at) for _, at in groups[:-1]])
            ends, x = frame["__end"].to_numpy()[order], frame["__x"].to_numpy()[order]
            draws, weigher = Draws([e.encode() for e in ends]), Counts(cuts)
            weights, held = np.empty((replicates, len(groups))), np.empty((replicates, len(groups)))
            for rep in range(replicates):
                w = weigher(draws(f"{seed}|{rep + 1}|".encode())).astype(float)
                weights[rep], held[rep] = np.add.reduceat(w, starts), np.add.reduceat(w * x, starts)
            for i, (key, _) in enumerate(groups):
                key = key if isinstance(key, tuple) else (key,)
                old = sums.get(key, (0.0, 0.0))
                sums[key] = old[0] + weights[:, i], old[1] + held[:, i]
                if len(sums) >= most:
                    yield out()
                    sums.clear()
        if sums:
            yield out()

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = written(rows, new_folder(df.sparkSession, "bootstrap")).repartition(parts)
    sums = rows.mapInPandas(weigh, "".join(f"`{c}` {kinds[c]}, " for c in by) + "weights array<double>, held array<double>")
    each = sums.select(*by, F.posexplode(F.arrays_zip("weights", "held")).alias("rep", "s")).groupBy(*by, "rep")
    return _percentiles(each.agg(F.try_divide(F.sum("s.held"), F.sum("s.weights")).alias("__m")), by)
