"""Bootstrap intervals whose cost does not join every draw with its row.

``multinomial_means`` resamples exactly: the counts that n draws from n rows leave on them. A row's count in a replicate is first a Poisson
number of a rate a little below 1, drawn where the row lies. Given their sum such counts are those of as many draws, so
the draws that are missing to n, about three square roots of n, are drawn by place and joined; a replicate whose sum passes n (about one
in a thousand) takes all its draws by place. Tasks hold a block of rows by replicates, and only sums a replicate leave them.

``median_law`` draws nothing: the chance that a resample's median is a given value, or the mean of two given values, follows from
binomial tails over their places. Only places within seven standard deviations of the middle, where all the chance is but 1e-11, are looked at.

Draws come from 32-bit integer arithmetic that is alike in every engine: a mixing of shifts and products is taken of the row's
place, and again of that with the replicate.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import exp, factorial, lgamma, sqrt

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from editloom.functions.special import lgamma as log_gamma
from editloom.operators.ranges import placed
from editloom.sources.shared import new_folder, written

#: Fixed values of the draws: the factor of the mixing, and those of place, replicate and draw, and a shift.
FACTOR, ROW, REP, PICK, SHIFT = 0x45D9F3B, 0x1E3779B9, 0x5BD1E995, 0x2C1B3C6D, 0x165667B1
SPAN = 1 << 32
#: Standard deviations that the Poisson rate lies below 1, and the most that a row is drawn by it.
BELOW, MOST = 3.0, 15
INTERVAL = {"p025": 0.025, "p16": 0.16, "p84": 0.84, "p975": 0.975}


def mixed(x: np.ndarray) -> np.ndarray:
    """The mixing of uint32 numbers, whose products wrap."""
    for _ in range(2):
        x = (x ^ (x >> np.uint32(16))) * np.uint32(FACTOR)
    return x ^ (x >> np.uint32(16))


def rate(n: int) -> float:
    return max(0.0, 1 - BELOW / sqrt(n))


def cuts(n: int) -> list[int]:
    """Draws of at least the k-th of these leave more than k on a row."""
    r, total, out = rate(n), 0.0, []
    for k in range(MOST + 1):
        total += r**k / factorial(k)
        out.append(int(SPAN * (exp(-r) * total)))
    return out


class Counts:
    """How often draws leave a row, from a table by their upper 16 bits; only where a cut falls inside are all bits looked at."""

    def __init__(self, n: int | list[int]) -> None:
        """For groups of ``n`` rows, or by cuts of one's own."""
        self.edges = np.array(n if isinstance(n, list) else cuts(n), np.uint64)
        begin = np.arange(1 << 16, dtype=np.uint64) << np.uint64(16)
        self.table = np.searchsorted(self.edges, begin, "right").astype(np.uint8)
        self.split = self.table != np.searchsorted(self.edges, begin + np.uint64(0xFFFF), "right")

    def __call__(self, u: np.ndarray) -> np.ndarray:
        upper = u >> np.uint32(16)
        out = self.table[upper]
        near = np.flatnonzero(self.split[upper])
        out.ravel()[near] = np.searchsorted(self.edges, u.ravel()[near].astype(np.uint64), "right")
        return out


@lru_cache(maxsize=256)
def counts_of(n: int) -> Counts:
    return Counts(n)


def picked_blocks(n: int, reps: np.ndarray, count: np.ndarray, block: int, chunk: int = 1 << 20) -> Iterator[tuple]:
    """Number of the block of places, replicates and places in it: the ``count`` picks that each replicate of a group of ``n`` rows asks for."""
    ends = np.cumsum(count)
    for begin in range(0, int(ends[-1]), chunk):
        at = np.arange(begin, min(begin + chunk, int(ends[-1])))
        row = np.searchsorted(ends, at, "right")
        j = (at - (ends - count)[row] + 1).astype(np.uint64)
        first = mixed((j * np.uint64(PICK) + np.uint64(SHIFT)).astype(np.uint32))
        shift = (reps[row].astype(np.uint64) * np.uint64(REP)).astype(np.uint32)
        spots = mixed(first + shift).astype(np.int64) % n
        order = np.argsort(spots // block, kind="stable")
        numbers, starts = np.unique(spots[order] // block, return_index=True)
        for number, some in zip(numbers.tolist(), np.split(order, starts[1:])):
            yield number, reps[row[some]].astype(np.int32), (spots[some] % block).astype(np.int32)


def drawn_counts(n: int, begin: int, end: int, replicates: int, block: int) -> Iterator[tuple[int, np.ndarray]]:
    """How often the first draws leave the places from ``begin`` to ``end`` of a group of ``n`` rows, by replicate: some places at a time."""
    shifts = (np.arange(1, replicates + 1, dtype=np.uint64) * np.uint64(REP)).astype(np.uint32)
    count, step = counts_of(n), max(1, block // replicates)
    for i in range(begin, end, step):
        spots = np.arange(i, min(i + step, end), dtype=np.uint64)
        yield i, count(mixed(mixed((spots * np.uint64(ROW) + np.uint64(SHIFT)).astype(np.uint32))[:, None] + shifts))


def multinomial_means(df: DataFrame, value: str, by: list[str], row_order: list[str], replicates: int = 1000, block: int = 1 << 18, places: int = 1 << 13, over: DataFrame | None = None, sums: int = 1 << 22) -> DataFrame:
    """``by``, rep, mean: the means of resamples of each group's rows with a value. ``over``, where ``df`` leaves out rows of value 0: all rows, by
    ``row_order`` and those of ``by`` that tell them apart. ``places``: of how many neighbouring places a task adds up rows and picks.

    Draws follow from the place and the group's size alone. So they are summed once a size, and made once for all groups of a size that have
    rows in a block of places; of such groups a task holds as many as make a million rows or ``sums`` sums."""
    import pandas as pd

    spark, kinds = df.sparkSession, dict(df.dtypes)
    parts, order = int(spark.conf.get("spark.sql.shuffle.partitions")), [c for c in row_order if c not in by]
    rows = df.where(F.col(value).isNotNull()).select(*by, *order, F.col(value).cast("double").alias("__x"))
    if over is None:
        rows = placed(rows, by, row_order, "__at", "__n")
    else:
        shared = [c for c in by if c in over.columns]
        spots = placed(over.select(*shared, *order), shared, row_order, "__at", "__n")
        rows = rows.join(spots.hint("merge"), [*shared, *order])  # stored numbers are small, their broadcast is not
    spot = (F.col("__at") % places).cast("int").alias("__spot")
    rows = written(rows.select(*by, "__n", F.floor(F.col("__at") / places).alias("__block"), spot, "__x"), new_folder(spark, "resample"))
    groups = rows.select(*by, "__n").distinct()
    most = F.greatest(F.lit(1), F.least(F.floor(F.lit(1 << 20) / F.least("__n", F.lit(places))), F.lit(sums // replicates)))
    shares = groups.groupBy("__n").agg(F.count("*").alias("count")).agg(F.max(F.ceil(F.col("count") / most))).first()[0] or 1
    share = F.pmod(F.hash(*by), F.lit(int(shares))).alias("__share")
    sizes = groups.select("__n", share).groupBy("__n").agg(F.collect_set("__share").alias("shares"))

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for n, part in frame.groupby("__n", sort=False):
                drawn = np.zeros(replicates, np.int64)
                for i in part["__block"].tolist():
                    for _, counts in drawn_counts(int(n), i * places, min(int(n), (i + 1) * places), replicates, block):
                        drawn += counts.sum(0, dtype=np.int64)
                yield pd.DataFrame([(n, part["shares"].iloc[0], drawn)], columns=["__n", "shares", "drawn"])

    blocks = sizes.withColumn("__block", F.explode(F.sequence(F.lit(0), F.floor((F.col("__n") - 1) / places)))).repartition(parts)
    drawn = blocks.mapInPandas(draw, "__n long, shares array<int>, drawn array<long>").select("__n", "shares", F.posexplode("drawn").alias("rep", "drawn"))
    totals = drawn.groupBy("__n", (F.col("rep") + 1).cast("long").alias("rep")).agg(F.sum("drawn").alias("drawn"), F.first("shares").alias("shares"))
    totals = written(totals, new_folder(spark, "resample"))
    fits = F.col("drawn") <= F.col("__n")
    lacking = F.when(fits, F.col("__n") - F.col("drawn")).otherwise(F.col("__n"))

    def pick(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for n, part in frame.groupby("__n", sort=False):
                for number, *picks in picked_blocks(int(n), part["rep"].to_numpy(), part["lacking"].to_numpy(), places):
                    yield pd.DataFrame([(n, number, i, *picks) for i in part["shares"].iloc[0]], columns=["__n", "__block", "__share", "reps", "ats"])

    def add(picks: pd.DataFrame, values: pd.DataFrame) -> pd.DataFrame:
        columns = [*by, "__n", "held", "more"]
        if not len(values):
            return pd.DataFrame(columns=columns)
        n, begin = int(values["__n"].iloc[0]), int(values["__block"].iloc[0]) * places
        found = list(values.groupby(by, sort=False).indices.items())
        x = np.zeros((len(found), min(places, n - begin)))
        for i, (_, at) in enumerate(found):
            x[i, values["__spot"].to_numpy()[at]] = values["__x"].to_numpy()[at]
        held, more = np.zeros((len(found), replicates)), np.zeros((len(found), replicates))
        for i, counts in drawn_counts(n, begin, begin + x.shape[1], replicates, block):
            held += x[:, i - begin : i - begin + len(counts)] @ counts.astype(float)
        for reps, ats in zip(picks["reps"], picks["ats"]):
            for i in range(len(found)):
                more[i] += np.bincount(reps - 1, x[i, ats], replicates)
        keys = zip(*(key if isinstance(key, tuple) else (key,) for key, _ in found))
        key = {c: pd.Series(k, dtype=object) for c, k in zip(by, keys)}  # plain: strings of other kinds come in chunks
        return pd.DataFrame(key | {"__n": n, "held": list(held), "more": list(more)}, columns=columns)

    # Picks and rows meet by block of places: a join of single picks would be sent whole to every task while its tables look small.
    # The number of tasks is told, as blocks are small to Spark and long to work on.
    meet = ["__n", "__block", "__share"]
    wanting = totals.select("__n", "rep", "shares", lacking.alias("lacking")).where("lacking > 0").repartition(parts)
    picks = wanting.mapInPandas(pick, "__n long, __block long, __share int, reps array<int>, ats array<int>").repartition(parts, *meet)
    values = rows.withColumn("__share", share).repartition(parts, *meet)
    met = picks.groupBy(*meet).cogroup(values.groupBy(*meet)).applyInPandas(add, "".join(f"`{c}` {kinds[c]}, " for c in by) + "__n long, held array<double>, more array<double>")
    each = met.select(*by, "__n", F.posexplode(F.arrays_zip("held", "more")).alias("rep", "s")).groupBy(*by, "__n", (F.col("rep") + 1).cast("long").alias("rep"))
    whole = each.agg(F.sum("s.held").alias("held"), F.sum("s.more").alias("more")).join(totals.select("__n", "rep", "drawn"), ["__n", "rep"])
    return whole.select(*by, "rep", ((F.when(fits, F.col("held")).otherwise(0.0) + F.col("more")) / F.col("__n")).alias("mean"))


def intervals(means: DataFrame, by: list[str], mean: str = "mean") -> DataFrame:
    """The percentiles of each group's replicates, as many as were drawn."""
    return means.groupBy(*by).agg(*[F.percentile(mean, q).alias(n) for n, q in INTERVAL.items()])


def bootstrap_means(df: DataFrame, value: str, by: list[str], row_order: list[str], replicates: int = 1000, kind: str = "mean", over: DataFrame | None = None) -> DataFrame:
    """Intervals of the mean, or of the geometric mean of values above 0. ``over``: as in ``multinomial_means``, for the mean alone."""
    if kind == "gmean":
        df = df.where(F.col(value) > 0).withColumn(value, F.ln(value))
    means = multinomial_means(df, value, by, row_order, replicates, over=over)
    return intervals(means.withColumn("mean", F.exp("mean")) if kind == "gmean" else means, by)


def upper_tails(n: int, least: int, k: np.ndarray) -> np.ndarray:
    """P(X >= least) of n draws with chances k / n near a half, by their terms up to where these vanish."""
    j = np.arange(least, min(n, least + int(9 * sqrt(n)) + 60) + 1)
    front = np.array([lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) for i in j.tolist()])
    out = np.where(k >= n, 1.0, 0.0)
    inner = np.flatnonzero((k > 0) & (k < n))
    for some in np.array_split(inner, len(inner) * len(j) // (1 << 22) + 1):
        p = k[some, None] / n
        out[some] = np.exp(front + j * np.log(p) + (n - j) * np.log1p(-p)).sum(1)
    return out


def median_law(df: DataFrame, value: str, by: list[str], deviations: float = 7.0, reach: int = 40) -> DataFrame:
    """``by``, median, chance: the law of the median of a resample of each group. Of an even number of rows, the median is the mean of the two
    middle draws; values whose places are further apart than ``reach`` have a chance below exp(-40)."""
    import pandas as pd

    rows = placed(df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("__x")), by, ["__x"], "__at", "__n")
    rows = rows.withColumn("__k", (F.col("__at") + 1).cast("double")).withColumn("__n", F.col("__n").cast("double"))
    near = F.abs(F.col("__k") - F.col("__n") / 2) <= deviations * F.sqrt("__n") / 2 + reach
    rows = rows.where(near).select(*by, "__x", "__k", "__n")

    def tails(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for n, part in frame.groupby("__n", sort=False):
                m = (int(n) + 1) // 2
                part["__before"] = upper_tails(int(n), m, part["__k"].to_numpy() - 1)
                part["__upto"] = upper_tails(int(n), m if n % 2 else m + 1, part["__k"].to_numpy())
                yield part

    kinds = dict(df.dtypes)
    rows = written(rows.mapInPandas(tails, "".join(f"`{c}` {kinds[c]}, " for c in by) + "__x double, __k double, __n double, __before double, __upto double"), new_folder(df.sparkSession, "median"))
    m = F.floor((F.col("__n") + 1) / 2).cast("double")
    odd = F.col("__n") % 2 == 1
    # Both middle draws have the value at k: those up to it pass the middle, those before it do not reach it.
    log_c = lambda n, m: log_gamma(n + 1) - log_gamma(m + 1) - log_gamma(n - m + 1)
    power = lambda base, e: F.when(e == 0, F.lit(0.0)).when(base > 0, e * F.ln(base))
    split = F.coalesce(F.exp(log_c(F.col("__n"), m) + power((F.col("__k") - 1) / F.col("__n"), m) + power(1 - F.col("__k") / F.col("__n"), F.col("__n") - m)), F.lit(0.0))
    alone = F.col("__upto") - F.col("__before") + F.when(odd, 0.0).otherwise(split)
    same = rows.select(*by, F.col("__x").alias("median"), alone.alias("chance"))
    # The lower middle draw has place i, the upper one place i + g: m draws up to i, not all before it, and the least of the rest at i + g.
    pairs = rows.where(~odd).select(*by, F.col("__x").alias("__low"), F.col("__k").alias("__i"), "__n", F.explode(F.sequence(F.lit(1), F.lit(reach))).alias("__g"))
    pairs = pairs.withColumn("__k", F.col("__i") + F.col("__g")).where("__k <= __n").join(rows.select(*by, "__k", F.col("__x").alias("__high")), [*by, "__k"])
    n, i, k = F.col("__n"), F.col("__i"), F.col("__k")
    rest = n - m
    # In logarithms, as the binomial coefficient alone passes a double's range.
    front = log_c(n, m) + power(i / n, m) + power((n - k + 1) / n, rest)
    earlier = F.coalesce(F.exp(power((i - 1) / i, m)), F.lit(0.0))
    later = F.coalesce(F.exp(power((n - k) / (n - k + 1), rest)), F.lit(0.0))
    apart = pairs.select(*by, ((F.col("__low") + F.col("__high")) / 2).alias("median"), (F.exp(front) * (1 - earlier) * (1 - later)).alias("chance"))
    return same.unionByName(apart).where("chance > 0")


def median_intervals(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """The percentiles of ``median_law``: the least median whose chance with all below it reaches the share."""
    law = median_law(df, value, by).groupBy(*by, "median").agg(F.sum("chance").alias("chance"))
    order = Window.partitionBy(*by).orderBy("median")  # a few square roots of a group's rows
    told = law.withColumn("total", F.sum("chance").over(order))
    return told.groupBy(*by).agg(*[F.min(F.when(F.col("total") >= q - 1e-9, F.col("median"))).alias(n) for n, q in INTERVAL.items()])
