"""Grouped regression: features, closed-form ridge, metrics. Learners of groups are in ``learners``, the covariate model in ``covariate``.

Fits that the reference runs as one process a condition take a ``group`` column here. Gram sums are one
aggregation over all groups, and each group's system is solved in a task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from editloom.functions.special import hash_int
from editloom.operators.ranges import value_counts

NTS = ("A", "C", "G", "T")


def one_hot(text: Column, length: int, letters: str = "".join(NTS)) -> Column:
    """L1: 0/1 for each position and nucleotide, A C G T; none past the end of a shorter text."""
    return F.array(*[F.when(F.substring(text, i + 1, 1) == n, 1.0).otherwise(0.0) for i in range(length) for n in letters])


def feature_names(length: int) -> list[str]:
    return [f"{i}{n}" for i in range(length) for n in NTS]


def split(name: Column, seed: str = "0") -> Column:
    """L2: train for three draws of four, told by a hash of the name."""
    return F.when(F.pmod(hash_int(F.concat_ws("|", F.lit(seed), name)), F.lit(4)) < 3, "train").otherwise("test")


def gram(df: DataFrame, group: str, features: str, target: str, weight: str | None = None) -> DataFrame:
    """Per group the sums a linear fit needs: rows of (i, j, value) over features, a constant and the target."""
    w = F.col(weight) if weight else F.lit(1.0)
    vector = F.concat(F.col(features), F.array(F.lit(1.0), F.col(target).cast("double")))
    rows = df.where(F.col(target).isNotNull()).select(F.col(group).alias("group"), vector.alias("x"), w.alias("w"))
    # Only non-zero entries meet: one-hot rows make few pairs.
    entries = lambda x: F.filter(F.transform(x, lambda v, i: F.struct(i.alias("i"), v.alias("v"))), lambda e: e["v"] != 0)
    left = rows.select("group", "w", entries(F.col("x")).alias("es")).select("group", "w", "es", F.explode("es").alias("a"))
    pairs = left.select("group", "w", "a", F.explode("es").alias("b")).where("a.i <= b.i")
    return pairs.groupBy("group", F.col("a.i").alias("i"), F.col("b.i").alias("j")).agg(F.sum(F.col("w") * F.col("a.v") * F.col("b.v")).alias("value"))


def ridge(df: DataFrame, group: str, features: str, target: str, names: list[str], alpha: float = 1.0, intercept: bool = True, weight: str | None = None) -> DataFrame:
    """Group, feature, coefficient, of the features that a group has. The intercept is not penalised; a constant
    without intercept is left out. Each group's system, at most (features + 2)**2 sums, is solved in a task."""
    import pandas as pd

    n = len(names)

    def solve(sums: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros((n + 2, n + 2))
        m[sums["i"], sums["j"]] = m[sums["j"], sums["i"]] = sums["value"]
        has = [i for i in range(n + int(intercept)) if m[i, i] > 0]
        left = m[np.ix_(has, has)] + np.diag([alpha if i < n else 0.0 for i in has])
        solved = np.linalg.lstsq(left, m[has, n + 1], rcond=None)[0]
        return pd.DataFrame({"group": sums["group"].iloc[0], "feature": [[*names, "intercept"][i] for i in has], "coefficient": solved})

    return gram(df, group, features, target, weight).groupBy("group").applyInPandas(solve, "group string, feature string, coefficient double")


def ridge_residuals(df: DataFrame, group: str, features: str, target: str, names: list[str], fit: DataFrame, alpha: float = 1.0) -> DataFrame:
    """group, feature, residual: what a fit with intercept leaves of its normal equations, X'(y - Xb) - alpha * b."""
    table = fit.groupBy("group").agg(F.map_from_entries(F.collect_list(F.struct("feature", "coefficient"))).alias("b"))  # a group's features
    named = F.transform(F.col(features), lambda v, i: F.struct(F.element_at(F.array(*[F.lit(x) for x in names]), i + 1).alias("feature"), v.alias("v")))
    entries = F.concat(F.filter(named, lambda e: e["v"] != 0), F.array(F.struct(F.lit("intercept").alias("feature"), F.lit(1.0).alias("v"))))
    rows = df.where(F.col(target).isNotNull()).select(F.col(group).alias("group"), F.col(target).alias("y"), entries.alias("x")).join(table, "group")
    left = F.col("y") - F.aggregate("x", F.lit(0.0), lambda a, e: a + e["v"] * F.element_at("b", e["feature"]))
    sums = rows.withColumn("left", left).select("group", "left", F.explode("x").alias("e")).groupBy("group", F.col("e.feature").alias("feature")).agg(F.sum(F.col("left") * F.col("e.v")).alias("slope"))
    penalty = F.when(F.col("feature") == "intercept", 0.0).otherwise(alpha) * F.col("coefficient")
    return sums.join(fit, ["group", "feature"]).select("group", "feature", (F.col("slope") - penalty).alias("residual"))


def two_way(df: DataFrame, value: str, factors: tuple[str, str], weight: str | None = None, alpha: float = 1e-10) -> DataFrame:
    """Weighted regression of a log ratio on two factors, no intercept, by Gram sums: factor, level, coefficient."""
    a, b = factors
    w = F.col(weight) if weight else F.lit(1.0)
    rows = df.where(F.col(value) > 0).select(F.concat(F.lit(f"{a}="), F.col(a)).alias("a"), F.concat(F.lit(f"{b}="), F.col(b)).alias("b"), F.ln(value).alias("y"), w.alias("w"))
    cells = rows.groupBy("a", "b").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("wy")).collect()  # levels of both factors
    levels = sorted({x for c in cells for x in (c.a, c.b)})
    at = {x: i for i, x in enumerate(levels)}
    left, right = np.eye(len(levels)) * alpha, np.zeros(len(levels))
    for c in cells:
        for x in (c.a, c.b):
            right[at[x]] += c.wy
            for y in (c.a, c.b):
                left[at[x], at[y]] += c.w
    solved = np.linalg.lstsq(left, right, rcond=1e-14)[0] if levels else []
    out = [(*x.split("=", 1), float(c)) for x, c in zip(levels, solved)]
    return df.sparkSession.createDataFrame(out, "factor string, level string, coefficient double")


def classification_metrics(df: DataFrame, label: str, score: str, by: list[str]) -> DataFrame:
    """Area under the curve (average ranks), average precision, cross-entropy, all from the counts of each score."""
    counts = value_counts(df, by, score, label)
    p = F.least(F.greatest(F.col(score), F.lit(1e-15)), F.lit(1 - 1e-15))
    ones, n = F.col("ones"), F.col("n")
    hits, seen = F.col("ones_before_all") - F.col("ones_before"), F.col("before_all") - F.col("before")  # at this score and above
    sums = counts.groupBy(*by).agg(
        F.sum(ones).alias("n1"), F.sum(n - ones).alias("n0"), F.sum(ones * (F.col("before") + (n + 1) / 2.0)).alias("r1"),
        F.sum(ones * hits / seen).alias("ap"), (-F.sum(ones * F.ln(p) + (n - ones) * F.ln(1 - p)) / F.sum(n)).alias("cross_entropy"),
    )
    return sums.select(*by, F.try_divide(F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2, F.col("n1") * F.col("n0")).alias("auc"), F.try_divide(F.col("ap"), F.col("n1")).alias("average_precision"), "cross_entropy")
