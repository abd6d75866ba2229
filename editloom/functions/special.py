"""Special functions as Columns: log gamma, incomplete beta, binomial and F tails, hash draws.

Everything stays in JVM expressions; loops are ``aggregate`` over a sequence of fixed length.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log, pi

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lanczos coefficients for g = 7, n = 9.
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def hash_int(text: Column) -> Column:
    """A draw from 0 .. 2**32-1 by the first eight hexadecimal digits of md5."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def lgamma(x: Column) -> Column:
    """log gamma for x > 0; null at 0 and below where it has poles."""
    z = x - 1
    total = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        total = total + F.try_divide(F.lit(c), z + i)
    t = z + 7.5
    return F.lit(0.5 * log(2 * pi)) + (z + 0.5) * F.ln(t) - t + F.ln(total)


def betainc(a: Column, b: Column, x: Column, steps: int = 60) -> Column:
    """Regularised incomplete beta I_x(a, b) for a, b > 0, by its continued fraction on the side where it converges."""
    a, b, x = a.cast("double"), b.cast("double"), x.cast("double")
    front = F.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * F.ln(x) + b * F.ln(1 - x))

    def fraction(s: Column) -> Column:
        p, q, y = s["p"], s["q"], s["y"]
        term = lambda j: F.when(  # noqa: E731  odd terms, then even ones
            j % 2 == 1, -(p + (j - 1) / 2) * (p + q + (j - 1) / 2) * y / ((p + j - 1) * (p + j))
        ).otherwise((j / 2) * (q - j / 2) * y / ((p + j - 1) * (p + j)))
        start = F.struct(F.lit(1.0).alias("c"), F.lit(0.0).alias("d"), F.lit(1.0).alias("h"))

        def step(at: Column, j: Column) -> Column:
            return let(
                F.struct((1 + term(j) / at["c"]).alias("c"), (1 / (1 + term(j) * at["d"])).alias("d"), at["h"].alias("h")),
                lambda v: F.struct(v["c"].alias("c"), v["d"].alias("d"), (v["h"] * v["c"] * v["d"]).alias("h")),
            )

        return F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(2 * steps)), lambda j: j.cast("double")), start, step, lambda s: 1 / s["h"])

    direct = x < (a + 1) / (a + b + 2)
    side = F.struct(F.when(direct, a).otherwise(b).alias("p"), F.when(direct, b).otherwise(a).alias("q"), F.when(direct, x).otherwise(1 - x).alias("y"))
    part = front * let(side, lambda s: fraction(s) / s["p"])
    return F.when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0)).otherwise(F.when(direct, part).otherwise(1 - part))


def binom_sf(k: Column, n: Column, p: Column, steps: int = 60) -> Column:
    """P(X >= k) for a binomial of n trials; k and n are floored."""
    k, n = F.floor(k).cast("double"), F.floor(n).cast("double")
    return F.when(k <= 0, F.lit(1.0)).when(k > n, F.lit(0.0)).otherwise(betainc(k, n - k + 1, p, steps))


def binom_cdf(k: Column, n: Column, p: Column, steps: int = 60) -> Column:
    """P(X <= k)."""
    return 1 - binom_sf(F.floor(k) + 1, n, p, steps)


def f_sf(f: Column, d1: Column, d2: Column, steps: int = 60) -> Column:
    """Upper tail of the F distribution."""
    return F.when((d1 > 0) & (d2 > 0) & f.isNotNull(), betainc(d2 / 2.0, d1 / 2.0, F.try_divide(d2, d2 + d1 * f), steps))


def t_two_sided(t: Column, df: Column, steps: int = 60) -> Column:
    return betainc(df / 2.0, F.lit(0.5), df / (df + t * t), steps)


def normal_two_sided(z: Column) -> Column:
    """2 P(Z > |z|), from the complementary error function's rational form (absolute error below 1.2e-7)."""
    x = F.abs(z) / F.lit(2.0**0.5)
    t = 1 / (1 + 0.5 * x)
    #: A rational Chebyshev fit of erfc.
    coefficients = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    power = F.lit(0.0)
    for c in reversed(coefficients):
        power = power * t + F.lit(c)
    return t * F.exp(-x * x + power)


def binom_minus_binom(k: Column, t_p: Column, c_p: Column, n: Column, most: int = 400, least: float = 1e-6) -> Column:
    """Chance that treatment errors exceed control errors by k or more among n reads: the sum over i of
    P(control = i) P(treatment >= i + k), up to the first term of at most ``least``."""
    k, n = F.floor(k).cast("double"), F.floor(n).cast("double")
    log_pmf = lambda x, p: lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1) + x * F.ln(p) + (n - x) * F.ln(1 - p)
    first = F.struct(
        F.exp(n * F.ln(1 - c_p)).alias("control"), F.when(k > n, 0.0).otherwise(F.exp(log_pmf(F.least(k, n), t_p))).alias("at"),
        binom_sf(k, n, t_p).alias("tail"), F.lit(0.0).alias("total"), F.lit(False).alias("done"),
    )

    def step(s: Column, i: Column) -> Column:
        term = s["control"] * s["tail"]
        return F.when(s["done"], s).otherwise(
            F.struct(
                (s["control"] * (n - i) / (i + 1) * c_p / (1 - c_p)).alias("control"),
                (s["at"] * F.greatest(n - k - i, F.lit(0.0)) / (k + i + 1) * t_p / (1 - t_p)).alias("at"),
                F.greatest(s["tail"] - s["at"], F.lit(0.0)).alias("tail"), (s["total"] + term).alias("total"), (term <= least).alias("done"),
            )
        )

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(most)), lambda i: i.cast("double")), first, step, lambda s: s["total"])


def pearson(x: Column | str, y: Column | str) -> Column:
    """Correlation as an aggregate; null where a side does not vary (``corr`` would fail in ANSI mode)."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
