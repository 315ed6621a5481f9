"""Special functions as column expressions, inside the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")
#: Below this dispersion the zero probability takes its exponential form.
SMALL_DISPERSION = 1e-5


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0, relative error below 1e-13 down to underflow.

    Below 2 by the series of erf, from 2 on by the continued fraction.
    """
    start = F.struct(x.alias("t"), x.alias("s"))

    def term(acc, k):
        t = acc["t"] * (2 * x * x / (2 * k + 3))
        return F.struct(t.alias("t"), (acc["s"] + t).alias("s"))

    series = F.aggregate(F.sequence(F.lit(0), F.lit(59)), start, term, lambda acc: acc["s"])
    fraction = F.aggregate(F.sequence(F.lit(120), F.lit(1), F.lit(-1)), x, lambda acc, k: x + (k / 2) / acc)
    tail = F.exp(-x * x)
    return F.when(x < 2, 1 - 2 / math.sqrt(math.pi) * tail * series).otherwise(tail / math.sqrt(math.pi) / fraction)


def chi_square_tail(s: Column) -> Column:
    """P(X > s) of the chi-square distribution with one degree of freedom."""
    return F.when(s <= 0, F.lit(1.0)).when(s > 2900, F.lit(0.0)).otherwise(erfc(F.sqrt(F.greatest(s, F.lit(0.0)) / 2)))


def log_neg_log(p: Column) -> Column:
    """ln(-ln p), with minus infinity at 1 and infinity at 0."""
    return F.when(p >= 1, F.lit(-INF)).when(p <= 0, F.lit(INF)).otherwise(F.log(-F.log(p)))


def probability_of_zero(dispersion: Column, mu: Column) -> Column:
    """Probability of a zero count at mean ``mu``; dispersion may be negative or infinite."""
    a = dispersion
    return (
        F.when(a == -INF, F.lit(0.0))
        .when(F.isnan(a) | F.isnan(mu), F.lit(float("nan")))
        .when(a < SMALL_DISPERSION, F.when((mu == INF) & (a < 1), F.lit(float("nan"))).otherwise(F.exp((a - 1) * mu)))
        .when(a == INF, F.lit(1.0))
        .otherwise(F.exp(-F.log1p(a * mu) / a))
    )


def round_even(x: Column) -> Column:
    """To the nearest integer, halves to even."""
    return F.bround(x, 0)
