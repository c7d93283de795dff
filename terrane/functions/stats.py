"""Statistics of proportions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.96
#: Coefficients of the complementary error function's fit, from the constant term up.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def wilson(correct: Column, n: Column) -> tuple[Column, Column, Column]:
    """(share, lower, upper) of the 95 % score interval; all 0 where n is 0."""
    p = F.try_divide(correct, n)
    half = Z95 * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(Z95 * Z95 / 4), n * n))
    mid, scale = p + F.try_divide(F.lit(Z95 * Z95 / 2), n), 1 + F.try_divide(F.lit(Z95 * Z95), n)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return zero(p), zero((mid - half) / scale), zero((mid + half) / scale)


def erfc(x: Column) -> Column:
    z = F.abs(x)
    t = 1 / (1 + 0.5 * z)
    poly = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        poly = c + t * poly
    tail = t * F.exp(poly - z * z)
    return F.when(x >= 0, tail).otherwise(2 - tail)


def mcnemar(b: Column, c: Column) -> tuple[Column, Column]:
    """(statistic, p) with continuity correction, not clamped; (0, 1) without discordant pairs."""
    stat = F.coalesce(F.try_divide(F.pow(F.abs(b - c) - 1, 2), b + c), F.lit(0.0))
    return stat, F.when(b + c == 0, F.lit(1.0)).otherwise(erfc(F.sqrt(stat / 2)))


def half_up(x: Column) -> Column:
    """Nearest whole number, halves up, also below zero."""
    return F.floor(x + 0.5).cast("long")
