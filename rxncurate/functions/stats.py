"""Rates, intervals and the number texts of published tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the 97.5 % point of the normal distribution.
Z95 = 1.959963984540054


def rate(num: Column, den: Column, empty: float | None = None) -> Column:
    """num / den as DOUBLE; `empty` (null unless given) where den is 0."""
    return F.when(den > 0, num.cast("double") / den).otherwise(F.lit(empty).cast("double"))


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Lower and upper end of the Wilson score interval of k out of n, inside [0, 1]; null for n = 0."""
    p = k.cast("double") / n
    zz = F.lit(z * z)
    centre = (p + zz / (2 * n)) / (1 + zz / n)
    half = F.lit(z) * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    some = lambda c: F.when(n > 0, c)
    return some(F.greatest(F.lit(0.0), centre - half)), some(F.least(F.lit(1.0), centre + half))


def percent_text(c: Column) -> Column:
    """A ratio as percent with four decimals."""
    return F.format_string("%.4f", c.cast("double") * 100)


def interval_text(value: Column, low: Column, high: Column) -> Column:
    """Percent and its interval: 75.0000 (50.0000–90.0000)."""
    return F.concat(percent_text(value), F.lit(" ("), percent_text(low), F.lit("–"), percent_text(high), F.lit(")"))


def one_decimal(c: Column) -> Column:
    """Half-up rounding to one decimal."""
    return F.round(c, 1)
