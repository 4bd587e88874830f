"""Decimal rounding of binary doubles, half to even on the exact value, and means free of summation order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

_SPLIT = 134217729.0  # 2 ** 27 + 1: halves a double's digits


def exact_round(x: Column, digits: int = 4) -> Column:
    """``x`` to so many decimals. The product x * 10 ** digits is corrected by its exact error, so ties are told by the true value."""
    m = F.lit(10.0**digits)
    a = F.abs(x.cast("double"))
    p = a * m
    c = a * F.lit(_SPLIT)
    high = c - (c - a)
    error = (high * m - p) + (a - high) * m
    f = F.floor(p).cast("double")
    d = p - f - 0.5
    up = (d > 0) | ((d == 0) & ((error > 0) | ((error == 0) & (f % 2 == 1))))
    return F.signum(x.cast("double")) * (F.when((d == 0) & (error < 0), f).when(up, f + 1).otherwise(f) / m)


def exact_mean(x: Column) -> Column:
    """Mean of values of at most four decimals; 0 of none. The sum is exact, so no order of rows changes it."""
    return F.coalesce(F.sum(x.cast("decimal(18,4)")).cast("double") / F.count(x), F.lit(0.0))


def rounded_means(df: DataFrame | GroupedData, means: dict[str, Column | tuple[Column, int]], *others: Column) -> DataFrame:
    """Aggregates ``others`` and rounded means by name (a column, or one with its decimals; 4 by default).

    Rounding stands above the aggregate: there Spark shares its repeated terms, and the code of the
    aggregate stays within what the JVM compiles.
    """
    of = {n: m if isinstance(m, tuple) else (m, 4) for n, m in means.items()}
    out = df.agg(*others, *[exact_mean(c).alias(n) for n, (c, _) in of.items()])
    return out.withColumns({n: exact_round(F.col(f"`{n}`"), d) for n, (_, d) in of.items()})
