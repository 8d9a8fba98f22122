"""Order statistics over the window of a slice, as Columns."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .vectors import _c


def over(keys: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys)


def rank_pct(x, keys: list[str]) -> Column:
    """Share of the slice that is not above the row (ties get the highest)."""
    return F.cume_dist().over(over(keys).orderBy(_c(x)))


def tail_p(x, keys: list[str]) -> Column:
    """Descending rank (ties highest) over n + 1: an empirical p-value."""
    n = F.count(F.lit(1)).over(over(keys))
    return F.cume_dist().over(over(keys).orderBy(_c(x).desc())) * n / (n + 1)


def quantile(x, q: float, keys: list[str]) -> Column:
    return F.percentile(_c(x), F.lit(q)).over(over(keys))


def minmax(x, keys: list[str], lo: float = 5.0, hi: float = 95.0) -> Column:
    """Scaled between two percentiles (linear interpolation) and clipped to [0, 1]; a flat slice divides by 1."""
    a, b = quantile(x, lo / 100, keys), quantile(x, hi / 100, keys)
    return clip((_c(x) - a) / F.when(b <= a, F.lit(1.0)).otherwise(b - a), 0.0, 1.0)


def clip(x, lo: float, hi: float) -> Column:
    """Null stays null (greatest and least alone would skip it)."""
    return F.when(_c(x).isNotNull(), F.least(F.greatest(_c(x), F.lit(lo)), F.lit(hi)))


def median(x, keys: list[str]) -> Column:
    return F.median(_c(x)).over(over(keys))


def with_mad(df, x: str, keys: list[str], med: str = "_med", mad: str = "_mad"):
    """Adds the slice's median and (unscaled) median absolute deviation."""
    df = df.withColumn(med, median(x, keys))
    return df.withColumn(mad, F.median(F.abs(F.col(x) - F.col(med))).over(over(keys)))


def robust_z(x: str, med: str = "_med", mad: str = "_mad", eps: float = 1e-12) -> Column:
    return (F.col(x) - F.col(med)) / (F.when(F.col(mad) == 0, F.lit(1.0)).otherwise(F.col(mad)) + eps)


def sigmoid(x, limit: float = 50.0) -> Column:
    return 1 / (1 + F.exp(-clip(x, -limit, limit)))
