"""Column functions on vectors held as arrays; arithmetic is double whatever the stored type."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_double(v) -> Column:
    return _c(v).cast("array<double>")


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(as_double(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine_similarity(a, b) -> Column:
    """0 where either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def cosine_distance(a, b) -> Column:
    return 1 - cosine_similarity(a, b)


def l2_normalize(a, eps: float = 1e-12) -> Column:
    n = norm(a) + eps
    return F.transform(as_double(a), lambda x: x / n)


def dequantise(a, nodata: int = -128, scale: float = 127.0) -> Column:
    """Small integers to [-1, 1]; a vector of nothing but ``nodata`` is null."""
    return F.when(F.forall(_c(a), lambda x: x == nodata), F.lit(None)).otherwise(F.transform(_c(a), lambda x: x / F.lit(scale)))


def vector_columns(df: DataFrame, prefix: str = "embedding_") -> list[str]:
    """The wide columns of a vector, by their integer suffix."""
    found = [(int(m.group(1)), c) for c in df.columns if (m := re.fullmatch(re.escape(prefix) + r"(\d+)", c))]
    return [c for _, c in sorted(found)]


def pack(df: DataFrame, prefix: str = "embedding_", out: str = "embedding") -> DataFrame:
    cols = vector_columns(df, prefix)
    if not cols:
        raise ValueError(f"no columns {prefix}<n>")
    return df.withColumn(out, F.array(*cols)).drop(*cols)


def unpack(df: DataFrame, width: int, col: str = "embedding", prefix: str = "embedding_") -> DataFrame:
    """A vector to wide columns; a row of another width fails."""
    ok = F.when(F.size(col) == width, F.col(col)).otherwise(F.raise_error(F.lit(f"a vector has not {width} entries")))
    df = df.withColumn(col, ok)
    return df.select(*[c for c in df.columns if c != col], *[F.element_at(col, i + 1).alias(f"{prefix}{i}") for i in range(width)])


def centroids(df: DataFrame, keys: list[str], col: str = "embedding", how: str = "mean", out: str = "centroid") -> DataFrame:
    """One vector for each group: the mean or the median of every dimension."""
    agg = {"mean": F.avg, "median": F.median}[how]
    cells = df.select(*keys, F.posexplode(as_double(col)).alias("_d", "_x"))
    per = cells.groupBy(*keys, "_d").agg(agg("_x").alias("_m"))
    return per.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_d", "_m"))), lambda s: s["_m"]).alias(out))


def standardise(df: DataFrame, keys: list[str], id_col: str, col: str = "embedding", eps: float = 1e-6) -> DataFrame:
    """Rows (keys..., id, dimension, value) with each dimension centred and scaled by its population deviation."""
    cells = df.select(*keys, id_col, F.posexplode(as_double(col)).alias("dim", "x"))
    stats = cells.groupBy("dim").agg(F.avg("x").alias("_m"), F.stddev_pop("x").alias("_s"))
    return cells.join(F.broadcast(stats), "dim").select(*keys, id_col, "dim", ((F.col("x") - F.col("_m")) / (F.col("_s") + eps)).alias("z"))
