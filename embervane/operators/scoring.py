"""Scores of rows within their slice: distances, norms, ranks, robust z."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import stats, vectors
from ..session import cut
from . import kernels

MIN_SCORED = 50
SCORES = (
    "cosine_distance", "knn_distance", "cos_norm", "knn_norm", "S", "cos_rank", "knn_rank", "S_rank", "S_rank_min",
    "cos_z", "knn_z", "S_z", "rank_percentile", "mean_score",
)


def trimmed_centroids(df: DataFrame, keys: list[str], id_col: str, vec: str = "embedding", trim: float = 0.05, n_iter: int = 2) -> DataFrame:
    """(keys..., centroid): the mean of the rows nearest to the last centroid, ``n_iter`` times; ties by id.

    Each pass keeps max(ceil((1 - trim) * n), 3) rows; slices of fewer than five keep their mean.
    """
    trim = min(max(trim, 0.0), 0.49)
    w = Window.partitionBy(*keys)
    current = vectors.centroids(df, keys, vec)
    base = df.select(*keys, id_col, vec).withColumn("_n", F.count("*").over(w))
    keep = F.when(F.col("_n") < 5, F.col("_n")).otherwise(F.greatest(F.ceil((1 - trim) * F.col("_n")), F.lit(3)))
    for _ in range(n_iter):
        near = base.join(current, keys).withColumn("_d", vectors.cosine_distance(vec, "centroid"))
        near = near.withColumn("_r", F.row_number().over(w.orderBy("_d", id_col))).where(F.col("_r") <= keep)
        current = vectors.centroids(near.select(*keys, vec), keys, vec)
    return current


def slice_centroids(df: DataFrame, keys: list[str], id_col: str, mode: str = "trimmed", trim: float = 0.10, vec: str = "embedding") -> DataFrame:
    if mode == "trimmed":
        return trimmed_centroids(df, keys, id_col, vec, trim)
    if mode in ("mean", "median"):
        return vectors.centroids(df, keys, vec, mode)
    raise ValueError(f"unknown mode {mode}")


def complete(df: DataFrame, keys: list[str], percentiles: tuple[float, float] = (5.0, 95.0)) -> DataFrame:
    """From cosine_distance and knn_distance to all scores; one exchange on the slice keys."""
    lo, hi = percentiles
    for x, s in (("cosine_distance", "cos"), ("knn_distance", "knn")):
        df = stats.with_mad(df, x, keys)
        df = df.withColumns({f"{s}_norm": stats.minmax(x, keys, lo, hi), f"{s}_rank": stats.rank_pct(x, keys), f"{s}_z": stats.robust_z(x)}).drop("_med", "_mad")
    df = df.withColumns(
        {
            "S": (F.col("cos_norm") + F.col("knn_norm")) / 2,
            "S_rank": (F.col("cos_rank") + F.col("knn_rank")) / 2,
            "S_rank_min": F.least("cos_rank", "knn_rank"),
            "S_z": (stats.sigmoid("cos_z") + stats.sigmoid("knn_z")) / 2,
        }
    )
    df = df.withColumn("rank_percentile", stats.rank_pct("S_rank", keys))
    return df.withColumn("mean_score", (F.col("S_rank") + F.col("S_rank_min") + F.col("S_z")) / 3)


def score_slices(
    df: DataFrame, keys: list[str], id_col: str, vec: str = "embedding", k: int = 10, mode: str = "trimmed", trim: float = 0.10,
    percentiles: tuple[float, float] = (5.0, 95.0), min_scored: int = MIN_SCORED,
) -> DataFrame:
    """Rows with slice_n, scored and the fourteen scores; all of them 0 in slices of fewer than ``min_scored`` rows."""
    df = df.withColumn("slice_n", F.count("*").over(Window.partitionBy(*keys)))
    big, small = df.where(F.col("slice_n") >= min_scored), df.where(F.col("slice_n") < min_scored)
    centre = slice_centroids(big, keys, id_col, mode, trim, vec)
    near = kernels.knn_distance(big, keys, id_col, vec, k)
    scored = big.join(centre, keys).withColumn("cosine_distance", vectors.cosine_distance(vec, "centroid")).drop("centroid").join(near, id_col)
    scored = complete(scored, keys, percentiles).withColumn("scored", F.lit(True))
    zero = small.withColumns({s: F.lit(0.0) for s in SCORES}).withColumn("scored", F.lit(False))
    return scored.unionByName(zero)


def score_hierarchy(
    df: DataFrame, labels: list[str], context: list[str], id_col: str, min_size: int, vec: str = "embedding", k: int = 10, mode: str = "trimmed",
    trim: float = 0.10, percentiles: tuple[float, float] = (5.0, 95.0), min_scored: int = MIN_SCORED,
) -> DataFrame:
    """Rows scored against the group of their reference level: rows of a small class stand in all rows of the coarser one.

    ``df`` has the columns of ``slices.reference_level``; ids must be unique.
    """
    groups = None
    for i, lab in enumerate(labels):
        wanted = df.where(F.col("ref_level") == i).select(*context, F.col("ref_class")).distinct()
        rows = df.withColumn("_class", F.col(lab).cast("string")).join(wanted.withColumnRenamed("ref_class", "_class"), [*context, "_class"], "left_semi")
        part = rows.withColumn("_level", F.lit(i)).withColumn("_target", F.col("ref_level") == i)
        groups = part if groups is None else groups.unionByName(part)
    keys = [*context, "_level", "_class"]
    near_id = groups.withColumn("_id", F.struct(F.col(id_col), "_level"))
    near_id = cut(near_id)
    scored = score_slices(near_id.drop("slice_n"), keys, "_id", vec, k, mode, trim, percentiles, min_scored)
    return scored.where("_target").drop("_target", "_level", "_class", "_id", "slice_n").join(df.select(id_col, "slice_n"), id_col)


def score_other_groups(df: DataFrame, keys: list[str], id_col: str, group_col: str, vec: str = "embedding", k: int = 10, trim: float = 0.10, percentiles=(2.0, 98.0)) -> DataFrame:
    """Adds cosine_distance, knn_distance (to rows of other groups only) and S_group, the mean of both between their percentiles."""
    centre = trimmed_centroids(df, keys, id_col, vec, trim)
    near = kernels.knn_other_groups(df, keys, id_col, group_col, vec, k)
    out = df.join(centre, keys).withColumn("cosine_distance", vectors.cosine_distance(vec, "centroid")).drop("centroid").join(near, id_col)
    lo, hi = percentiles
    return out.withColumn("S_group", (stats.minmax("cosine_distance", keys, lo, hi) + stats.minmax("knn_distance", keys, lo, hi)) / 2)


def roll_up(df: DataFrame, group_col: str, score: str = "S", label: str | None = None, how: str = "median") -> DataFrame:
    """(group, {how}_score, n, majority_label): ties go to the smallest label."""
    agg = {"median": F.median, "mean": F.avg, "max": F.max}[how](score).alias(f"{how}_{score}")
    out = df.groupBy(group_col).agg(agg, F.count("*").alias("n"))
    if label is None:
        return out
    votes = df.where(F.col(label).isNotNull()).groupBy(group_col, label).agg(F.count("*").alias("_v"))
    best = votes.groupBy(group_col).agg(F.min_by(label, F.struct(F.negative("_v").alias("v"), F.col(label))).alias("majority_label"))
    return out.join(best, group_col, "left")
