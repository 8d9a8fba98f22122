"""What a row's context (the slice without its label) says: margins, neighbour purity, trust in its geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import stats, vectors
from . import kernels, scoring


def margins(df: DataFrame, context: list[str], label: str, vec: str = "embedding") -> DataFrame:
    """Adds context_n_labels, self_dist, alt_label, alt_dist, alt_margin: the own class's centroid and the nearest other one's."""
    unit = df.withColumn("_u", vectors.l2_normalize(vec))
    centre = vectors.centroids(unit.select(*context, label, "_u"), [*context, label], "_u").withColumn("_c", vectors.l2_normalize("centroid")).drop("centroid")
    listed = centre.groupBy(*context).agg(F.sort_array(F.collect_list(F.struct(F.col(label).alias("l"), F.col("_c").alias("c")))).alias("_all"))
    out = unit.join(listed, context)
    d = F.transform("_all", lambda x: F.struct((1 - vectors.dot("_u", x["c"])).alias("d"), x["l"].alias("l")))
    out = out.withColumn("_d", d).withColumn("context_n_labels", F.size("_all")).drop("_all", "_u")
    own = F.filter("_d", lambda x: x["l"] == F.col(label))
    other = F.array_min(F.filter("_d", lambda x: x["l"] != F.col(label)))
    out = out.withColumns({"self_dist": F.get(own, F.lit(0))["d"], "_o": other})
    out = out.withColumns({"alt_label": F.col("_o.l"), "alt_dist": F.col("_o.d")}).drop("_o", "_d")
    self_dist = F.when(F.col("context_n_labels") > 1, F.col("self_dist"))
    return out.withColumn("self_dist", self_dist).withColumn("alt_margin", F.col("alt_dist") - F.col("self_dist"))


def purity(df: DataFrame, flagged: str, context: list[str], label: str, id_col: str, vec: str = "embedding", k: int = 10) -> DataFrame:
    """Adds same_label_frac, majority_label, majority_frac for flagged rows (null for the others); contexts without a flag are not looked at."""
    hot = df.where(F.col(flagged)).select(*context).distinct()
    got = kernels.knn_labels(df.join(hot, context, "left_semi"), context, id_col, label, vec, k, only=flagged)
    return df.join(got, id_col, "left")


def trust(df: DataFrame, context: list[str], label: str, id_col: str, vec: str = "embedding", trim: float = 0.10, min_n: int = 20) -> DataFrame:
    """(context..., slice_trust): how far apart the classes' centroids are against how wide the classes are.

    0.5 below ``min_n`` rows, and where fewer than two of several labels have two rows.
    """
    unit = df.select(*context, label, id_col, vectors.l2_normalize(vec).alias("_u"))
    keys = [*context, label]
    unit = unit.withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    size = unit.groupBy(*context).agg(F.count("*").alias("n"), F.count_distinct(label).alias("labels"), F.count_distinct(F.when(F.col("_n") >= 2, F.col(label))).alias("usable"))
    use = unit.where("_n >= 2")
    centre = scoring.trimmed_centroids(use, keys, id_col, "_u", trim)
    spread = use.join(centre, keys).withColumn("_d", vectors.cosine_distance("_u", "centroid"))
    width = spread.groupBy(*keys).agg(F.avg("_d").alias("_w"))
    intra = width.groupBy(*context).agg(F.avg("_w").alias("intra"))
    listed = centre.groupBy(*context).agg(F.collect_list(F.struct(F.col(label).alias("l"), F.col("centroid").alias("c"))).alias("_all"))
    nearest = centre.join(listed, context).withColumn(
        "_m", F.array_min(F.transform(F.filter("_all", lambda x: x["l"] != F.col(label)), lambda x: vectors.cosine_distance("centroid", x["c"])))
    )
    inter = nearest.groupBy(*context).agg(F.avg("_m").alias("inter"))
    one = stats.with_mad(spread, "_d", context).groupBy(*context).agg(F.min("_med").alias("med"), F.min("_mad").alias("mad"))
    out = size.join(intra, context, "left").join(inter, context, "left").join(one, context, "left")
    apart = stats.clip((F.col("inter") / (F.col("inter") + F.col("intra") + 1e-12) - 0.5) / 0.5, 0.0, 1.0)
    alone = 1 - stats.clip(F.col("mad") / (F.col("med") + 1e-9), 0.0, 1.0)
    value = F.when(F.col("n") < min_n, 0.5).when(F.col("labels") == 1, alone).when(F.col("usable") < 2, 0.5).otherwise(apart)
    return out.select(*context, F.coalesce(value, F.lit(0.5)).alias("slice_trust"))
