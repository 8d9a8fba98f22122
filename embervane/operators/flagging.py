"""Flags and their grades."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import stats
from ..functions.text import flag_name, flag_rank


def flag(
    df: DataFrame, keys: list[str], id_col: str, score: str = "S", mode: str = "percentile", q: float = 0.96, k: float = 3.0, threshold: float | None = None,
    alpha: float = 0.05, at_least: int | None = None, at_most: float | None = None, scored: str | None = None,
) -> DataFrame:
    """Adds ``flagged`` by slice: percentile, mad, absolute or fdr (Benjamini-Hochberg on rank p-values).

    ``at_most`` caps the share of a slice (its top rows stay), ``at_least`` is a floor and
    is applied last.  Rows whose ``scored`` column is false are never flagged.
    """
    s, n = F.col(score), F.count(F.lit(1)).over(stats.over(keys))
    if mode == "percentile":
        df = df.withColumn("_t", stats.quantile(score, q, keys)).withColumn("flagged", s >= F.col("_t")).drop("_t")
    elif mode == "mad":
        df = stats.with_mad(df, score, keys)
        df = df.withColumn("flagged", (F.col("_mad") > 0) & (s >= F.col("_med") + k * F.col("_mad"))).drop("_med", "_mad")
    elif mode == "absolute":
        if threshold is None:
            raise ValueError("mode absolute needs a threshold")
        df = df.withColumn("flagged", s >= threshold)
    elif mode == "fdr":
        df = df.withColumn("_p", stats.tail_p(score, keys))
        df = df.withColumn("_i", F.row_number().over(stats.over(keys).orderBy("_p", id_col)))
        ok = F.when(F.col("_p") <= alpha * F.col("_i") / n, F.col("_p"))
        df = df.withColumn("_c", F.max(ok).over(stats.over(keys)))
        df = df.withColumn("flagged", F.coalesce(F.col("_p") <= F.col("_c"), F.lit(False))).drop("_p", "_i", "_c")
    else:
        raise ValueError(f"unknown mode {mode}")
    if scored:
        df = df.withColumn("flagged", F.col("flagged") & F.col(scored))
    if at_most is None and at_least is None:
        return df
    top = Window.partitionBy(*keys).orderBy(s.desc(), F.col(id_col))
    df = df.withColumn("_r", F.row_number().over(top)).withColumn("_n", n)
    if at_most is not None:
        df = df.withColumn("flagged", F.col("flagged") & (F.col("_r") <= F.floor(at_most * F.col("_n"))))
    if at_least is not None:
        few = F.sum(F.col("flagged").cast("int")).over(stats.over(keys)) < at_least
        df = df.withColumn("flagged", F.when(few, F.col("_r") <= at_least).otherwise(F.col("flagged")))
    return df.drop("_r", "_n")


def summary(df: DataFrame, keys: list[str]) -> DataFrame:
    agg = df.groupBy(*keys).agg(F.count("*").alias("n_total"), F.sum(F.col("flagged").cast("int")).alias("n_flagged"))
    return agg.withColumn("flagged_fraction", F.col("n_flagged") / F.col("n_total"))


def grades(df: DataFrame, undersized: str | None = None) -> DataFrame:
    """Adds S_anomaly and anomaly_flag (normal, flagged, suspect, candidate); an undersized slice goes no higher than flagged."""
    p, s, f = F.col("rank_percentile"), F.col("S"), F.col("flagged")
    by_s = F.when(f & (p >= 0.99) & (s >= 0.99), 3).when(f & (p >= 0.98) & (s >= 0.95), 2).when(f, 1).otherwise(0)
    votes = lambda t: sum((F.col(c) >= t).cast("int") for c in ("S_rank", "S_rank_min", "S_z"))
    both = F.when(f & (votes(0.99) == 3), 3).when(f & (votes(0.98) >= 2), 2).when(f, 1).otherwise(0)
    if undersized:
        lower = lambda r: F.when(F.col(undersized) & (r > 1), 1).otherwise(r)
        by_s, both = lower(by_s), lower(both)
    return df.withColumns({"S_anomaly": flag_name(by_s), "anomaly_flag": flag_name(both)})


def downgrade(col, trust, suspect: float = 0.3, candidate: float = 0.5):
    """A grade after trust: candidate needs ``candidate``, suspect (also one just lowered) ``suspect``."""
    t, r = F.coalesce(F.col(trust), F.lit(0.5)), flag_rank(col)
    r = F.when((r == 3) & (t < candidate), 2).otherwise(r)
    return flag_name(F.when((r == 2) & (t < suspect), 1).otherwise(r))


def fill_unscored(df: DataFrame, conf: str, flag_col: str) -> DataFrame:
    return df.withColumns({conf: F.coalesce(conf, F.lit(1.0)), flag_col: F.coalesce(flag_col, F.lit("normal"))})


def neutralise(df: DataFrame, label: str, classes: list[str], conf: str, flag_col: str) -> DataFrame:
    """Rows of these classes are normal, with confidence 1."""
    from ..functions.text import in_classes

    hit = in_classes(F.col(label), classes)
    return df.withColumns({conf: F.when(hit, F.lit(1.0)).otherwise(F.col(conf)), flag_col: F.when(hit, F.lit("normal")).otherwise(F.col(flag_col))})


def escalate(df: DataFrame, cls_a: str, when_class: str, flag_a: str, conf_a: str, flag_b: str, conf_b: str) -> DataFrame:
    """Where domain A's class is ``when_class`` and A is graded above B above normal: B goes one up (not above A), with the mean confidence."""
    a, b = flag_rank(F.col(flag_a)), flag_rank(F.col(flag_b))
    hit = (F.lower(F.trim(cls_a)) == when_class) & (a > b) & (b > 0)
    return df.withColumns(
        {flag_b: F.when(hit, flag_name(F.least(b + 1, a))).otherwise(F.col(flag_b)), conf_b: F.when(hit, (F.col(conf_a) + F.col(conf_b)) / 2).otherwise(F.col(conf_b))}
    )
