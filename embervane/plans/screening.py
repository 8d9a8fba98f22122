"""The screening plan from vectors to graded rows, and its incremental form."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import confidence, grid
from ..operators import context, flagging, scoring, slices
from ..session import cut
from ..sources import sinks


@dataclass(frozen=True)
class Settings:
    """``labels`` go from fine to coarse; ``levels`` (level, cell column) from coarse to fine."""

    labels: tuple[str, ...] = ("label",)
    levels: tuple[tuple[int, str], ...] = ((3, "cell"),)
    groups: tuple[str, ...] = ()
    id_col: str = "sample_id"
    min_slice_size: int = 100
    max_slice_size: int | None = None
    merge: bool = True
    max_merge_iterations: int = 10
    mode: str = "mad"
    percentile_q: float = 0.96
    mad_k: float = 4.0
    threshold: float | None = None
    fdr_alpha: float = 0.05
    at_least: int | None = None
    at_most: float | None = None
    percentiles: tuple[float, float] = (2.0, 98.0)
    centroid: str = "trimmed"
    trim: float = 0.05
    knn_k: int = 10
    min_scored: int = scoring.MIN_SCORED
    gate_by_flag: bool = True
    trust_min: float | None = None
    skip: tuple[str, ...] = ()
    keep_intermediate: bool = False


INTERMEDIATE = (
    "cosine_distance", "knn_distance", "cos_norm", "knn_norm", "cos_rank", "knn_rank", "cos_z", "knn_z", "rank_percentile", "self_dist", "alt_label", "alt_dist",
    "alt_margin", "same_label_frac", "majority_label", "majority_frac",
)


def screen(df: DataFrame, s: Settings, neighbours: DataFrame | None = None, mapping: tuple[DataFrame, str, str] | None = None, done: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(graded rows, summary of slices).  ``mapping``: class table, code column of the rows, key column of the table."""
    label = s.labels[0]
    if done is not None:
        df = slices.resume(df, done, s.id_col)
    if mapping is not None:
        df = slices.map_classes(df, mapping[0], mapping[1], mapping[2], list(s.labels))
    slices.require_columns(df, [s.id_col, "embedding", *s.labels])
    df, skipped = slices.split_skipped(df, label, list(s.skip))
    df = df.dropna(subset=list(s.labels))
    groups = list(s.groups)
    df = _placed(df, s)
    if s.merge and neighbours is not None:
        df = slices.merge_small(df, neighbours, label, "cell", groups, s.min_slice_size, s.max_merge_iterations)
    else:
        df = df.withColumn("undersized_slice", F.count("*").over(scoring.Window.partitionBy(*groups, "cell", label)) < s.min_slice_size)
    where = [*groups, "cell"]
    df = slices.reference_level(df, list(s.labels), where, s.min_slice_size)
    df = cut(df)  # from here on, and below, each table is read by several branches
    df = cut(context.margins(df, where, label))
    args = dict(k=s.knn_k, mode=s.centroid, trim=s.trim, percentiles=s.percentiles, min_scored=s.min_scored)
    keys = [*where, label]
    if len(s.labels) > 1:
        df = scoring.score_hierarchy(df, list(s.labels), where, s.id_col, s.min_slice_size, **args)
    else:
        df = scoring.score_slices(df.drop("slice_n"), keys, s.id_col, **args)
    df = flagging.flag(cut(df), keys, s.id_col, "S", s.mode, s.percentile_q, s.mad_k, s.threshold, s.fdr_alpha, s.at_least, s.at_most, "scored")
    df = cut(df)
    summary = flagging.summary(df, keys)
    df = df.withColumn("confidence", confidence.curve("mean_score", flagged="flagged" if s.gate_by_flag else None))
    df = df.withColumn("confidence", F.when(F.col("slice_n") < s.min_scored, F.greatest("confidence", F.lit(0.95))).otherwise(F.col("confidence")))
    df = context.purity(df, "flagged", where, label, s.id_col)
    df = df.withColumn("confidence_alt", confidence.fuse("confidence", "alt_margin", "same_label_frac", "flagged"))
    df = flagging.grades(df, "undersized_slice")
    if s.trust_min is not None:
        df = df.join(context.trust(df, where, label, s.id_col), where, "left")
        df = df.withColumn("confidence", confidence.attenuate("confidence", "slice_trust", "flagged", s.trust_min))
        df = df.withColumn("anomaly_flag", flagging.downgrade("anomaly_flag", "slice_trust", s.trust_min, min(2 * s.trust_min, 0.6)))
    out = df.drop("embedding", "scored") if s.keep_intermediate else df.drop("embedding", "scored", *INTERMEDIATE)
    out = out.unionByName(skipped.drop("embedding"), allowMissingColumns=True)
    out = out.select(*[F.col(f.name).cast("float").alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in out.schema.fields])
    return out.withColumnRenamed("confidence", "confidence_nonoutlier"), summary


def _placed(df: DataFrame, s: Settings) -> DataFrame:
    levels = list(s.levels)
    if len(levels) == 1:
        level, col = levels[0]
        return (df if col == "cell" else df.withColumn("cell", F.col(col))).withColumn("cell_level", F.lit(level))
    held = [(lv, f"_cell_{lv}") for lv, _ in levels]
    df = df.withColumns({new: F.col(old) for (_, old), (_, new) in zip(levels, held)})
    df = slices.adaptive_level(df.drop("cell"), held, s.labels[0], list(s.groups), s.max_slice_size)
    return df.drop(*[c for _, c in held])


def in_two_domains(df: DataFrame, a: Settings, b: Settings, prefix_a: str = "A", prefix_b: str = "B", keys: tuple[str, ...] = ("ref_id", "sample_id"), **kw) -> DataFrame:
    """Both domains' confidence, flag and class beside each other (full outer join)."""

    def one(s: Settings, p: str) -> DataFrame:
        got, _ = screen(df, s, **kw)
        return got.select(*keys, F.col("confidence_nonoutlier").alias(f"{p}_confidence_nonoutlier"), F.col("anomaly_flag").alias(f"{p}_anomaly_flag"), F.col(s.labels[0]).cast("string").alias(f"outlier_{p}_cls"))

    return one(a, prefix_a).join(one(b, prefix_b), list(keys), "full_outer")


def impact_zone(cells: DataFrame, level: int, coarser: list[int] | None = None, rings: int = 1) -> DataFrame:
    """(level, cell): the quadtree cells, their parents at coarser levels, and the rings around each."""
    zone = None
    for lv in [level, *(coarser or [])]:
        c = cells.select(grid.Quad.parent(F.col("cell"), lv, level).alias("cell") if lv < level else F.col("cell"))
        part = c.select(F.lit(lv).alias("level"), F.explode(grid.Quad.disk(F.col("cell"), lv, rings)).alias("cell"))
        zone = part if zone is None else zone.unionByName(part)
    return zone.distinct()


def in_zone(df: DataFrame, zone: DataFrame, level: int, coarser: list[int] | None = None) -> DataFrame:
    """Rows whose cell, or its parent at any level, is in the zone."""
    levels = [level, *(coarser or [])]
    own = F.array(*[F.struct(F.lit(lv).alias("level"), (grid.Quad.parent(F.col("cell"), lv, level) if lv < level else F.col("cell")).alias("cell")) for lv in levels])
    touched = df.select("cell").distinct().withColumn("_p", F.explode(own)).select("cell", F.col("_p.level").alias("level"), F.col("_p.cell").alias("_z"))
    hit = touched.join(zone.withColumnRenamed("cell", "_z"), ["level", "_z"], "left_semi").select("cell").distinct()
    return df.join(hit, "cell", "left_semi")


def rescore(rows: DataFrame, cache: DataFrame, s: Settings, cols: list[str], level: int, coarser: list[int] | None = None, rings: int = 1, **kw) -> tuple[DataFrame, DataFrame]:
    """(new scores, touched ref_ids): what has no score is scored again with all of its neighbourhood."""
    new = sinks.unscored(rows, cols, s.id_col).select(s.id_col)
    fresh = cache.join(new, s.id_col, "left_semi")
    fresh, _ = slices.split_skipped(fresh, s.labels[0], list(s.skip))
    zone = impact_zone(fresh.select("cell").distinct(), level, coarser, rings)
    got, _ = screen(in_zone(cache, zone, level, coarser), s, **kw)
    return got, got.select("ref_id").distinct()


@dataclass
class Run:
    """One call for everything: ``rerun`` scores the whole cache, ``update`` only what new rows touch."""

    mode: str = "rerun"
    settings: Settings = field(default_factory=Settings)
    keys: tuple[str, ...] = ("ref_id", "sample_id")
    cols: tuple[str, ...] = ("confidence_nonoutlier", "anomaly_flag")
    level: int = 3
    coarser: tuple[int, ...] = ()

    def __call__(self, rows: DataFrame, cache: DataFrame, **kw) -> DataFrame:
        if self.mode == "rerun":
            scores, _ = screen(cache, self.settings, **kw)
        elif self.mode == "update":
            scores, _ = rescore(rows, cache, self.settings, list(self.cols), self.level, list(self.coarser), **kw)
        else:
            raise ValueError(f"unknown mode {self.mode}")
        return sinks.merge_scores(rows, scores.select(*self.keys, *self.cols), list(self.keys), list(self.cols))


def with_settings(s: Settings, **changes) -> Settings:
    return replace(s, **changes)
