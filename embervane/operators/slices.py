"""Which rows make up a slice: adaptive cells, merging of small slices, label hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..session import cut


def require_columns(df: DataFrame, cols: list[str]) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def label_levels(label: str | list[str]) -> list[str]:
    return [label] if isinstance(label, str) else list(label)


def adaptive_level(df: DataFrame, levels: list[tuple[int, str]], label: str, groups: list[str] | None = None, max_slice_size: int | None = None) -> DataFrame:
    """Adds ``cell`` and ``cell_level``: of the levels (coarse to fine, each with its cell column) the first
    at which the row's (groups, label, cell), counted among rows not yet placed, has at most ``max_slice_size`` rows."""
    require_columns(df, [label, *(groups or []), *[c for _, c in levels]])
    df = df.withColumns({"cell": F.lit(None).cast("string"), "cell_level": F.lit(None).cast("int")})
    for i, (level, col) in enumerate(levels):
        open_ = F.col("cell").isNull()
        if i < len(levels) - 1 and max_slice_size is not None:
            n = F.sum(open_.cast("int")).over(Window.partitionBy(*(groups or []), label, col))
            open_ = open_ & (n <= max_slice_size)
        df = df.withColumn("_take", open_)
        df = df.withColumns({"cell": F.when(F.col("_take"), F.col(col)).otherwise(F.col("cell")), "cell_level": F.when(F.col("_take"), F.lit(level)).otherwise(F.col("cell_level"))}).drop("_take")
    return df


def merge_map(counts: DataFrame, neighbours: DataFrame, keys: list[str], cell: str, min_size: int, max_iterations: int = 10, min_gain: float = 0.05) -> DataFrame:
    """(keys..., cell, target) from (keys..., cell, n): small slices go to the neighbouring cell with most rows of the same keys.

    All moves of an iteration happen at once; ties go to the smallest cell.  Only
    slices, never rows, are worked on; each iteration is one checkpointed plan.
    """
    state = counts.select(*keys, F.col(cell).alias("origin"), F.col(cell).alias("now"), F.col("n").cast("long").alias("n"))
    state = cut(state)
    edges = neighbours.select(F.col("cell").alias("now"), F.col("neighbour").alias("to"))
    before = None
    for _ in range(max_iterations):
        size = state.groupBy(*keys, "now").agg(F.sum("n").alias("n"))
        small = size.where(F.col("n") < min_size)
        left = small.count()
        if not left or (before is not None and before - left < min_gain * before):
            break
        before = left
        options = small.select(*keys, "now").join(edges, "now").where("now <> to").join(size.select(*keys, F.col("now").alias("to"), "n"), [*keys, "to"])
        best = options.groupBy(*keys, "now").agg(F.max(F.struct("n", F.lit(0))).alias("m"), F.min_by("to", F.struct(F.negative("n").alias("nn"), "to")).alias("to"))
        moves = best.select(*keys, "now", "to")
        if moves.isEmpty():
            break
        state = cut(state.join(moves, [*keys, "now"], "left").select(*keys, "origin", F.coalesce("to", "now").alias("now"), "n"))
    return state.select(*keys, F.col("origin").alias(cell), F.col("now").alias("target"))


def merge_small(df: DataFrame, neighbours: DataFrame, label: str, cell: str = "cell", groups: list[str] | None = None, min_size: int = 100, max_iterations: int = 10) -> DataFrame:
    """Rows with their merged ``cell``, and ``undersized_slice`` where the slice is still below ``min_size``."""
    keys = [*(groups or []), label]
    counts = df.groupBy(*keys, cell).agg(F.count("*").alias("n"))
    target = merge_map(counts, neighbours, keys, cell, min_size, max_iterations)
    out = df.join(target, [*keys, cell], "left").withColumn(cell, F.coalesce("target", cell)).drop("target")
    return out.withColumn("undersized_slice", F.count("*").over(Window.partitionBy(*keys, cell)) < min_size)


def slice_ids(df: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``slice_id``: the place of the row's slice among all slices in order of their keys."""
    ids = df.select(*keys).distinct().withColumn("slice_id", F.dense_rank().over(Window.orderBy(*keys)).cast("long") - 1)
    return df.join(ids, keys, "left")


def reference_level(df: DataFrame, labels: list[str], context: list[str], min_size: int) -> DataFrame:
    """Adds slice_n, ref_level, ref_class, ref_group_n: the finest label whose group in the context has ``min_size`` rows, else the coarsest."""
    for i, lab in enumerate(labels):
        df = df.withColumn(f"_n{i}", F.count("*").over(Window.partitionBy(*context, lab)))
    last = len(labels) - 1
    level, cls, n = F.lit(last), F.col(labels[last]).cast("string"), F.col(f"_n{last}")
    for i in reversed(range(last)):
        ok = F.col(f"_n{i}") >= min_size
        level, cls, n = F.when(ok, F.lit(i)).otherwise(level), F.when(ok, F.col(labels[i]).cast("string")).otherwise(cls), F.when(ok, F.col(f"_n{i}")).otherwise(n)
    df = df.withColumns({"slice_n": F.col("_n0"), "ref_level": level, "ref_class": cls, "ref_group_n": n})
    return df.drop(*[f"_n{i}" for i in range(len(labels))])


def map_classes(df: DataFrame, mapping: DataFrame, code: str, key: str, labels: list[str]) -> DataFrame:
    """Left join with a class table on cleaned codes; a code mapped twice is refused."""
    m = mapping.select(text.clean_code(F.col(key)).alias("_code"), *labels)
    twice = m.groupBy("_code").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"code {twice[0]['_code']} is mapped twice")
    return df.drop(*labels).withColumn("_code", text.clean_code(F.col(code))).join(m, "_code", "left").drop("_code")


def split_skipped(df: DataFrame, label: str, skip: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows to score, rows of skipped classes)."""
    s = text.in_classes(F.col(label), skip)
    return df.where(~s), df.where(s)


def resume(df: DataFrame, done: DataFrame, id_col: str) -> DataFrame:
    """Rows whose id has no result yet."""
    return df.join(done.select(id_col).distinct(), id_col, "left_anti")


def newest_wins(new: DataFrame, old: DataFrame, id_cols: list[str]) -> DataFrame:
    """Old results and new ones; where both have an id, the new."""
    both = new.withColumn("_age", F.lit(0)).unionByName(old.withColumn("_age", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*id_cols).orderBy("_age")
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_age")


def first_cells(df: DataFrame, cell: str, n: int = 10) -> DataFrame:
    """Only rows of the n smallest cells (for a debugging run)."""
    few = df.select(cell).distinct().orderBy(cell).limit(n)
    return df.join(F.broadcast(few), cell, "left_semi")


def frequent_labels(df: DataFrame, label: str, at_least: int) -> DataFrame:
    return df.withColumn("_n", F.count("*").over(Window.partitionBy(label))).where(F.col("_n") >= at_least).drop("_n")


def supported_labels(df: DataFrame, label: str, split: str, train: int = 20, val: int = 10) -> DataFrame:
    """Rows of labels that both splits have often enough."""
    n = df.groupBy(label).agg(F.sum((F.col(split) == "train").cast("int")).alias("a"), F.sum((F.col(split) == "val").cast("int")).alias("b"))
    return df.join(n.where((F.col("a") >= train) & (F.col("b") >= val)).select(label), label, "left_semi")
