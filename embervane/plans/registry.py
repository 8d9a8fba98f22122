"""The register of queries: a function with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embedding table with stand-ins for what it lacks: cell, dataset, coarse label."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "embedding", "label", (F.col("vec_id") % 4).alias("cell"), (F.col("vec_id") % 7).alias("ds"), F.floor(F.col("label") / 5).cast("int").alias("coarse"))


def r6(c, name: str | None = None):
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, 6).alias(name or c)


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


EMB = "e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label, vec_id % 4 AS cell, vec_id % 7 AS ds, label // 5 AS coarse FROM embeddings)"


def centroid_sql(src: str, keys: str, out: str, how: str = "avg", vec: str = "v") -> str:
    """CTEs that end in ``out``(keys, c)."""
    return (
        f"{out}_u AS (SELECT {keys}, unnest({vec}) AS x, generate_subscripts({vec}, 1) AS d FROM {src}),\n"
        f"{out}_m AS (SELECT {keys}, d, {how}(x) AS m FROM {out}_u GROUP BY {keys}, d),\n"
        f"{out} AS (SELECT {keys}, list(m ORDER BY d) AS c FROM {out}_m GROUP BY {keys})"
    )


def knn_sql(src: str, key: str, out: str, k: int = 10, also: str = "") -> str:
    """CTEs that end in ``out``(vec_id, kd)."""
    return (
        f"{out}_n AS (SELECT {key}, count(*) AS n FROM {src} GROUP BY {key}),\n"
        f"{out}_p AS (SELECT a.vec_id, 1 - list_cosine_similarity(a.v, b.v) AS d, least(greatest({k}, least(floor(sqrt(n)), 50)), n - 1) AS k,\n"
        f"  row_number() OVER (PARTITION BY a.vec_id ORDER BY 1 - list_cosine_similarity(a.v, b.v), b.vec_id) AS r\n"
        f"  FROM {src} a JOIN {src} b ON a.{key} = b.{key} AND a.vec_id <> b.vec_id {also} JOIN {out}_n x ON x.{key} = a.{key}),\n"
        f"{out} AS (SELECT vec_id, avg(d) AS kd FROM {out}_p WHERE r <= k GROUP BY vec_id)"
    )


def scores_sql(src: str, key: str, lo: float = 0.05, hi: float = 0.95) -> str:
    """From ``src``(vec_id, key, cd, kd, ...) to CTE ``sc`` with all scores."""
    w = f"PARTITION BY {key}"
    mm = lambda x: f"least(greatest(({x} - {x}lo) / (CASE WHEN {x}hi <= {x}lo THEN 1.0 ELSE {x}hi - {x}lo END), 0.0), 1.0)"
    z = lambda x: f"({x} - {x}med) / (CASE WHEN {x}mad = 0 THEN 1.0 ELSE {x}mad END + 1e-12)"
    sg = lambda x: f"(1 / (1 + exp(-least(greatest({x}, -50.0), 50.0))))"
    return (
        f"sc1 AS (SELECT *, quantile_cont(cd, {lo}) OVER ({w}) AS cdlo, quantile_cont(cd, {hi}) OVER ({w}) AS cdhi, quantile_cont(kd, {lo}) OVER ({w}) AS kdlo,\n"
        f"  quantile_cont(kd, {hi}) OVER ({w}) AS kdhi, median(cd) OVER ({w}) AS cdmed, median(kd) OVER ({w}) AS kdmed,\n"
        f"  cume_dist() OVER ({w} ORDER BY cd) AS cos_rank, cume_dist() OVER ({w} ORDER BY kd) AS knn_rank FROM {src}),\n"
        f"sc2 AS (SELECT *, median(abs(cd - cdmed)) OVER ({w}) AS cdmad, median(abs(kd - kdmed)) OVER ({w}) AS kdmad FROM sc1),\n"
        f"sc3 AS (SELECT *, {mm('cd')} AS cos_norm, {mm('kd')} AS knn_norm, {z('cd')} AS cos_z, {z('kd')} AS knn_z FROM sc2),\n"
        f"sc4 AS (SELECT *, (cos_norm + knn_norm) / 2 AS S, (cos_rank + knn_rank) / 2 AS S_rank, least(cos_rank, knn_rank) AS S_rank_min,\n"
        f"  ({sg('cos_z')} + {sg('knn_z')}) / 2 AS S_z FROM sc3),\n"
        f"sc AS (SELECT *, cume_dist() OVER ({w} ORDER BY S_rank) AS rank_percentile, (S_rank + S_rank_min + S_z) / 3 AS mean_score FROM sc4)"
    )


def trimmed_sql(src: str, key: str, out: str, trim: float) -> str:
    """CTEs that end in ``out``(key, c): the trimmed centroid after two passes."""
    keep = f"CASE WHEN n < 5 THEN n ELSE greatest(ceil((1 - {trim}) * n), 3) END"
    text = f"{out}_b AS (SELECT *, count(*) OVER (PARTITION BY {key}) AS n FROM {src}),\n" + centroid_sql(src, key, f"{out}0")
    for i in (0, 1):
        text += (
            f",\n{out}_k{i} AS (SELECT * FROM (SELECT b.*, row_number() OVER (PARTITION BY b.{key} ORDER BY list_cosine_distance(b.v, q.c), b.vec_id) AS r\n"
            f"  FROM {out}_b b JOIN {out}{i} q ON q.{key} = b.{key}) WHERE r <= {keep}),\n" + centroid_sql(f"{out}_k{i}", key, f"{out}{i + 1}")
        )
    return text + f",\n{out} AS (SELECT * FROM {out}2)"
