"""An embedding cache: Parquet partitioned by the model that made the vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors
from ..operators import slices

SCHEMA = T.StructType(
    [
        T.StructField("sample_id", T.StringType()), T.StructField("ref_id", T.StringType()), T.StructField("label_code", T.StringType()),
        T.StructField("cell", T.StringType()), T.StructField("lat", T.FloatType()), T.StructField("lon", T.FloatType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("model_hash", T.StringType()),
    ]
)


class EmbeddingCache:
    """Reads are pruned to a model's partition; changes rewrite only that partition (plain Parquet has no update)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def init(self) -> None:
        if not self._exists():
            self.spark.createDataFrame([], SCHEMA).write.partitionBy("model_hash").parquet(self.path)

    def _exists(self) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(p)

    def scan(self, model_hash: str | None = None, columns: list[str] | None = None) -> DataFrame:
        df = self.spark.read.schema(SCHEMA).parquet(self.path)
        df = df.where(F.col("model_hash") == model_hash) if model_hash is not None else df
        return df.select(*columns) if columns else df

    def ids(self, model_hash: str) -> DataFrame:
        return self.scan(model_hash).select("sample_id").distinct()

    def hits(self, wanted: DataFrame, model_hash: str) -> DataFrame:
        """The wanted ids that are cached."""
        return wanted.select("sample_id").distinct().join(self.ids(model_hash), "sample_id", "left_semi")

    def fetch(self, wanted: DataFrame, model_hash: str) -> DataFrame:
        return self.scan(model_hash).join(wanted.select("sample_id").distinct(), "sample_id", "left_semi")

    def missing(self, wanted: DataFrame, model_hash: str) -> DataFrame:
        """Wanted (sample_id, ref_id) that the cache lacks; null dataset names are equal to each other."""
        c = self.scan(model_hash).select(F.col("sample_id").alias("_s"), F.col("ref_id").alias("_r"))
        return wanted.join(c, (F.col("sample_id") == F.col("_s")) & F.col("ref_id").eqNullSafe(F.col("_r")), "left_anti")

    def insert(self, rows: DataFrame, model_hash: str) -> None:
        """Appends ids that the model's partition lacks, each once."""
        new = slices.resume(rows, self.ids(model_hash), "sample_id").dropDuplicates(["sample_id"])
        new.withColumn("model_hash", F.lit(model_hash)).select(*SCHEMA.names).write.mode("append").partitionBy("model_hash").parquet(self.path)

    def _rewrite(self, df: DataFrame) -> None:
        """Staged beside the cache, then put in place of the partitions it holds."""
        stage = f"{self.path.rstrip('/')}__stage"
        df.select(*SCHEMA.names).write.mode("overwrite").parquet(stage)
        done = self.spark.read.schema(SCHEMA).parquet(stage)
        done.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model_hash").parquet(self.path)
        p = self.spark._jvm.org.apache.hadoop.fs.Path(stage)
        p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)

    def delete(self, gone: DataFrame, model_hash: str) -> None:
        self._rewrite(slices.resume(self.scan(model_hash), gone, "sample_id"))

    def recompute_cells(self, cell, model_hash: str) -> None:
        """``cell`` (a Column of lat and lon) where both are known; other cells stay."""
        known = F.col("lat").isNotNull() & F.col("lon").isNotNull()
        self._rewrite(self.scan(model_hash).withColumn("cell", F.when(known, cell).otherwise(F.col("cell"))))

    def fill(self, samples: DataFrame, model_hash: str, embed: Callable[[DataFrame], DataFrame], force: bool = False) -> DataFrame:
        """Embeds what the cache lacks (``embed`` gives rows an ``embedding``), inserts it, returns all wanted rows."""
        if force:
            self.delete(samples, model_hash)
        todo = samples if force else slices.resume(samples, self.ids(model_hash), "sample_id")
        self.insert(embed(todo), model_hash)
        return self.fetch(samples, model_hash)


def width(df: DataFrame, prefix: str = "embedding_", default: int = 128) -> int:
    """Of wide columns, else of the longest vector, else ``default``."""
    wide = vectors.vector_columns(df, prefix)
    if wide:
        return len(wide)
    if "embedding" in df.columns:
        return df.agg(F.max(F.size("embedding"))).first()[0] or default
    return default


def unified(cache: DataFrame, scored: DataFrame, label: str, regions: DataFrame | None = None, quality: DataFrame | None = None) -> DataFrame:
    """Vectors with their scores (inner), and region and quality where known; rows without a label go."""
    df = cache.join(scored.drop(*[c for c in scored.columns if c in cache.columns and c != "sample_id"]), "sample_id")
    for extra in (regions, quality):
        df = df if extra is None else df.join(extra, "sample_id", "left")
    return df.where(F.col(label).isNotNull())


def one_per_id(df: DataFrame, id_col: str, order: list[str]) -> DataFrame:
    from pyspark.sql.window import Window

    w = Window.partitionBy(id_col).orderBy(*order)
    return df.where(F.col(id_col).isNotNull()).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
