"""Structured Streaming around the incremental plan: each micro-batch of new rows re-scores its neighbourhood.

Scores of a batch are a function of the batch and the cache, and are written as
whole partitions, so a batch that runs twice leaves the same files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans import screening
from ..sources import sinks


def read_rows(spark: SparkSession, path: str, schema, max_files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def rescore_stream(rows: DataFrame, cache: Callable[[], DataFrame], settings: screening.Settings, out: str, checkpoint: str, level: int = 3, **kw) -> StreamingQuery:
    """Starts a query that writes the re-scored rows of touched datasets to ``out`` (by ref_id)."""

    def one(batch: DataFrame, _: int) -> None:
        scores, _refs = screening.rescore(batch, cache(), settings, ["confidence_nonoutlier", "anomaly_flag"], level, **kw)
        sinks.write_long(scores, out, order=[settings.id_col])

    return rows.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
