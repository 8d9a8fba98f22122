"""The session's settings, and cutting a plan's lineage through the shared folder."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def builder(name: str = "embervane") -> SparkSession.Builder:
    """Adaptive execution, UTC, Arrow; partition counts and memory are the cluster's to set."""
    return (
        SparkSession.builder.appName(name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )


def cut(df: DataFrame) -> DataFrame:
    """``df`` in the folder that ``spark.checkpoint.dir`` names (where it is unset, a local run has a temporary one and a
    cluster an error): a plan that reads a table several times shouldn't repeat all that made it, and a lost executor loses nothing."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="embervane-"))
    return df.checkpoint(eager=True)
