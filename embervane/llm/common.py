"""Small helpers that several operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import struct
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of a batch of rows on its way to a Python worker, where the session says nothing of it.
BATCH_BYTES = "4m"
#: Bytes of text after which a worker returns freed memory.
GIVE_BACK_EVERY = 16 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session by bytes: the default bounds rows, and texts may be long."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where that is unset, a local run gets a temporary folder; a cluster, whose executors could not see one, an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="embervane-"))
    return sc.getCheckpointDir().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df`` written to the shared folder, so that a lost executor loses none of them."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def staged(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read again (columns can be pruned)."""
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    del df
    release(spark)
    out = spark.read.schema(schema).parquet(path)
    out.staged_path = path
    return out


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables that nothing will read again."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.staged_path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def _give_back() -> None:
    """Return what a worker has freed to the machine; its allocators would keep it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def small(batches, text_at: int, limit: int = 2 << 20):
    """Arrow batches cut into slices of about ``limit`` bytes of text, so that a task holds little at a time."""
    seen = 0
    for batch in batches:
        n = max(1, len(batch))
        size = batch.column(text_at).nbytes
        step = max(1, n * limit // max(limit, size))
        for lo in range(0, len(batch), step):
            yield batch.slice(lo, step)
        seen += size
        if seen >= GIVE_BACK_EVERY:
            _give_back()
            seen = 0
    _give_back()


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of what is finished: it does so when the driver's garbage is collected."""
    gc.collect()
    spark._jvm.System.gc()


MAX_BLOOM_BLOCKS = 1 << 17


def _bloom_mask(h):
    bit = lambda s: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(h, s), F.lit(64)).cast("int"))
    return bit(0).bitwiseOR(bit(8)).bitwiseOR(bit(16)).bitwiseOR(bit(24))


def bloom(keys: DataFrame, on: list[str]):
    """A test for columns of xxhash64: true for the hash of any row of ``keys`` in the columns ``on`` and, rarely, for others.

    A blocked filter of at most MAX_BLOOM_BLOCKS 64-bit blocks (1 MB); with more keys than it holds, more others pass.
    """
    n = keys.count()
    blocks = min(MAX_BLOOM_BLOCKS, max(16, 1 << (n // 4).bit_length()))
    at = lambda x: F.pmod(F.shiftright(x, 32), F.lit(blocks)).cast("int")
    held = keys.select(F.xxhash64(*on).alias("h")).groupBy(at(F.col("h")).alias("b")).agg(F.bit_or(_bloom_mask(F.col("h"))).alias("m"))
    rows = {r["b"]: r["m"] for r in held.collect()}  # at most one for each block
    table = F.lit(struct.pack(f">{blocks}q", *[rows.get(i, 0) for i in range(blocks)]))

    def test(h):
        word = F.conv(F.hex(F.substring(table, at(h) * 8 + 1, F.lit(8))), 16, -10).cast("long")
        return word.bitwiseAND(_bloom_mask(h)) == _bloom_mask(h)

    return test


def semi_reduced(big: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """``big`` without most rows that have no partner in ``keys``: what a join needn't shuffle.

    By a Bloom filter of bounded size: with more keys than it holds, more rows pass; a partner is never dropped.
    """
    return big.where(bloom(keys, on)(F.xxhash64(*on)))


def semi_split(big: DataFrame, keys: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """``big`` in two: rows that may have a partner in ``keys``, and rows that surely have none."""
    maybe = bloom(keys, on)(F.xxhash64(*on))
    return big.where(maybe), big.where(~maybe)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(col):
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def local_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few literal rows as a relation of the JVM's own (no RDD behind it)."""
    fields = [f.strip().split(" ") for f in schema.split(",")]
    one = [F.struct(*[F.lit(v).cast(kind).alias(name) for v, (name, kind) in zip(row, fields)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*one)))
