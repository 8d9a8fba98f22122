"""A corpus pipeline of five stages, each by one operator of ``embervane.llm``.

Every stage works on all documents that the stage before kept and is written as
Parquet before the next one reads it.

1. toxicity: rows with a score of at least ``REJECT_AT`` go.
2. near duplicates: of each component of the 5-word Jaccard join at 0.8 the row with the smallest id stays.
3. decontamination: documents that hold a window similar to a benchmark item go.
4. secrets: spans of live (owner-specific) secrets are masked; no document goes.
5. BPE: each text is encoded and decoded again; ids and text are the result.

Null texts are empty texts; documents without any of what a stage looks for
pass it unchanged; rows without an id pass the near-duplicate stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embervane.llm import bpe, decontaminate, jaccard_join, secrets, toxicity
from embervane.llm.common import read, shared_dir

REJECT_AT = 0.5
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The field is fitted on the labelled rows of the documents that arrive."""
    field = toxicity.train(docs, read(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(docs, field, keep=COLUMNS)
    return scored.where(F.col("score") < REJECT_AT).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    told = jaccard_join.near_duplicates(docs, k=5, percent=80)
    # Rows of one id and one text are one document here; the join told them apart by both.  Only such rows are shuffled to be one.
    said = told.where("doc_id IS NOT NULL").groupBy("doc_id", "key").agg(F.count("*").alias("copies"), F.max(F.col("doc_id") != F.col("component_id")).alias("gone"))
    keyed = docs.where("doc_id IS NOT NULL").withColumn("key", F.xxhash64(F.coalesce("text", F.lit(""))))
    kept = keyed.join(said.where("gone OR copies > 1"), ["doc_id", "key"], "left").where("NOT coalesce(gone, false)")
    once, again = kept.where("copies IS NULL"), kept.where("copies IS NOT NULL").dropDuplicates(["doc_id", "key"])
    return once.select(*COLUMNS).unionByName(again.select(*COLUMNS)).unionByName(docs.where("doc_id IS NULL").select(*COLUMNS))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(docs, read(spark, sf_dir, "benchmark")).select("doc_id", "key").distinct()
    keyed = docs.withColumn("key", F.xxhash64(F.coalesce("text", F.lit(""))))
    return keyed.join(found, (keyed["doc_id"].eqNullSafe(found["doc_id"])) & (keyed["key"] == found["key"]), "left_anti").select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = docs.withColumn("key", F.xxhash64(F.coalesce("text", F.lit(""))))
    found = secrets.scan(keyed, keep=("key",)).where(F.size("live") > 0).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "live")
    found = found.dropDuplicates(["_id", "_key"])
    both = keyed.join(found, keyed["doc_id"].eqNullSafe(found["_id"]) & (keyed["key"] == found["_key"]), "left")
    text = F.when(F.col("live").isNotNull(), secrets.redact(F.coalesce("text", F.lit("")), F.col("live"))).otherwise(F.col("text"))
    both = both.withColumn("text", text)
    return both.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, decoded (the text that the ids spell), lang, source."""
    coded = bpe.decode_frame(bpe.encode_frame(docs.select("doc_id", "lang", "source", "text")))
    return coded.select("doc_id", "lang", "source", "ids", F.size("ids").alias("n_tokens"), "decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", one_of_each_group),
    ("decontamination", drop_leaks),
    ("secrets", mask_secrets),
    ("byte_bpe", tokenize),
]

#: No stage but the fourth can be told in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
