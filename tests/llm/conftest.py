import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
)


@pytest.fixture
def docs_of(spark):
    """Documents from (id, text) pairs, in two partitions; further columns that clash with working names come along."""

    def make(rows, clash=True):
        full = [(i, t, "en", f"src{(i or 0) % 5}", len(t) if t is not None else None) for i, t in rows]
        df = spark.createDataFrame(full, DOCS).repartition(2)
        if clash:
            from pyspark.sql import functions as F

            for name in ("key", "node", "n", "pos", "h", "g", "label", "start", "bucket", "toxic_spans", "ids"):
                df = df.withColumn(name, F.lit("x"))
        return df

    return make


@pytest.fixture(scope="session")
def prose():
    """A seeded maker of word sequences from a vocabulary too large for chance repeats."""
    import random

    def make(seed, n, vocabulary=4000):
        r = random.Random(seed)
        return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))

    return make
