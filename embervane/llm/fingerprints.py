"""Document fingerprints: one-permutation MinHash.

A document's 5-word shingles are hashed once.  The high bits of a hash choose one
of ``BINS`` bins and the smallest hash of a bin stands for it.  Empty bins are
filled by optimal densification: bin ``i`` takes the value of bin ``g(i, a)`` for
the first attempt ``a`` whose bin isn't empty, with ``g`` a fixed 2-universal
table shared by all documents.  ``BITS`` low-order bits of each bin (after
mixing) are packed into the stored hex string.  Two unrelated bins agree with
probability 2**-BITS, so the likeness of two fingerprints is the share of equal
bins with that bias taken out: (m - 2**-BITS) / (1 - 2**-BITS), within 0..1.

Defined results: a null or empty text, or one without words, has the fingerprint
of the empty set (all ones, marked by its own prefix): likeness 1 to another
empty one and 0 to any other.  A text of fewer than five words has one shingle,
its whole word sequence.  Equal texts have equal fingerprints.

:func:`with_next` pairs each row with the next by id without a global sort: ids
are cut at quantiles into buckets, each bucket is sorted on its own, and the
first row of a bucket is also sent to the end of the bucket before it.
Rows tied on their id follow in order of text.  Other columns are dropped; an
empty table gives an empty table; null ids come first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel
from .common import bound_batches, partitions, read, small

BINS, BITS, SHINGLE = 256, 4, 5
_ATTEMPTS = 64
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_SHIFT = np.uint64(64 - 8)


def _attempt_table() -> np.ndarray:
    """g(i, a): a bin for each bin and attempt, from a fixed seed; the last attempts run through all bins."""
    rng = np.random.default_rng(20240229)
    return rng.integers(0, BINS, (_ATTEMPTS, BINS))


_G = _attempt_table()


def bins_of(shingles: np.ndarray) -> np.ndarray:
    """The densified bins of a sorted set of 64-bit shingle hashes."""
    out = np.full(BINS, _EMPTY, np.uint64)
    if not len(shingles):
        return out
    at = (shingles >> _SHIFT).astype(np.int64)
    first = np.empty(len(at), bool)
    first[0] = True
    np.not_equal(at[1:], at[:-1], out=first[1:])
    out[at[first]] = shingles[first]
    full = out != _EMPTY
    if full.all():
        return out
    dense = out.copy()
    todo = np.flatnonzero(~full)
    for a in range(_ATTEMPTS):
        pick = _G[a][todo]
        ok = full[pick]
        dense[todo[ok]] = out[pick[ok]]
        todo = todo[~ok]
        if not len(todo):
            return dense
    have = np.flatnonzero(full)  # as good as never: the next full bin, in a circle
    dense[todo] = out[have[np.searchsorted(have, todo) % len(have)]]
    return dense


def pack(bins: np.ndarray) -> bytes:
    """BITS low-order bits of every bin, two bins a byte, behind a byte that marks the empty set."""
    if bins[0] == _EMPTY and (bins == _EMPTY).all():
        return b"\x00" + b"\xff" * (BINS * BITS // 8)
    low = (textkernel.mix(bins) & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    return b"\x01" + (low[0::2] << 4 | low[1::2]).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """The estimated Jaccard similarity of two packed fingerprints."""
    if a == b:
        return 1.0
    if a[0] != b[0]:
        return 0.0
    x = np.frombuffer(a, np.uint8, offset=1) ^ np.frombuffer(b, np.uint8, offset=1)
    m = (np.count_nonzero(x & 0xF0 == 0) + np.count_nonzero(x & 0x0F == 0)) / BINS
    c = 2.0**-BITS
    return float(min(1.0, max(0.0, (m - c) / (1 - c))))


def fingerprint_column(texts: pa.Array) -> list[bytes]:
    raw, offsets = textkernel.text_buffers(texts)
    out: list[bytes] = []
    for lo, hi in textkernel.chunks(offsets):
        words = textkernel.Words(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1])
        out.extend(pack(bins_of(s)) for s in textkernel.shingles(words, SHINGLE))
    return out


#: Bytes of text of a bucket of neighbouring ids, and the most buckets there can be.
BUCKET_BYTES, MAX_BUCKETS = 64 << 20, 4096


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (bucket, head, doc_id, text), every bucket together and in order; ``head`` rows repeat the next bucket's first row.

    Where the whole table ends, the first row of all follows as the head.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # As many buckets as keep one near BUCKET_BYTES, so that a task's share doesn't grow with the table.
    shape = rows.agg(F.percentile_approx("doc_id", [i / MAX_BUCKETS for i in range(1, MAX_BUCKETS)], 10 * MAX_BUCKETS).alias("c"), F.sum(F.octet_length("text")).alias("size")).first()
    n = min(MAX_BUCKETS, max(partitions(spark), (shape["size"] or 0) // BUCKET_BYTES))
    cuts = shape["c"] or []
    cuts = sorted({cuts[i * MAX_BUCKETS // n - 1] for i in range(1, n)} if cuts else set())
    # Bucket b holds the ids above cuts[b-1], up to cuts[b].
    bucket = F.coalesce(F.size(F.filter(F.lit(cuts).cast("array<bigint>"), lambda c: c < F.col("doc_id"))), F.lit(0)) if cuts else F.lit(0)
    rows = rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(bucket).cast("int"))
    firsts = rows.groupBy("bucket").agg(F.min(F.struct(F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("k"), "doc_id", "text")).alias("f"))
    have = [r["bucket"] for r in rows.groupBy("bucket").count().collect()]  # at most n of them
    have.sort()
    before = {b: have[i - 1] for i, b in enumerate(have)}  # the last bucket comes before the first
    sent_to = F.create_map(*[F.lit(x) for b in have for x in (b, before[b])]) if have else F.create_map(F.lit(0), F.lit(0))
    heads = firsts.select(F.element_at(sent_to, F.col("bucket")).cast("int").alias("bucket"), F.lit(True).alias("head"), "f.doc_id", "f.text")
    both = rows.select("bucket", F.lit(False).alias("head"), "doc_id", "text").unionByName(heads)
    return both.repartition(n, "bucket").sortWithinPartitions("bucket", "head", "doc_id", "text")


def _edited(text: str, following: str) -> str:
    h = len(text) // 2
    return text[: len(text) - h] + following[:h]


def _compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None  # the row before: (bucket, doc_id, text, fingerprint)
    for batch in small(batches, 3):
        bucket, head, ids, texts = (batch.column(i) for i in range(4))
        texts = texts.cast(pa.large_string())
        prints = fingerprint_column(texts)
        rows = list(zip(bucket.to_pylist(), head.to_pylist(), ids.to_pylist(), texts.to_pylist(), prints))
        out = []
        for b, is_head, i, text, fp in rows:
            if held is not None and held[0] == b:
                out.append((held[1], held[2], held[3], _edited(held[2], text), fp))
            held = None if is_head else (b, i, text, fp)
        if not out:
            continue
        edited = [r[3] for r in out]
        edited_fp = fingerprint_column(pa.array(edited, pa.large_string()))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in out], pa.int64()),
                pa.array([len(r[1]) for r in out], pa.int64()),
                pa.array([hashlib.sha256(e.encode("utf-8")).hexdigest() for e in edited], pa.string()),
                pa.array([r[2].hex() for r in out], pa.string()),
                pa.array([e.hex() for e in edited_fp], pa.string()),
                pa.array([likeness(r[2], e) for r, e in zip(out, edited_fp)], pa.float64()),
                pa.array([likeness(r[2], r[4]) for r in out], pa.float64()),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )


def fingerprints(docs: DataFrame, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """``docs`` with ``out_col`` string: the packed fingerprint of each whole text, as hex."""
    from pyspark.sql.types import StringType, StructField, StructType

    bound_batches(docs.sparkSession)
    kept = [f for f in docs.schema.fields if f.name != out_col]
    names = [f.name for f in kept]
    at = names.index(text_col)

    def run(batches):
        for batch in small(batches, at):
            prints = [p.hex() for p in fingerprint_column(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints, pa.string())], [*names, out_col])

    return docs.select(*names).mapInArrow(run, StructType([*kept, StructField(out_col, StringType())]))


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(read(spark, sf_dir, "documents")).mapInArrow(_compare, schema)
