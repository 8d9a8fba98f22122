"""Substring dedup: repeated token windows, counted in Spark, merged into maximal removal intervals.

A window is ``WINDOW`` consecutive words of one document, known by its Rabin-Karp
hash.  A window is removed if its word sequence also starts in a document with a
smaller id; a word is removed if a removed window covers it.

All windows of a corpus are as many rows as words, so two exact steps come first:

* Copies.  Documents of at least one window with the same word sequence are
  grouped by its hash.  Only the one with the smallest id goes on; the others
  are removed whole.
* Anchors.  Of the ``WINDOW - GRAM + 1`` grams of ``GRAM`` words in a window, the
  one with the smallest hash (the first of equals) is its anchor.  Equal windows
  have equal anchors, so a window repeats only if its anchor occurs in a second
  document.  Anchors are a few hundredths of all positions; they are counted
  first, pre-aggregated in each task, and only windows over a repeated anchor are
  hashed, counted by Spark and joined back.

The removed windows of a document merge into maximal intervals before its text is
cut.  Nothing is capped: a passage that a third of all documents share costs each
of them its own windows.

Defined results: a null text has no words; documents shorter than a window lose
nothing, nor do rows without an id; a window repeats only in a smaller id, so rows
that share an id don't remove each other's words; other columns are dropped; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel
from .common import bound_batches, read, semi_reduced, semi_split, small, staged, unstage

WINDOW, GRAM = 50, 10


def anchor_positions(grams: np.ndarray, span: int) -> np.ndarray:
    """For each run of ``span`` grams, the position of its smallest (the first of equals)."""
    n = len(grams) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at = grams.copy(), np.arange(len(grams))
    width = 1  # best[i] is the smallest of grams[i : i + width]
    while width < span:
        step = min(width, span - width)
        m = len(best) - step
        later = best[step : step + m] < best[:m]
        at = np.where(later, at[step : step + m], at[:m])
        best = np.where(later, best[step : step + m], best[:m])
        width += step
    return at[:n]


def _docs(batch: pa.RecordBatch, text_at: int) -> Iterator[tuple[int, textkernel.Words, int, int]]:
    """(row, words of its piece, lo, hi): the words of every row of a batch."""
    raw, offsets = textkernel.text_buffers(batch.column(text_at))
    for lo, hi in textkernel.chunks(offsets):
        words = textkernel.Words(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1])
        bounds = words.bounds.tolist()
        for r in range(hi - lo):
            yield lo + r, words, bounds[r], bounds[r + 1]


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(a).view(np.int64), pa.int64())


def _sketch(window: int, gram: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(doc_id, key, text) -> (doc_id, key, whole, grams): the hash of a word sequence and its distinct anchors.

        Rows without a window (or an id) can neither lose a word nor cause it; they go no further.
        """
        for batch in small(batches, 2):
            take, whole, grams = [], [], []
            known = batch.column(0).is_valid().to_pylist()
            for row, words, a, b in _docs(batch, 2):
                if b - a < window or not known[row]:
                    continue
                h = words.hashes[a:b]
                g = textkernel.windows(h, gram)
                take.append(row)
                whole.append(textkernel.fold(h))
                grams.append(np.unique(g[np.unique(anchor_positions(g, window - gram + 1))]))
            if take:
                at = pa.array(np.cumsum([0] + [len(x) for x in grams]), pa.int32())
                flat = _signed(np.concatenate(grams))
                picked = batch.take(pa.array(take))
                yield pa.RecordBatch.from_arrays(
                    [picked.column(0), picked.column(1), _signed(np.array(whole, np.uint64)), pa.ListArray.from_arrays(at, flat)],
                    ["doc_id", "key", "whole", "grams"],
                )

    return run


def _windows(window: int, gram: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(doc_id, key, text, repeated anchors) -> (doc_id, key, window hash, position) of windows over a repeated anchor."""
        for batch in small(batches, 2):
            ids, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            repeated = batch.column(3)
            for row, words, a, b in _docs(batch, 2):
                if b - a < window:
                    continue
                h = words.hashes[a:b]
                g = textkernel.windows(h, gram)
                at = anchor_positions(g, window - gram + 1)
                known = np.sort(np.array(repeated[row].as_py(), np.int64).view(np.uint64))
                k = g[at]
                near = np.minimum(np.searchsorted(known, k), len(known) - 1)
                pos = np.flatnonzero(known[near] == k)
                if len(pos):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(pos), ids[row], np.int64)),
                            pa.array(np.full(len(pos), keys[row], np.int64)),
                            _signed(textkernel.windows(h, window)[pos]),
                            pa.array(pos.astype(np.int32)),
                        ],
                        ["doc_id", "key", "window", "pos"],
                    )

    return run


def intervals(positions: list[int], window: int) -> list[tuple[int, int]]:
    """Maximal word intervals (end exclusive) that windows at these sorted positions cover."""
    out: list[tuple[int, int]] = []
    for p in positions:
        if out and p <= out[-1][1]:
            out[-1] = (out[-1][0], p + window)
        else:
            out.append((p, p + window))
    return out


def _cut_texts(window: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(doc_id, text, copy, positions) -> (doc_id, n_words, n_removed, kept text, intervals)."""
        for batch in small(batches, 1):
            raw, offsets = textkernel.text_buffers(batch.column(1))
            copy = batch.column(2).to_pylist()
            positions = batch.column(3)
            n_words, n_removed, kept, cuts = [], [], [], []
            for lo, hi in textkernel.chunks(offsets):
                piece = raw[offsets[lo] : offsets[hi]]
                words = textkernel.Words(piece, offsets[lo : hi + 1], hashes=False)
                data = piece.tobytes()
                bounds = words.bounds.tolist()
                for r in range(hi - lo):
                    a, b = bounds[r], bounds[r + 1]
                    n = b - a
                    if copy[lo + r] and n >= window:
                        gone = [(0, n)]
                    else:
                        gone = intervals(sorted(positions[lo + r].as_py() or []), window)
                    keep = np.ones(n, bool)
                    for x, y in gone:
                        keep[x:y] = False
                    at = np.flatnonzero(keep) + a
                    text = b" ".join([data[s:e] for s, e in zip(words.starts[at].tolist(), words.ends[at].tolist())])
                    n_words.append(n)
                    n_removed.append(n - len(at))
                    kept.append(text.decode("utf-8", "replace"))
                    cuts.append([{"start": x, "end": y} for x, y in gone])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n_words, pa.int64()),
                    pa.array(n_removed, pa.int64()),
                    pa.array(kept, pa.string()),
                    pa.array([hashlib.sha256(k.encode("utf-8")).hexdigest() for k in kept], pa.string()),
                    pa.array(cuts, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                ],
                ["doc_id", "n_words", "n_removed", "kept", "kept_sha256", "removed"],
            )

    return run


KEPT = "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string, removed array<struct<start:int,end:int>>"


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, kept_sha256, removed intervals) of every row."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("key"), "text")  # an id may stand on rows of different texts
    sketch = staged(rows.mapInArrow(_sketch(window, gram), "doc_id long, key long, whole long, grams array<long>"), "sketch")

    firsts = sketch.groupBy("whole").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    copied = staged(firsts.where("first < last").select("whole", "first"), "copied")
    copies = staged(sketch.join(copied, "whole").where("doc_id > first").select("doc_id", "key").distinct(), "copies")

    # What repeats is written before it is joined back: Spark then splits a gram or window that very many documents hold.
    single = sketch.join(copies, ["doc_id", "key"], "left_anti").select("doc_id", "key", "grams")
    anchors = staged(single.select("doc_id", "key", F.explode("grams").alias("gram")), "anchors")
    unstage(sketch, copied)
    repeated = anchors.groupBy("gram").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    repeated = staged(repeated.select("gram"), "repeated")
    found = staged(anchors.join(repeated, "gram").groupBy("doc_id", "key").agg(F.collect_set("gram").alias("grams")), "found")
    unstage(anchors, repeated)

    wide = semi_reduced(rows, found, ["doc_id", "key"]).join(found, ["doc_id", "key"]).select("doc_id", "key", "text", "grams")
    windows = staged(wide.mapInArrow(_windows(window, gram), "doc_id long, key long, window long, pos int"), "windows")
    unstage(found)
    first = windows.groupBy("window").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    first = staged(first.select("window", "first"), "first")
    gone = windows.join(first, "window").where("doc_id > first")
    gone = gone.groupBy("doc_id", "key").agg(F.collect_set("pos").alias("positions"), F.lit(False).alias("copy"))
    marks = gone.unionByName(copies.select("doc_id", "key", F.array().cast("array<int>").alias("positions"), F.lit(True).alias("copy")))
    marks = staged(marks, "marks")
    unstage(windows, first, copies)

    # Texts that surely lose nothing stay where they are; only the others meet their marks.
    some, none = semi_split(rows, marks, ["doc_id", "key"])
    judged = some.join(marks, ["doc_id", "key"], "left").select("doc_id", "text", F.coalesce("copy", F.lit(False)).alias("copy"), "positions")
    whole = none.select("doc_id", "text", F.lit(False).alias("copy"), F.lit(None).cast("array<int>").alias("positions"))
    return judged.unionByName(whole).mapInArrow(_cut_texts(window), KEPT)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")
