"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

A benchmark item of L words is looked for in every window of L words.  Words are
maximal runs of letters and digits, lower-cased; a shingle is ``SHINGLE`` words
(or the whole item, if it is shorter).  Shingles are weighted by their rarity in
the benchmark, ln(1 + items / items that have it), and as if one item had it
where none has.  Item and window are similar if weight(A & B) >= threshold *
weight(A | B).

* Anchors.  A window that is similar has at least one of the item's first
  shingles in a fixed order, up to where what remains weighs less than the
  threshold.  So only windows around such a shingle can count (a window is placed
  so that the shared shingle stands where it stands in the item; where a document's
  placements for an item differ by less than the share of words that may differ, all
  windows between them count too), and the rest of
  the corpus is passed over by one hash join with the benchmark's anchors.
* Contents.  Equal windows, however many documents share them, are judged once.
* SimHash.  Each distinct window and each item has a 64-bit SimHash of its
  weighted shingles.  The bits are cut into ``radius + 1`` blocks; fingerprints
  within the radius agree in one block at least, so an equi-join on (item, block,
  bits of the block) finds all of them; their distance is then checked.
* Verification.  Candidates are held to the exact weighted similarity.

DataFrame expressions only.  The anchors are broadcast up to ``MAX_BROADCAST``
rows, which is counted before; beyond, the join shuffles.

Defined results: a null or empty text has no words and no leak; an item without
words is never found; repeated rows are reported once, repeated items each; a null id counts
as an id of its own; other columns are dropped; empty tables give an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read

SHINGLE, THRESHOLD, RADIUS = 5, 0.8, 20
MAX_BROADCAST = 500_000


def words_of(text):
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def grams(words, k: int):
    """Hashes of all runs of k words, in order (the words are bound once, as the outer lambda's variable)."""
    run = lambda w, i: F.xxhash64(*[F.get(w, i + j) for j in range(k)])
    all_runs = lambda w: F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: run(w, i)))
    return F.coalesce(F.get(F.transform(F.array(words), all_runs), F.lit(0)), F.array().cast("array<bigint>"))


def _blocks(fingerprint, radius: int):
    """(number, bits) of radius + 1 blocks that together are all 64 bits."""
    n, at, out = radius + 1, 0, []
    for b in range(n):
        width = 64 // n + (b < 64 % n)
        bits = F.shiftrightunsigned(fingerprint, at).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        out.append(F.struct(F.lit(b).alias("block"), bits.alias("bits")))
        at += width
    return F.array(*out)


def _simhash(weighed: DataFrame, key: str) -> DataFrame:
    """(key, fingerprint) from rows (key, h, w)."""
    up = lambda b: F.sum(F.when(F.shiftrightunsigned("h", b).bitwiseAND(F.lit(1)) == 1, F.col("w")).otherwise(-F.col("w")))
    summed = weighed.groupBy(key).agg(*[up(b).alias(f"b{b}") for b in range(64)])
    word = F.lit(0).cast("long")
    for b in range(64):
        word = word.bitwiseOR(F.when(F.col(f"b{b}") > 0, F.lit(1 << b if b < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")))
    return summed.select(key, word.alias("fingerprint"))


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    threshold: float = THRESHOLD,
    radius: int = RADIUS,
) -> DataFrame:
    """(doc_id, key, item_id, start, end, similarity): each document's best window (in words) for each item it leaks; ``key`` is xxhash64 of its text."""
    items = benchmark.select(F.col(item_col).alias("item_id"), words_of(F.col(item_text)).alias("_w")).where(F.size("_w") > 0)
    items = items.withColumn("len", F.size("_w")).withColumn("k", F.least("len", F.lit(SHINGLE)))
    by_k = F.array().cast("array<bigint>")
    for k in range(SHINGLE, 0, -1):
        by_k = F.when(F.col("k") == k, grams(F.col("_w"), k)).otherwise(by_k)
    # Equal items are one; every id of it is named in the result.
    items = items.select("item_id", "len", "k", by_k.alias("g")).withColumn("it", F.xxhash64("g", "len", "k"))
    items = cut(items)
    kinds = items.groupBy("it", "len", "k").agg(F.min("g").alias("g"), F.count("*").alias("n"))
    shape = items.groupBy().agg(F.count("*").alias("n"), F.collect_set("k").alias("ks"), F.sum(F.size("g")).alias("size")).first()
    if not shape["n"]:
        return docs.sparkSession.createDataFrame([], "doc_id long, key long, item_id long, start int, end int, similarity double")
    total = shape["n"]
    spread = items.select("k", F.explode(F.array_distinct("g")).alias("h")).groupBy("h").agg(F.count("*").alias("df"))
    spread = spread.select("h", F.log(1 + F.lit(float(total)) / F.col("df")).alias("w"))
    unknown = math.log(1.0 + total)

    inside = kinds.select("it", "len", "k", F.explode(F.array_distinct("g")).alias("h")).join(spread, "h")
    kept = inside.groupBy("it", "len", "k").agg(F.map_from_entries(F.collect_list(F.struct("h", "w"))).alias("weights"), F.sum("w").alias("sum"))
    ordered = inside.groupBy("it").agg(F.array_sort(F.collect_list(F.struct(F.negative("w").alias("nw"), "h"))).alias("o"), F.sum("w").alias("sum"))
    # Rarest first; an anchor is what has at least the threshold's weight from itself to the end.
    rest = F.transform("o", lambda x, i: F.struct(x["h"].alias("h"), F.aggregate(F.slice("o", F.lit(1), i), F.col("sum"), lambda a, y: a + y["nw"]).alias("left")))
    anchors = ordered.select("it", F.explode(F.filter(rest, lambda x: x["left"] >= F.col("sum") * threshold - 1e-9)).alias("a"))
    place = kinds.select("it", "len", "k", F.posexplode("g").alias("off", "h")).groupBy("it", "len", "k", "h").agg(F.min("off").alias("off"))
    anchors = cut(anchors.select("it", F.col("a.h").alias("h")).join(place, ["it", "h"]))

    # Every window of the corpus that holds an anchor, placed by it; the corpus is read once for shingles of all lengths.
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key"), words_of(F.col(text_col)).alias("_w"))
    each = F.array(*[F.struct(F.lit(k).alias("k"), grams(F.col("_w"), k).alias("g")) for k in sorted(shape["ks"])])
    rows = rows.select("doc_id", "key", F.inline(each)).select("doc_id", "key", "k", "g", F.posexplode("g").alias("pos", "h"))
    placed = rows.join(F.broadcast(anchors) if shape["size"] <= MAX_BROADCAST else anchors, ["k", "h"])
    last = F.size("g") + F.col("k") - F.col("len")
    placed = placed.withColumn("start", F.greatest(F.lit(0), F.least(F.col("pos") - F.col("off"), last)))
    # Words put in or taken out move the anchors behind them: all windows between neighbouring placements of an item are looked at too.
    of_doc = placed.groupBy("doc_id", "key", "it", "len", "k").agg(F.first("g").alias("g"), F.array_sort(F.collect_set("start")).alias("starts"))
    near = lambda here, there: F.when(there - here <= F.greatest(F.lit(1), F.floor(F.col("len") * (1 - threshold))), there - 1).otherwise(here)
    runs = F.transform("starts", lambda x, i: F.sequence(x, F.coalesce(near(x, F.get("starts", i + 1)), x).cast("int")))
    found = of_doc.select("doc_id", "key", "it", "len", "k", "g", F.explode(F.flatten(runs)).alias("start"))
    found = found.withColumn("g", F.slice("g", F.col("start") + 1, F.greatest(F.col("len") - F.col("k") + 1, F.lit(1))))
    found = cut(found.withColumn("win", F.xxhash64("g", "len", "k")))

    # Each distinct content once: its weights, its fingerprint.
    contents = found.groupBy("win", "len", "k").agg(F.min("g").alias("g"))
    weighed = contents.select("win", "len", "k", F.explode(F.array_distinct("g")).alias("h")).join(spread, "h", "left")
    weighed = cut(weighed.withColumn("w", F.coalesce("w", F.lit(unknown))))
    of_win = weighed.groupBy("win", "len", "k").agg(F.map_from_entries(F.collect_list(F.struct("h", "w"))).alias("ww"), F.sum("w").alias("wsum"))
    of_win = of_win.join(_simhash(weighed, "win"), "win").withColumnRenamed("fingerprint", "wf")
    of_item = kept.join(_simhash(inside, "it"), "it").withColumnRenamed("fingerprint", "itf")

    # The anchors have told which item a window may be like, so the blocks meet within an item.
    asked = found.select("win", "it").distinct()
    left = of_win.select("win", "wf").join(asked, "win").select("win", "it", "wf", F.inline(_blocks(F.col("wf"), radius)))
    right = of_item.select("it", "itf", F.inline(_blocks(F.col("itf"), radius)))
    near = left.join(right, ["it", "block", "bits"]).where(F.bit_count(F.col("wf").bitwiseXOR(F.col("itf"))) <= radius)
    near = near.select("win", "it").distinct()

    both = near.join(of_win.select("win", "ww", "wsum"), "win").join(of_item.select("it", "weights", "sum"), "it")
    inter = F.aggregate(
        F.map_values(F.map_filter("ww", lambda h, w: F.map_contains_key("weights", h))), F.lit(0.0), lambda a, w: a + w
    )
    both = both.withColumn("inter", inter).withColumn("similarity", F.col("inter") / (F.col("sum") + F.col("wsum") - F.col("inter")))
    similar = both.where(F.col("similarity") >= threshold - 1e-9).select("win", "it", "similarity")

    hits = found.select("doc_id", "key", "start", "len", "win", "it").join(similar, ["win", "it"]).join(items.select("it", "item_id"), "it")
    best = hits.groupBy("doc_id", "key", "item_id").agg(F.max(F.struct("similarity", F.negative("start").alias("s"), "len")).alias("m"))
    start = F.negative("m.s")
    return best.select("doc_id", "key", "item_id", start.alias("start"), (start + F.col("m.len")).alias("end"), F.round("m.similarity", 9).alias("similarity"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("key")
