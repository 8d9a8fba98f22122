"""N-gram Jaccard join in the metric space of shingle sets: exact components of near duplicates.

d(A, B) = 1 - |A & B| / |A | B| is a metric on sets, and two documents link when
d <= e, e = 1 - threshold.  The join works on classes (documents with equal
shingle sets are one class from the start, so copies cost nothing more).

Pivots.  Each class has ``KEYS`` keys, the least of its shingles in each of so
many hash ranges; a class is a pivot if it is the least class of more than
``PIVOT_SHARE`` of its keys' groups.  So a class without kin is a pivot, and of a
group of kin the least one is and only those whose own edits changed nearly all
of their keys.  Every class is compared with every pivot within ``e`` (below); a
class that is linked with a pivot belongs to the Voronoi region of its nearest
one.  The classes that are no pivots, and can link with such a class at all by the
bounds below, are partitioned again for the sake of those linked with none so far:
new pivots are the most central classes around them (those with the fewest shingles
that no other class has), by the same rule and then by a weaker one
(``LATER_SHARES``); what then remains become pivots all.  So recursion ends, and
every class that can have a link is a pivot or within ``e`` of the pivot whose
region it is in.

Windows.  Let x lie in the region of p, and let y, no pivot either, link with x.
By the triangle inequality d(y, p) <= d(x, p) + e <= 2e.  So y is replicated into
every region whose pivot is within that window, and each region joins its own
members with what its window has brought in.  Members that the links with pivots
have already put into one component needn't be compared: they can't change it.
This is what keeps a group of a third of all documents linear.

Distances.  Pairs within a radius share some of their rarest shingles: with
overlap o needed of n, at least m of the first n - o + m in any order common to
all.  m grows with the set (``least_shared``), so that neither a chance shingle nor a
short passage in common makes a pair.
The order is by a level, the magnitude of a shingle's count over all batches in
hash buckets (``BUCKETS`` of them: its size doesn't depend on the corpus), then by
hash; so a passage which many documents share is at the end of the order.  Two
lower bounds of the distance keep a group of kin from being verified pair by pair:
each set carries PARITY bits, whether it holds an odd number of each class of
shingles (as many as differ between two sets, so many shingles differ at least),
and at the deeper levels the number of shingles that no other set there holds.
Every pair that is left is verified by the exact intersection.

Defined results: a text of fewer words than ``k`` has its whole word sequence as
its one shingle; one without words, or a null text, has an empty set and links
with nothing; a null id gets a null component; rows that share an id are
documents of their own; other columns are dropped; an empty table gives an empty
table.  Shingles are 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel
from .common import bound_batches, cut, read, semi_reduced, small, staged, unstage

KEYS = 8
PIVOT_SHARE = 0.75
#: Of the deeper levels; below 0 is everything that is left.
LATER_SHARES = (0.75, 0.5, -1.0)
BUCKETS = 1 << 20
_SHIFT = np.uint64(44)  # a bucket is a hash's first 20 bits
#: A bucket's count from which it has a level above the lowest.
COMMON = 4
#: Bits of a set's parity.
PARITY = 512


def needed(n: np.ndarray | int, percent: int):
    """The least overlap of a set of n with any set at that similarity."""
    return (n * percent + 99) // 100


def least_shared(n: np.ndarray | int):
    """How many of the rarest shingles a set of n must share with a partner (at most what it must share at all)."""
    return 1 + n // 32


def prefix_length(n: int, percent: int) -> int:
    return min(n, n - needed(n, percent) + least_shared(n))


def parity(s: np.ndarray) -> np.ndarray:
    """PARITY bits, one for each class of hashes: whether the set holds an odd number of that class.

    Sets whose bits differ in x places differ in at least x shingles, whatever else they hold.
    """
    odd = (np.bincount((s & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.uint64)


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(a).view(np.int64), pa.int64())


def _sets(col: pa.Array, k: int) -> Iterator[np.ndarray]:
    raw, offsets = textkernel.text_buffers(col)
    for lo, hi in textkernel.chunks(offsets):
        yield from textkernel.shingles(textkernel.Words(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1], lower=True), k)


def _common(k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(text) -> (bucket, count) of the shingles that some thousand rows have more than once."""
        for batch in small(batches, 0, 4 << 20):
            s = np.sort(np.concatenate([*_sets(batch.column(0), k), np.zeros(0, np.uint64)]))
            if not len(s):
                continue
            first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            n = np.diff(np.append(first, len(s)))
            many = n > 1
            bucket, at = np.unique((s[first[many]] >> _SHIFT).astype(np.int64), return_inverse=True)
            if len(bucket):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket), pa.array(np.bincount(at, n[many]).astype(np.int64))], ["bucket", "count"]
                )

    return run


class Order:
    """The common order of shingles: by their bucket's level, then by hash."""

    def __init__(self, levels: np.ndarray):
        self.packed = zlib.compress(levels.tobytes(), 1)
        self._levels = None

    def __getstate__(self):
        return {"packed": self.packed, "_levels": None}

    def sort(self, s: np.ndarray) -> np.ndarray:
        if self._levels is None:
            self._levels = np.frombuffer(zlib.decompress(self.packed), np.uint8)
        level = self._levels[(s >> _SHIFT).astype(np.int64)]
        return s if not level.any() else s[np.argsort(level, kind="stable")]


def shingle_order(texts: DataFrame, k: int) -> Order:
    """Over all texts; at most BUCKETS rows of two numbers come to the driver."""
    counts = texts.mapInArrow(_common(k), "bucket long, count long").groupBy("bucket").agg(F.sum("count").alias("n"))
    found = counts.where(F.col("n") >= COMMON).toPandas()
    levels = np.zeros(BUCKETS, np.uint8)
    levels[found["bucket"].to_numpy(np.int64)] = np.log2(found["n"].to_numpy(np.float64)).astype(np.uint8)
    return Order(levels)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate([*parts, np.zeros(0, np.uint64)])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(p) for p in parts]), pa.int32()), _signed(flat))


def _describe(k: int, percent: int, order: Order):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(doc_id, key, text) -> (doc_id, key, n, node, prefix, keys, parity)."""
        for batch in small(batches, 2):
            sizes, nodes, prefixes, keys, bits = [], [], [], [], []
            for s in _sets(batch.column(2), k):
                n = len(s)
                sizes.append(n)
                nodes.append(textkernel.fold(s))
                bits.append(parity(s))
                ranked = order.sort(s)
                prefixes.append(ranked[: prefix_length(n, percent)] if n else ranked)
                # By hash alone: the rarest shingles of a near copy are those of its own edits.
                _, first = np.unique(s >> np.uint64(61), return_index=True)
                keys.append(s[first])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), _signed(np.array(nodes, np.uint64)), _lists(prefixes), _lists(keys), _lists(bits)],
                ["doc_id", "key", "n", "node", "prefix", "keys", "parity"],
            )

    return run


def _prefixes(k: int, order: Order, percent: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(node, text) -> (node, n, prefix) for pairs at least so similar."""
        for batch in small(batches, 1):
            ranked = [order.sort(s) for s in _sets(batch.column(1), k)]
            cut_at = [prefix_length(len(s), percent) for s in ranked]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in ranked], pa.int64()), _lists([s[:c] for s, c in zip(ranked, cut_at)])], ["node", "n", "prefix"]
            )

    return run


def _whole(k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(node, text) -> (node, all shingles)."""
        for batch in small(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(list(_sets(batch.column(1), k)))], ["node", "set"])

    return run


def _overlaps(k: int, columns: list[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(columns..., text of a, text of b) -> (columns..., size of the intersection, of the union)."""
        n = len(columns)
        for batch in small(batches, n):
            inter, either = [], []
            for x, y in zip(_sets(batch.column(n), k), _sets(batch.column(n + 1), k)):
                both = len(np.intersect1d(x, y, assume_unique=True))
                inter.append(both)
                either.append(len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(n)], pa.array(inter, pa.int64()), pa.array(either, pa.int64())], [*columns, "inter", "either"]
            )

    return run


def _pivots(nodes: DataFrame, share: float, rank: tuple[str, ...] = (), of: DataFrame | None = None) -> DataFrame:
    """(node) of those that are the least, by ``rank`` and then node, of more than ``share`` of their keys' groups.

    With ``of``, only groups that hold one of its nodes count; the least may be any of ``nodes``.
    """
    keyed = nodes.select("node", *rank, F.explode("keys").alias("key"))
    if of is not None:
        keyed = keyed.join(of.select(F.explode("keys").alias("key")).distinct(), "key", "left_semi")
    least = keyed.groupBy("key").agg(F.min(F.struct(*rank, "node"))["node"].alias("least"))
    won = keyed.join(least, "key").groupBy("node").agg(F.avg((F.col("least") == F.col("node")).cast("int")).alias("won"))
    return won.where(F.col("won") > share).select("node")


def _shared(n, m, percent: int):
    """The least number of prefix shingles that sets of n and m share if they are so similar."""
    overlap = F.floor((F.greatest(n, m) * percent + 99) / 100)
    return F.least(1 + F.floor(F.least(n, m) / 32), overlap)


def _near_parity(xa: str, xb: str, na: str, nb: str, percent: int):
    """Whether sets may be so similar, by the least number of shingles in which their parities say that they differ."""
    differ = sum((F.bit_count(F.get(xa, F.lit(i)).bitwiseXOR(F.get(xb, F.lit(i)))) for i in range(PARITY // 64)), F.lit(0))
    return differ * (100 + percent) <= (F.col(na) + F.col(nb)) * (100 - percent)


def _candidates(items: DataFrame, percent: int) -> DataFrame:
    """(a, b) with a < b, at least one of them a pivot: what shares enough prefix shingles and is of fitting size.

    ``shared``, if there, holds those of the prefix that another of ``items`` has in its own, each with its place, and
    ``alone`` is how many shingles of the whole set no other set holds, so that none can have them in common with it.
    Before a shingle that both prefixes hold, all that the sets have in common is in both prefixes, so in ``shared``;
    of what is not in ``shared``, at most as much as stands before the shingle is of those that it has alone.
    """
    ends = lambda one, x: one.select("s", *[F.col(c).alias(c + x) for c in one.columns if c != "s"])
    some = (F.col("pivota") | F.col("pivotb")) & (F.col("nodea") < F.col("nodeb"))
    if "shared" in items.columns:
        one = items.select("node", "n", "pivot", "parity", "alone", F.posexplode("shared").alias("before", "x"))
        later = F.greatest(F.lit(0), F.col("alone") - (F.col("x.pos") - F.col("before")))
        one = one.select("node", "n", "pivot", "parity", "before", (F.col("n") - F.col("x.pos") - later).alias("after"), F.col("x.s").alias("s"))
        most = F.least("beforea", "beforeb") + F.least("aftera", "afterb")  # in common before the shingle, and from it on
        fits = some & _near_parity("paritya", "parityb", "na", "nb", percent)
    else:
        one = items.select("node", "n", "pivot", F.explode("prefix").alias("s"))
        most, fits = F.least("na", "nb"), some
    fits = fits & (most * (100 + percent) >= (F.col("na") + F.col("nb")) * percent)
    both = ends(one, "a").join(ends(one, "b"), "s").where(fits).groupBy("nodea", "nodeb", "pivota", "pivotb", "na", "nb").count()
    both = both.select(F.col("nodea").alias("a"), F.col("nodeb").alias("b"), F.col("pivota").alias("pa"), F.col("pivotb").alias("pb"), "na", "nb", "count")
    return both.where(F.col("count") >= _shared("na", "nb", percent)).select("a", "b", "pa", "pb")


def _linkable(items: DataFrame, percent: int) -> DataFrame:
    """(node, own, shared) of what shares enough prefix shingles with others of ``items`` that it may link with one.

    ``shared`` are those shingles with their places in the prefix, ``own`` is how many it doesn't share; another set may hold such a one past its prefix.
    """
    one = items.select("node", "n", F.size("prefix").alias("size"), F.posexplode("prefix").alias("pos", "s"))
    several = one.groupBy("s").count().where("count > 1").select("s")
    shared = one.join(several, "s").groupBy("node", "n", "size").agg(F.array_sort(F.collect_list(F.struct("pos", "s"))).alias("shared"))
    least = F.floor((F.col("n") * percent + 99) / 100)  # of the overlap and of the partner's size
    enough = F.size("shared") >= F.least(1 + F.floor(least / 32), least)
    return shared.where(enough).select("node", (F.col("size") - F.size("shared")).alias("own"), "shared")


def _with_alone(items: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """``items`` with ``alone``, how many shingles of a set no other whole set of ``items`` holds; without those that have
    too many to link with any."""
    sets = texts.join(items.select("node"), "node", "left_semi").select("node", "text").mapInArrow(_whole(k), "node long, set array<long>")
    held = sets.select("node", F.explode("set").alias("s")).groupBy("s").agg(F.count("*").alias("held"), F.min("node").alias("node"))
    alone = held.where("held = 1").groupBy("node").agg(F.count("*").alias("alone"))
    out = items.join(alone, "node", "left").withColumn("alone", F.coalesce("alone", F.lit(0)))
    return out.where((F.col("n") - F.col("alone")) * 100 >= F.col("n") * percent)


def _verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """``pairs`` at least so similar, with ``inter`` and ``either`` (the sizes of intersection and union)."""
    a = texts.select(F.col("node").alias("a"), F.col("text").alias("_ta"))
    b = texts.select(F.col("node").alias("b"), F.col("text").alias("_tb"))
    columns = pairs.columns
    both = pairs.join(a, "a").join(b, "b").select(*columns, "_ta", "_tb")
    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema.fields], "inter long, either long"])
    return both.mapInArrow(_overlaps(k, columns), schema).where(F.col("inter") * 100 >= F.col("either") * percent)


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, label): the least node of each node's component, by alternating large and small stars."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("u"), F.col("v")).union(e.select(F.col("v"), F.col("u"))) if large else e
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        moved = both.join(least, "u")
        if large:
            out = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        return out.where("u <> v").distinct()

    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e, seen = cut(e), None
    for _ in range(rounds):
        e = cut(star(star(e, True), False))
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components have not converged")
    labels = e.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return labels.union(e.select(F.col("v"), F.col("v")).distinct())


def near_duplicates(docs: DataFrame, k: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, n_shingles, component_id) of every row; ``key`` is xxhash64 of its text.

    Two documents link when 100 * |A & B| >= percent * |A | B|, over sets of k-word shingles.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("key"), "text")
    order = shingle_order(rows.select("text"), k)
    kind = "doc_id long, key long, n long, node long, prefix array<long>, keys array<long>, parity array<long>"
    told = staged(rows.mapInArrow(_describe(k, percent, order), kind), "described")

    # Classes of equal sets, each with its least document; one row of a class stands for it.
    usable = told.where("n > 0 AND doc_id IS NOT NULL")
    classes = usable.groupBy("node", "n").agg(F.min(F.struct("doc_id", "key")).alias("at"))
    classes = staged(classes.select("node", "n", F.col("at.doc_id").alias("doc_id"), F.col("at.key").alias("key")), "classes")
    # Rows that share an id and a text are alike, so any of them may give a class its set.
    repeated = not told.groupBy("doc_id", "key").count().where("count > 1").limit(1).isEmpty()
    one = told.select("doc_id", "key", "node", "keys")
    one = (one.dropDuplicates(["doc_id", "key"]) if repeated else one).join(classes, ["doc_id", "key", "node"]).select("node", "keys")
    pivot = _pivots(one, PIVOT_SHARE).withColumn("pivot", F.lit(True))
    flagged = classes.join(pivot, "node", "left").withColumn("pivot", F.coalesce("pivot", F.lit(False)))
    one = told.select("doc_id", "key", "node", "prefix", "keys", "parity")
    nodes = (one.dropDuplicates(["doc_id", "key"]) if repeated else one).join(flagged, ["doc_id", "key", "node"])
    nodes = staged(nodes, "nodes")
    described, told = told, staged(told.select("doc_id", "key", "n", "node"), "told")
    unstage(described)

    pairs = staged(_candidates(nodes, percent), "pairs")
    rest = nodes.where("NOT pivot")
    rest = staged(rest.join(_linkable(rest, percent), "node"), "rest")
    unstage(nodes)
    wanted = rest.select("node").union(pairs.select("a")).union(pairs.select("b")).distinct()
    texts = classes.select("node", "doc_id", "key").join(wanted, "node", "left_semi")
    texts = semi_reduced(rows, texts, ["doc_id", "key"]).join(texts, ["doc_id", "key"]).select("node", "text")
    texts = staged(texts.dropDuplicates(["node"]) if repeated else texts, "texts")
    links = staged(_verified(pairs, texts, k, percent), "links")
    unstage(pairs)

    # Deeper levels of the recursion: new pivots for what is linked with none.
    linkable, fit = rest, staged(_with_alone(rest.drop("own", "shared"), texts, k, percent), "fit")
    rest = staged(fit.join(_linkable(fit, percent), "node"), "rest")  # what a set has alone among more isn't shared among fewer
    unstage(linkable, fit)
    found, left = [links], staged(rest.join(_ends(links), "node", "left_anti").select("node", "keys"), "left")
    for share in LATER_SHARES:
        if left.isEmpty():
            break
        new = staged(_pivots(rest, share, ("alone", "own"), left) if share >= 0 else left.select("node"), "pivots")
        level = rest.drop("pivot").join(new.withColumn("pivot", F.lit(True)), "node", "left").withColumn("pivot", F.coalesce("pivot", F.lit(False)))
        more = staged(_verified(_candidates(level, percent), texts, k, percent), "links")
        found.append(more)
        done, left = left, staged(left.join(new, "node", "left_anti").join(_ends(more), "node", "left_anti"), "left")
        before, rest = rest, staged(rest.join(new, "node", "left_anti"), "rest")
        unstage(done, before, new)

    edges = found[0]
    for more in found[1:]:
        edges = edges.unionByName(more)
    label = staged(components(edges), "labels")
    late = _region_links(edges, rest, texts, label, k, percent, order)
    if not late.isEmpty():
        first, label = label, staged(components(edges.select("a", "b").unionByName(late)), "labels")
        unstage(first)
    unstage(*found, left, rest, texts, late)

    named = classes.select("node", "doc_id").join(label, "node", "left").select("node", "doc_id", F.coalesce("label", "node").alias("label"))
    least = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = named.join(least, "label").select("node", "component_id")
    out = told.select("doc_id", "key", F.col("n").alias("n_shingles"), "node").join(named, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "key", "n_shingles", component.alias("component_id"))


def _ends(links: DataFrame) -> DataFrame:
    return links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).distinct()


def _region_links(edges: DataFrame, rest: DataFrame, texts: DataFrame, label: DataFrame, k: int, percent: int, order: Order) -> DataFrame:
    """Links between members of regions (no pivots) that lie in different components so far.

    x is in the region of its nearest pivot p; y comes in by the window d(y, p) <= d(x, p) + e.
    """
    e = 1 - percent / 100
    wide = max(0, 2 * percent - 100)  # similarity at distance 2e
    to_pivot = edges.where("pa").select(F.col("b").alias("x"), F.col("a").alias("p"), "inter", "either").union(
        edges.where("pb").select(F.col("a"), F.col("b"), F.col("inter"), F.col("either"))
    )
    near = to_pivot.withColumn("d", 1 - F.col("inter") / F.col("either")).join(rest.select(F.col("node").alias("x")), "x", "left_semi")
    member = near.groupBy("x").agg(F.min(F.struct("d", "p")).alias("m")).select("x", "m.d", "m.p")
    member = staged(member.join(label.select(F.col("node").alias("x"), F.col("label").alias("cx")), "x"), "members")
    owners = member.groupBy("p").agg(F.max("d").alias("reach"), F.min("cx").alias("c_min"), F.max("cx").alias("c_max"))
    owners = staged(owners, "owners")

    parts = texts.join(member.select(F.col("x").alias("node")).union(owners.select("p")).distinct(), "node", "left_semi").select("node", "text")
    parts = staged(parts.mapInArrow(_prefixes(k, order, wide), "node long, n long, prefix array<long>"), "prefixes")
    probe = parts.join(label, "node").select(F.col("node").alias("y"), F.col("n").alias("ny"), F.col("label").alias("cy"), F.explode("prefix").alias("s"))
    probe = probe.join(member.select(F.col("x").alias("y")), "y", "left_semi")
    index = parts.join(owners.withColumnRenamed("p", "node"), "node").select(
        F.col("node").alias("p"), F.col("n").alias("np"), "c_min", "c_max", "reach", F.explode("prefix").alias("s")
    )
    # A region all of whose members are in y's component has nothing to gain from y.
    useful = (F.col("c_min") != F.col("cy")) | (F.col("c_max") != F.col("cy"))
    fits = F.least("ny", "np") * 100 >= F.greatest("ny", "np") * wide
    ring = probe.join(index, "s").where(useful & fits).groupBy("y", "p", "cy", "reach", "ny", "np").count()
    ring = ring.where(F.col("count") >= _shared("ny", "np", wide)).select(F.col("y").alias("a"), F.col("p").alias("b"), "cy", "reach")
    ring = _verified(ring, texts, k, wide).withColumn("dy", 1 - F.col("inter") / F.col("either"))
    ring = staged(ring.where(F.col("dy") <= F.col("reach") + e + 1e-9).select(F.col("a").alias("y"), F.col("b").alias("p"), "cy", "dy"), "ring")
    # Within a region too, only what shares one of its rarest shingles can link.
    own = rest.select("node", "n", "parity", F.explode("prefix").alias("s"))
    inside = member.join(own.select(F.col("node").alias("x"), F.col("n").alias("nx"), F.col("parity").alias("px"), "s"), "x").select("p", "s", "x", "cx", "d", "nx", "px")
    around = ring.join(own.select(F.col("node").alias("y"), F.col("n").alias("ny"), F.col("parity").alias("py"), "s"), "y").select("p", "s", "y", "cy", "dy", "ny", "py")
    fits = (F.col("cx") != F.col("cy")) & (F.col("dy") <= F.col("d") + e + 1e-9) & _near_parity("px", "py", "nx", "ny", percent)
    pairs = inside.join(around, ["p", "s"]).where(fits)
    pairs = pairs.groupBy("p", "x", "y", "nx", "ny").count().where(F.col("count") >= _shared("nx", "ny", percent))
    pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    late = staged(_verified(pairs, texts, k, percent).select("a", "b"), "late")
    unstage(member, owners, parts, ring)
    return late


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), k=4, percent=85).select("doc_id", "n_shingles", "component_id")
