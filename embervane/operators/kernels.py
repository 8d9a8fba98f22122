"""Dense linear algebra inside one slice: blocked all-pairs distances, in Arrow-fed grouped maps.

A group is held by one task, so a slice must be bounded; adaptive cells
(``slices.adaptive_level``) keep it at ``max_slice_size`` rows, and a group of more than ``MAX_GROUP`` rows is refused.  Distances are
made ``BLOCK`` rows at a time, so a task needs BLOCK x n doubles beside its slice.  The local outlier factor of a whole
table deals pairs of blocks out to tasks instead, so its rows are not bounded.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import cut

BLOCK = 1024
#: Rows of a block where all rows of a table are compared, and bytes of vectors that one task compares with a block.
WIDE_BLOCK, STRIPE = 1536, 64 << 20
#: Rows of a group beyond which a kernel refuses: its distances are all pairs of one task.
MAX_GROUP = 50_000


def effective_k(n: int, k: int) -> int:
    """k, or the root of n (at most 50) where that is larger, but less than n."""
    return max(0, min(max(k, min(int(np.sqrt(n)), 50)), n - 1))


def _unit(col: pd.Series) -> np.ndarray:
    x = np.stack(col.to_numpy()).astype(np.float64)
    return x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12)


def _grouped(df: DataFrame, keys: list[str], cols: list[str], fn, out: list[T.StructField]) -> DataFrame:
    def bounded(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > MAX_GROUP:
            raise ValueError(f"a slice of {len(pdf)} rows: distances of all pairs are made for at most {MAX_GROUP}; divide it (max_slice_size, more keys)")
        return fn(pdf)

    picked = df.select(*dict.fromkeys([*keys, *cols]))
    return picked.groupBy(*keys).applyInPandas(bounded, T.StructType(out))


def knn_distance(df: DataFrame, keys: list[str], id_col: str, vec: str = "embedding", k: int = 10, adaptive_k: bool = True) -> DataFrame:
    """(id, knn_distance): mean cosine distance to the k nearest others of the slice; 0 in a slice of one."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n = len(pdf)
        kk = effective_k(n, k) if adaptive_k else min(k, n - 1)
        out = np.zeros(n)
        if kk > 0:
            x = _unit(pdf[vec])
            for lo in range(0, n, BLOCK):
                d = 1 - x[lo : lo + BLOCK] @ x.T
                d[np.arange(len(d)), np.arange(lo, lo + len(d))] = np.inf
                out[lo : lo + BLOCK] = np.partition(d, kk - 1, axis=1)[:, :kk].mean(1)
        return pd.DataFrame({id_col: pdf[id_col], "knn_distance": np.nan_to_num(out)})

    return _grouped(df, keys, [id_col, vec], run, [df.schema[id_col], T.StructField("knn_distance", T.DoubleType())])


def knn_other_groups(df: DataFrame, keys: list[str], id_col: str, group_col: str, vec: str = "embedding", k: int = 10) -> DataFrame:
    """(id, knn_distance): only rows of other groups are neighbours; 0 where there are none."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, g = _unit(pdf[vec]), pdf[group_col].to_numpy()
        out = np.zeros(len(pdf))
        for lo in range(0, len(pdf), BLOCK):
            d = 1 - x[lo : lo + BLOCK] @ x.T
            d[g[lo : lo + BLOCK, None] == g[None, :]] = np.inf
            d = np.sort(d, axis=1)[:, :k]
            ok = np.isfinite(d)
            out[lo : lo + BLOCK] = np.where(ok, d, 0).sum(1) / np.maximum(ok.sum(1), 1)
        return pd.DataFrame({id_col: pdf[id_col], "knn_distance": out})

    return _grouped(df, keys, [id_col, group_col, vec], run, [df.schema[id_col], T.StructField("knn_distance", T.DoubleType())])


def knn_labels(df: DataFrame, keys: list[str], id_col: str, label_col: str, vec: str = "embedding", k: int = 10, only: str | None = None) -> DataFrame:
    """(id, same_label_frac, majority_label, majority_frac) over the nearest others of the context; ties go to the smallest label."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(id_col, kind="stable").reset_index(drop=True)
        n = len(pdf)
        kk = effective_k(n, k)
        pick = np.flatnonzero(pdf[only].to_numpy(bool)) if only else np.arange(n)
        names, code = np.unique(pdf[label_col].to_numpy(), return_inverse=True)
        same, major, frac = np.full(len(pick), np.nan), np.zeros(len(pick), np.int64), np.full(len(pick), np.nan)
        if kk > 0:
            x = _unit(pdf[vec])
            for lo in range(0, len(pick), BLOCK):
                rows = pick[lo : lo + BLOCK]
                d = 1 - x[rows] @ x.T
                d[np.arange(len(rows)), rows] = np.inf
                near = np.argsort(d, axis=1, kind="stable")[:, :kk]
                votes = np.zeros((len(rows), len(names)))
                np.add.at(votes, (np.arange(len(rows))[:, None], code[near]), 1)
                same[lo : lo + BLOCK] = votes[np.arange(len(rows)), code[rows]] / kk
                major[lo : lo + BLOCK] = votes.argmax(1)
                frac[lo : lo + BLOCK] = votes.max(1) / kk
        ids = pdf[id_col].to_numpy()[pick]
        label = [names[m] if f == f else None for m, f in zip(major, frac)]
        return pd.DataFrame({id_col: ids, "same_label_frac": same, "majority_label": label, "majority_frac": frac})

    fields = [df.schema[id_col], T.StructField("same_label_frac", T.DoubleType()), T.StructField("majority_label", df.schema[label_col].dataType), T.StructField("majority_frac", T.DoubleType())]
    return _grouped(df, keys, [id_col, label_col, vec, *([only] if only else [])], run, fields)


class _Nearest:
    """The k nearest others of some rows by (Euclidean distance, row number), from blocks of rows in any order.

    A matrix product gives a lower bound of each distance (its rounding is taken off); only rows that may be among the k
    get their distance, from the differences, so that copies are at 0 and ties are ties."""

    def __init__(self, x: np.ndarray, row: np.ndarray, k: int):
        self.x, self.row, self.k = x, row, k
        self.d, self.j = np.full((len(x), k), np.inf), np.full((len(x), k), np.iinfo(np.int64).max)
        self.limit = self.d[:, -1].copy()  # no farther row is among the k
        self.found: list[tuple] = []

    def _bounds(self, pick, y: np.ndarray, kind):
        """Lower bounds of distances (in a monotone form), and what makes that form of the picked rows' limits."""
        x = self.x[pick]
        c = x.mean(0)
        x, y = x - c, y - c
        scale = max(np.abs(x).max(), np.abs(y).max()) or 1.0
        x, y = x / scale, y / scale
        xx, yy = (x * x).sum(1), (y * y).sum(1)
        e = 4 * (x.shape[1] + 8) * float(np.finfo(kind).eps)
        left = np.column_stack([-2 * x, np.ones(len(x)), -2 * e * np.sqrt(xx)]).astype(kind)
        right = np.column_stack([y, yy * (1 - e), np.sqrt(yy)]).astype(kind)
        return left @ right.T, lambda limit: ((limit / scale) ** 2 * (1 + e) - xx * (1 - e) + 1e3 * float(np.finfo(kind).tiny)).astype(kind)[:, None]

    def _distance(self, i: np.ndarray, y: np.ndarray, yrow: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Of the pairs (i, c); infinite from a row to itself."""
        out = np.empty(len(i))
        for lo in range(0, len(i), 1 << 15):
            a, b = i[lo : lo + (1 << 15)], c[lo : lo + (1 << 15)]
            out[lo : lo + (1 << 15)] = np.sqrt(np.cumsum((self.x[a] - y[b]) ** 2, axis=1)[:, -1])  # added in order, as SQL does
        return np.where(self.row[i] == yrow[c], np.inf, out)

    def add(self, y: np.ndarray, yrow: np.ndarray) -> None:
        if np.isinf(self.limit).any():
            i = c = np.empty(0, np.int64)
            many = np.arange(len(self.x))
        else:
            bound, form = self._bounds(slice(None), y, np.float32)
            i, c = np.divmod(np.flatnonzero(bound <= form(self.limit)), len(y))
            over = np.bincount(i, minlength=len(self.x)) > 4 * self.k
            many, i, c = np.flatnonzero(over), i[~over[i]], c[~over[i]]
        for lo in range(0, len(many), 256):  # a limit from the rows that seem nearest, and bounds in double precision
            part = many[lo : lo + 256]
            bound, form = self._bounds(part, y, np.float64)
            m = min(self.k + 1, len(y))
            seem = np.argpartition(bound, m - 1, axis=1)[:, :m]
            d = np.sort(self._distance(np.repeat(part, m), y, yrow, seem.ravel()).reshape(seem.shape), axis=1)
            if m >= self.k:
                self.limit[part] = np.minimum(self.limit[part], d[:, self.k - 1])
            at, other = np.divmod(np.flatnonzero(bound <= form(self.limit[part])), len(y))
            i, c = np.concatenate([i, part[at]]), np.concatenate([c, other])
        d = self._distance(i, y, yrow, c)
        keep = (d <= self.limit[i]) & (d < np.inf)
        self.found.append((i[keep], d[keep], yrow[c[keep]]))
        if sum(len(f[0]) for f in self.found) > len(self.x) * self.k // 2:
            self._settle()

    def _settle(self) -> None:
        if not self.found:
            return
        i, d, j = (np.concatenate(x) for x in zip(*self.found))
        self.found = []
        u = np.unique(i)
        i, d, j = np.concatenate([i, np.repeat(u, self.k)]), np.concatenate([d, self.d[u].ravel()]), np.concatenate([j, self.j[u].ravel()])
        order = np.lexsort((j, d, i))
        i, d, j = i[order], d[order], j[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        keep = place < self.k
        self.d[i[keep], place[keep]], self.j[i[keep], place[keep]] = d[keep], j[keep]
        self.limit = np.minimum(self.limit, self.d[:, -1])

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        """Distances and row numbers, nearest first; infinite where there are fewer than k."""
        self._settle()
        return self.d, self.j


def _pack(batches):
    """Rows (_row, _v) of a partition into blocks: row numbers and vectors, as bytes."""
    if batches := [b for b in batches if len(b)]:
        table = pa.Table.from_batches(batches)
        size = -(-len(table) // -(-len(table) // WIDE_BLOCK))
        for lo in range(0, len(table), size):
            part = table.slice(lo, size)
            row, v = part["_row"].to_numpy(), pa.concat_arrays(part["_v"].chunks)
            if len(np.unique(v.value_lengths().to_numpy())) > 1:
                raise ValueError("vectors differ in length")
            yield pa.RecordBatch.from_arrays([pa.array([row.tobytes()], pa.binary()), pa.array([v.flatten().to_numpy().tobytes()], pa.binary())], names=["rows", "vecs"])


def _search(k: int, kind):
    def block(batch, i, at):
        row = np.frombuffer(batch.column(at)[i].as_buffer(), np.int64)
        return np.frombuffer(batch.column(at + 1)[i].as_buffer(), kind).reshape(len(row), -1).astype(np.float64), row

    def run(batches):
        held: dict[int, _Nearest] = {}
        for batch in batches:
            for i in range(len(batch)):
                x, row = block(batch, i, 0)
                if row[0] not in held:  # a partition holds a block, or a few
                    held[row[0]] = _Nearest(x, row.copy(), k)
                held[row[0]].add(*block(batch, i, 2))
        for q in held.values():
            d, j = q.result()
            ok = np.isfinite(d)
            at = pa.array(np.concatenate([[0], np.cumsum(ok.sum(1))]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(at, pa.array(v[ok])) for v in (d, j)]
            yield pa.RecordBatch.from_arrays([pa.array(q.row), *lists], names=["_row", "d", "j"])

    return run


def _lof_all(df: DataFrame, id_col: str, vec: str, k: int) -> DataFrame:
    """Every block of rows against every other, a task for each block and stripe of ``STRIPE`` bytes of blocks; neighbours,
    reach distances and densities are then joined by row number.

    Row numbers follow the ids, so ties go to the smaller id. Of equal vectors the first k + 1 are enough as neighbours; a later
    one has k neighbours at distance 0, all with the same density, and so the factor 1."""
    whole = F.forall(vec, lambda x: F.abs(x) < float("inf"))
    kind = "array<float>" if df.schema[vec].dataType.simpleString() == "array<float>" else "array<double>"
    dealt = df.select(id_col, F.when(whole, F.col(vec).cast(kind)).alias("_v"))
    dealt = dealt.repartitionByRange(-(-df.count() // WIDE_BLOCK) or 1, F.col(id_col), F.xxhash64("_v"))  # also where an id repeats
    rows = cut(dealt.sortWithinPartitions(id_col).withColumn("_row", F.monotonically_increasing_id()))
    held = rows.where(F.col("_v").isNotNull())
    n = held.count()
    kk = min(k, max(2, n - 1), n - 1)
    if kk < 1:
        return rows.select(id_col, F.when(F.col("_v").isNotNull(), 1.0).alias("lof"))
    first = held.select("_row", "_v")
    copies = held.groupBy(F.xxhash64("_v")).count().agg(F.sum(F.greatest(F.col("count") - (kk + 1), F.lit(0)))).first()[0]
    if copies:
        copy = F.row_number().over(Window.partitionBy("_v").orderBy("_row"))
        first = first.withColumn("_copy", copy).where(F.col("_copy") <= kk + 1).drop("_copy").repartition(-(-(n - copies) // WIDE_BLOCK))
    blocks = cut(first.mapInArrow(_pack, "rows binary, vecs binary"))
    stripes = -(-blocks.agg(F.sum(F.length("vecs"))).first()[0] // STRIPE)
    pairs = blocks.select(F.col("rows").alias("_r"), F.col("vecs").alias("_x")).crossJoin(blocks.coalesce(stripes).hint("shuffle_replicate_nl"))
    near = pairs.mapInArrow(_search(kk, np.float32 if kind == "array<float>" else np.float64), "_row long, d array<double>, j array<long>")
    if stripes > 1:
        found = F.slice(F.array_sort(F.flatten(F.collect_list(F.arrays_zip("d", "j")))), 1, kk)
        near = near.groupBy("_row").agg(found.alias("_near")).select("_row", F.col("_near.d").alias("d"), F.col("_near.j").alias("j"))
    name = "spark.sql.execution.arrow.maxBytesPerBatch"  # a row is a pair of blocks
    conf = df.sparkSession.conf
    before = conf.get(name, None)
    conf.set(name, "4m")
    try:
        near = cut(near)
    finally:
        conf.unset(name) if before is None else conf.set(name, before)
    edges = near.select("_row", F.inline(F.arrays_zip("d", "j")))
    reach = near.select(F.col("_row").alias("j"), F.element_at("d", -1).alias("_kd"))
    dense = cut(edges.join(reach, "j").groupBy("_row").agg((1 / (F.avg(F.greatest("d", "_kd")) + 1e-10)).alias("_lrd")))
    around = edges.join(dense.select(F.col("_row").alias("j"), F.col("_lrd").alias("_lj")), "j").groupBy("_row").agg(F.avg("_lj").alias("_around"))
    out = around.join(dense, "_row").select("_row", (F.col("_around") / F.col("_lrd")).alias("lof"))
    known = rows.select(id_col, "_row", F.col("_v").isNotNull().alias("_known"))
    return known.join(out, "_row", "left").select(id_col, F.when(F.col("_known"), F.coalesce("lof", F.lit(1.0))).alias("lof"))


def lof(df: DataFrame, keys: list[str], id_col: str, vec: str = "embedding", k: int = 20) -> DataFrame:
    """(id, lof): local outlier factor, Euclidean, k = min(k, max(2, n - 1)), ties to the smaller id; without keys, over all rows of
    any number (a vector that is null or not finite has a null factor and is no neighbour), with keys within groups of at most MAX_GROUP."""
    if not keys:
        return _lof_all(df, id_col, vec, k)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(id_col, kind="stable").reset_index(drop=True)
        x = np.stack(pdf[vec].to_numpy()).astype(np.float64)
        n = len(x)
        kk = min(k, max(2, n - 1), n - 1)
        if kk < 1:
            return pd.DataFrame({id_col: pdf[id_col], "lof": np.ones(n)})
        at = np.arange(n)
        first = np.flatnonzero(pd.Series([v.tobytes() for v in x]).pipe(lambda s: s.groupby(s).cumcount()).to_numpy() <= kk)
        near, dist = np.empty((n, kk), np.int64), np.empty((n, kk))
        for lo in range(0, n, BLOCK):
            q = _Nearest(x[lo : lo + BLOCK], at[lo : lo + BLOCK], kk)
            for other in range(0, len(first), BLOCK):
                q.add(x[first[other : other + BLOCK]], first[other : other + BLOCK])
            dist[lo : lo + BLOCK], near[lo : lo + BLOCK] = q.result()
        reach = np.maximum(dist, dist[near, -1])
        lrd = 1 / (reach.mean(1) + 1e-10)
        return pd.DataFrame({id_col: pdf[id_col], "lof": lrd[near].mean(1) / lrd})

    return _grouped(df, keys, [id_col, vec], run, [df.schema[id_col], T.StructField("lof", T.DoubleType())])


def isolation_forest(df: DataFrame, id_col: str, vec: str = "embedding", trees: int = 100, sample: int = 256, seed: int = 0) -> DataFrame:
    """(id, score): isolation forest; trees are grown on a sample of trees x sample rows at most, all rows are scored in parallel."""
    drawn = df.select(vec, F.xxhash64(F.col(id_col), F.lit(seed)).alias("_h")).orderBy("_h").limit(trees * sample).toPandas()
    x = np.stack(drawn[vec].to_numpy()).astype(np.float64) if len(drawn) else np.zeros((0, 1))
    rng = np.random.default_rng(seed)
    size = min(sample, len(x))
    limit = int(np.ceil(np.log2(max(size, 2))))

    def usual(n):
        return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def grow(rows, depth):
        if depth >= limit or len(rows) < 2:
            return depth + usual(len(rows))
        j = int(rng.integers(x.shape[1]))
        lo, hi = x[rows, j].min(), x[rows, j].max()
        if lo == hi:
            return depth + usual(len(rows))
        c = float(rng.uniform(lo, hi))
        left = x[rows, j] < c
        return (j, c, grow(rows[left], depth + 1), grow(rows[~left], depth + 1))

    forest = [grow(rng.choice(len(x), size, replace=False), 0) for _ in range(trees)] if size else []
    scale = max(usual(size), 1e-12)

    def depth_of(tree, v, rows, out):
        if not isinstance(tree, tuple):
            out[rows] += tree
            return
        j, c, a, b = tree
        left = v[rows, j] < c
        depth_of(a, v, rows[left], out)
        depth_of(b, v, rows[~left], out)

    def run(batches):
        for pdf in batches:
            total = np.zeros(len(pdf))
            if len(pdf) and forest:
                v = np.stack(pdf[vec].to_numpy()).astype(np.float64)
                for tree in forest:
                    depth_of(tree, v, np.arange(len(v)), total)
            yield pd.DataFrame({id_col: pdf[id_col], "score": 2.0 ** (-total / max(len(forest), 1) / scale)})

    return df.select(id_col, vec).mapInPandas(run, T.StructType([df.schema[id_col], T.StructField("score", T.DoubleType())]))
