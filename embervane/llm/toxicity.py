"""Toxicity: a linear-chain conditional random field over words.

Labelled tokens.  Labels exist for documents only.  From a bounded sample of
labelled rows (``MAX_TRAIN_DOCS``, those with the smallest hash of their id) come
the features, words and word beginnings, that mark toxic documents (smoothed
share of toxic among the documents that hold them at least ``MIN_SHARE``, in at
least ``MIN_TOXIC_DOCS`` toxic ones).  A token of a toxic document with such a
feature is labelled toxic, every other token isn't.

The field.  Two states, fitted by gradient ascent on the exact log-likelihood
(expected counts by forward-backward) of token segments of the sample: a weight
for each feature, a bias and a transition matrix.

Scoring.  Every word of every whole text is looked up.  Words without a feature
all have the same potentials, so a run of g of them is the g-th power of one
2 x 2 matrix, and forward-backward over a document takes steps only where a
feature is.  The marginals of those tokens aggregate to a document's score by a
logistic curve (fitted on the sample too) of their noisy-or and their sum; tokens
whose marginal is at least one half are the offending spans, in code points.

Labels are learned only from rows that ``train_rows`` lets pass.  Label, language,
source and id are no inputs of a score.  No shuffle of texts: the sample reaches
the documents by a broadcast join that its bound makes small.

Defined results: a null or empty text, or one without any feature, has the score
of no marginals; without any labelled row (or no toxic one) every score is 0.
Repeated rows stay repeated; other columns are dropped unless named in ``keep``;
an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel
from .common import bound_batches, read, small, staged, unstage

MAX_TRAIN_DOCS = 20_000
MAX_FEATURES = 20_000
MIN_TOXIC_DOCS, MIN_SHARE = 4, 0.75
PREFIXES = (4, 6)
SEGMENT, SEGMENTS_A_DOC = 21, 8
FLAG_AT = 0.3

#: Bytes that end a word here: all of ASCII that are no letters.
_PUNCT = np.ones(256, bool)
_PUNCT[128:] = False
_PUNCT[65:91] = False
_PUNCT[97:123] = False


class Tokens:
    """Words (letters and non-ASCII bytes, ASCII case folded) of some rows with their feature hashes."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        n, off = len(raw), offsets - offsets[0]
        self.rows = off  # where each row's bytes start
        word = ~_PUNCT[raw]
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        full = off[1:] > off[:-1]
        first[off[:-1][full]] = word[off[:-1][full]]
        last[off[1:][full] - 1] = word[off[1:][full] - 1]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, off)
        up, down = textkernel.powers(textkernel._BASE, n + 1)
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum(textkernel._BYTE_LOWER[raw] * up[:n], out=total[1:])
        self.features = []  # one array for the word, one for each beginning
        size = self.ends - self.starts
        for kind, limit in enumerate((1 << 30, *PREFIXES)):
            end = np.minimum(self.ends, self.starts + limit)
            h = (total[end] - total[self.starts]) * down[self.starts] + np.uint64(kind + 1)
            h = textkernel.mix(h + np.minimum(size, limit).astype(np.uint64) * np.uint64(8))
            self.features.append(h)


def _tokens(col: pa.Array) -> Iterator[tuple[int, int, Tokens, np.ndarray]]:
    raw, offsets = textkernel.text_buffers(col)
    for lo, hi in textkernel.chunks(offsets):
        piece = raw[offsets[lo] : offsets[hi]]
        yield lo, hi, Tokens(piece, offsets[lo : hi + 1]), piece


def train_rows(labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """(doc_id, toxic) of at most MAX_TRAIN_DOCS ids outside the held-out quarter; an id labelled twice is toxic if either label is."""
    ok = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
    one = ok.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRAIN_DOCS)


def held_out(id_col):
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _toxic_features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, text) -> (feature, number of toxic documents of the batch that have it)."""
    for batch in small(batches, 1):
        toxic = np.array(batch.column(0).to_pylist(), bool)
        seen = []
        for lo, hi, t, _ in _tokens(batch.column(1)):
            b = t.bounds.tolist()
            for r in np.flatnonzero(toxic[lo:hi]).tolist():
                seen.append(np.unique(np.concatenate([f[b[r] : b[r + 1]] for f in t.features])))
        if seen:
            f, n = np.unique(np.concatenate(seen), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(f.view(np.int64)), pa.array(n.astype(np.int64))], ["feature", "n"])


def _clean_counts(wanted: np.ndarray):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(toxic, text) -> (feature, number of clean documents of the batch that have it), for ``wanted`` alone."""
        lexicon = Lexicon(wanted)
        for batch in small(batches, 1):
            toxic = np.array(batch.column(0).to_pylist(), bool)
            seen = []
            for lo, hi, t, _ in _tokens(batch.column(1)):
                doc = np.repeat(np.arange(lo, hi), np.diff(t.bounds))
                for f in t.features:
                    at, k = lexicon.find(f)
                    seen.append(np.unique(doc[at] * len(wanted) + k))
            pairs = np.unique(np.concatenate([*seen, np.zeros(0, np.int64)]))
            pairs = pairs[~toxic[pairs // len(wanted)]]
            k, n = np.unique(pairs % len(wanted), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int64)), pa.array(n.astype(np.int64))], ["k", "n"])

    return run


class Lexicon:
    """Sorted feature hashes, found behind a table of their first 16 bits."""

    def __init__(self, sorted_hashes: np.ndarray):
        self.hashes = sorted_hashes
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(sorted_hashes >> np.uint64(48)).astype(np.int64)] = True

    def find(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, lexicon index) of what is in the lexicon."""
        if not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.maybe[(features >> np.uint64(48)).astype(np.int64)])
        f = features[at]
        k = np.minimum(np.searchsorted(self.hashes, f), len(self.hashes) - 1)
        ok = self.hashes[k] == f
        return at[ok], k[ok]


def _segments(lexicon_hashes: np.ndarray):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(toxic, text) -> (toxic, SEGMENT x kinds feature indexes, -1 where there is none, -2 beyond the end)."""
        lexicon, kinds = Lexicon(lexicon_hashes), 1 + len(PREFIXES)
        for batch in small(batches, 1):
            toxic = batch.column(0).to_pylist()
            out, flags = [], []
            for lo, hi, t, _ in _tokens(batch.column(1)):
                ids = np.full((len(t.starts), kinds), -1, np.int32)
                for kind, f in enumerate(t.features):
                    at, k = lexicon.find(f)
                    ids[at, kind] = k
                b = t.bounds.tolist()
                for r in range(hi - lo):
                    own = ids[b[r] : b[r + 1]]
                    hits = np.flatnonzero((own >= 0).any(1))
                    step = max(1, len(hits) // SEGMENTS_A_DOC)
                    for c in [*hits[::step].tolist()[:SEGMENTS_A_DOC], len(own) // 2]:
                        seg = np.full((SEGMENT, kinds), -2, np.int32)
                        x = max(0, c - SEGMENT // 2)
                        part = own[x : x + SEGMENT]
                        seg[: len(part)] = part
                        out.append(seg.ravel())
                        flags.append(bool(toxic[lo + r]))
            if out:
                flat = pa.array(np.concatenate(out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(flags), pa.FixedSizeListArray.from_arrays(flat, SEGMENT * kinds).cast(pa.list_(pa.int32()))], ["toxic", "ids"]
                )

    return run


class Field:
    """The fitted field: feature weights, bias, transitions, and the curve from marginals to a score."""

    def __init__(self, lexicon: np.ndarray, weights: np.ndarray, bias: float, transitions: np.ndarray, curve=(-6.0, 1.0, 0.0)):
        self.lexicon, self.weights, self.bias, self.transitions, self.curve = lexicon, weights, bias, transitions, curve
        self._powers: dict[int, np.ndarray] = {}

    def __getstate__(self):
        return self.__dict__ | {"_powers": {}, "_find": None}

    def finder(self) -> Lexicon:
        if self.__dict__.get("_find") is None:
            self._find = Lexicon(self.lexicon)
        return self._find

    def _run(self, g: int) -> np.ndarray:
        """The matrix of g words without features, scaled to a largest entry of 1."""
        m = self._powers.get(g)
        if m is None:
            if g == 0:
                m = np.eye(2)
            elif g == 1:
                m = np.exp(self.transitions) * np.array([1.0, np.exp(self.bias)])
            else:
                half = self._run(g // 2)
                m = half @ half
                m = m @ self._run(1) if g % 2 else m
            m = m / m.max()
            if len(self._powers) < 100_000:
                self._powers[g] = m
        return m

    def marginals(self, positions: np.ndarray, scores: np.ndarray, n: int) -> np.ndarray:
        """P(toxic) of the tokens at ``positions`` (with summed weights ``scores``) of a document of n words."""
        m = len(positions)
        step = np.exp(self.transitions)
        gaps = np.diff(np.concatenate([[-1], positions, [n]])) - 1
        odds = np.exp(np.minimum(self.bias + scores, 50.0))
        forward = np.empty((m, 2))
        a = np.array([1.0, 0.0])  # before the first word: not toxic
        for i in range(m):
            a = (a @ self._run(int(gaps[i]))) @ step * np.array([1.0, odds[i]])
            a /= a.sum()
            forward[i] = a
        back = self._run(int(gaps[m])) @ np.ones(2)
        out = np.empty(m)
        for i in range(m - 1, -1, -1):
            both = forward[i] * back
            out[i] = both[1] / both.sum()
            back = self._run(int(gaps[i])) @ (step @ (np.array([1.0, odds[i]]) * back))
            back /= back.sum()
        return out

    def score(self, marginals: np.ndarray) -> float:
        x = _evidence(marginals)
        z = self.curve[0] + self.curve[1] * x[0] + self.curve[2] * x[1]
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def _evidence(marginals: np.ndarray) -> tuple[float, float]:
    """The noisy-or of the marginals as log-odds, and the logarithm of their sum."""
    if not len(marginals):
        return -10.0, 0.0
    none = float(np.log1p(-np.clip(marginals, 0, 1 - 1e-9)).sum())
    some = -np.expm1(none)
    return float(np.clip(np.log(max(some, 1e-9)) - none, -10, 10)), float(np.log1p(marginals.sum()))


def fit_field(ids: np.ndarray, labels: np.ndarray, n_features: int, steps: int = 120, rate: float = 0.3, ridge: float = 1e-3):
    """Weights, bias and transitions for segments ``ids`` (N, L, kinds) with token labels (N, L): exact gradient, Adam."""
    n, length, kinds = ids.shape
    real = ids[:, :, 0] > -2
    w, tr = np.zeros(n_features + 1), np.zeros((2, 2))  # the last weight is the bias
    slot = np.where(ids < 0, n_features + 1, ids)  # a slot of its own that stays 0
    theta = np.concatenate([w, tr.ravel()])
    theta[n_features] = -2.0
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    prev = np.concatenate([np.zeros((n, 1), labels.dtype), labels[:, :-1]], 1)
    held = np.zeros((2, 2))
    np.add.at(held, (prev[real], labels[real]), 1)
    gold = np.bincount(slot[(labels == 1) & real].ravel(), minlength=n_features + 2)[:n_features].astype(float)
    gold_bias = float(labels[real].sum())
    for it in range(1, steps + 1):
        w, tr = np.append(theta[: n_features + 1], 0.0), theta[n_features + 1 :].reshape(2, 2)
        odds = np.where(real, np.exp(np.clip(w[n_features] + np.append(w[:n_features], [0.0, 0.0])[slot].sum(2), -30, 30)), 1.0)
        a = np.exp(tr)
        forward, back = np.empty((length, n, 2)), np.empty((length, n, 2))
        f = np.tile([1.0, 0.0], (n, 1))
        for t in range(length):
            g = (f @ a) * np.stack([np.ones(n), odds[:, t]], 1)
            g /= g.sum(1, keepdims=True)
            f = np.where(real[:, t, None], g, f)
            forward[t] = f
        bk = np.ones((n, 2))
        expected, marginal = np.zeros((2, 2)), np.zeros((n, length))
        for t in range(length - 1, -1, -1):
            back[t] = bk
            before = forward[t - 1] if t else np.tile([1.0, 0.0], (n, 1))
            right = np.stack([np.ones(n), odds[:, t]], 1) * bk
            pair = before[:, :, None] * a[None] * right[:, None, :]
            pair /= pair.sum((1, 2), keepdims=True)
            pair *= real[:, t, None, None]
            expected += pair.sum(0)
            marginal[:, t] = pair[:, :, 1].sum(1)
            nb = right @ a.T
            nb /= nb.sum(1, keepdims=True)
            bk = np.where(real[:, t, None], nb, bk)
        want = np.bincount(slot.ravel(), np.repeat(marginal.ravel(), kinds), minlength=n_features + 2)[:n_features]
        grad = np.concatenate([gold - want, [gold_bias - marginal.sum()], (held - expected).ravel()]) / n - ridge * theta
        m1 = 0.9 * m1 + 0.1 * grad
        m2 = 0.99 * m2 + 0.01 * grad * grad
        theta = theta + rate * (m1 / (1 - 0.9**it)) / (np.sqrt(m2 / (1 - 0.99**it)) + 1e-8)
    return theta[:n_features], float(theta[n_features]), theta[n_features + 1 :].reshape(2, 2)


def _fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression of y on two kinds of evidence, by Newton steps with a small ridge."""
    x = np.concatenate([np.ones((len(x), 1)), x], 1)
    beta = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(3)
        beta = beta + np.linalg.solve(h, x.T @ (y - p) - 1e-2 * beta)
    return tuple(float(b) for b in beta)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """A field fitted on the bounded sample; of each pass only counts, or the sample's segments, come to the driver."""
    bound_batches(docs.sparkSession)
    sample = train_rows(labels, id_col)
    rows = docs.join(F.broadcast(sample), docs[id_col].cast("long") == sample["doc_id"]).select(sample["toxic"], docs[text_col].alias("text"))
    rows = staged(rows, "sample")  # the corpus is read once; each pass below reads the sample alone
    try:
        return _fitted(rows)
    finally:
        unstage(rows)


def _fitted(rows: DataFrame) -> Field:
    counted = rows.where("toxic = 1").mapInArrow(_toxic_features, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    top = counted.where(F.col("n") >= MIN_TOXIC_DOCS).orderBy(F.desc("n"), "feature").limit(20 * MAX_FEATURES).toPandas()
    found = top["feature"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(found)
    found, n_toxic = found[order], top["n"].to_numpy(np.float64)[order]
    nothing = Field(np.zeros(0, np.uint64), np.zeros(0), 0.0, np.zeros((2, 2)), (-50.0, 0.0, 0.0))
    if not len(found):
        return nothing
    clean = rows.mapInArrow(_clean_counts(found), "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    n_clean = np.zeros(len(found))
    n_clean[clean["k"].to_numpy(np.int64)] = clean["n"].to_numpy(np.float64)
    share = n_toxic / (n_toxic + n_clean + 1)
    keep = np.flatnonzero(share >= MIN_SHARE)
    keep = np.sort(keep[np.argsort(-n_toxic[keep], kind="stable")][:MAX_FEATURES])
    if not len(keep):
        return nothing
    lexicon = found[keep]
    seg = rows.mapInArrow(_segments(lexicon), "toxic boolean, ids array<int>").toPandas()
    ids = np.stack(seg["ids"].to_numpy()).reshape(len(seg), SEGMENT, -1)
    token = (ids >= 0).any(2) & seg["toxic"].to_numpy(bool)[:, None]
    weights, bias, transitions = fit_field(ids, token.astype(np.int64), len(lexicon))
    field = Field(lexicon, weights, bias, transitions)
    scored = rows.mapInArrow(_evidence_of(field), "toxic int, odds double, total double").toPandas()
    field.curve = _fit_curve(scored[["odds", "total"]].to_numpy(np.float64), scored["toxic"].to_numpy(np.float64))
    return field


def _document_marginals(field: Field, col: pa.Array) -> Iterator[tuple[int, Tokens, np.ndarray, np.ndarray, np.ndarray]]:
    """(row of the piece, the piece's tokens and bytes, positions of tokens with a feature, their marginals)."""
    lexicon = field.finder()
    for lo, hi, t, piece in _tokens(col):
        score, hit = np.zeros(len(t.starts)), np.zeros(len(t.starts), bool)
        for f in t.features:
            at, k = lexicon.find(f)
            score[at] += field.weights[k]
            hit[at] = True
        where = np.flatnonzero(hit)
        cut_at = np.searchsorted(where, t.bounds).tolist()
        b = t.bounds.tolist()
        for r in range(hi - lo):
            own = where[cut_at[r] : cut_at[r + 1]]
            p = field.marginals(own - b[r], score[own], b[r + 1] - b[r]) if len(own) else np.zeros(0)
            yield r, t, piece, own, p


def _evidence_of(field: Field):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 1):
            e = [_evidence(p) for *_, p in _document_marginals(field, batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int32()), pa.array([x[0] for x in e], pa.float64()), pa.array([x[1] for x in e], pa.float64())], ["toxic", "odds", "total"]
            )

    return run


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("marginal", T.DoubleType())]))


def score_documents(docs: DataFrame, field: Field, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep..., score, toxic_spans (code points, end exclusive) of every row."""
    bound_batches(docs.sparkSession)
    kept = [docs.schema[c] for c in keep]
    # A text that is kept is the one that is scored: no row carries its text twice.
    text_at = keep.index(text_col) if text_col in keep else len(keep)
    rows = docs.select(*keep, *([] if text_col in keep else [F.col(text_col).alias("_text")]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))
        for batch in small(batches, text_at):
            scores, spans = [], []
            last, points = None, None
            for r, t, piece, own, p in _document_marginals(field, batch.column(text_at)):
                scores.append(field.score(p))
                bad = np.flatnonzero(p >= 0.5)
                if not len(bad):
                    spans.append([])
                    continue
                if t is not last:
                    points = np.concatenate([[0], np.cumsum((piece & 0xC0) != 0x80)])
                    last = t
                base = points[t.rows[r]]
                spans.append(
                    [{"start": int(points[t.starts[k]] - base), "end": int(points[t.ends[k]] - base), "marginal": float(p[i])} for i, k in zip(bad.tolist(), own[bad].tolist())]
                )
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(len(kept))], pa.array(scores, pa.float64()), pa.array(spans, span)], [*keep, "score", "toxic_spans"]
            )

    return rows.mapInArrow(run, T.StructType([*kept, T.StructField("score", T.DoubleType()), T.StructField("toxic_spans", SPANS)]))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    field = train(docs, read(spark, sf_dir, "labels"))
    return score_documents(docs, field).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= FLAG_AT).cast("int").alias("predicted"),
        F.size("toxic_spans").alias("n_spans"),
    )
