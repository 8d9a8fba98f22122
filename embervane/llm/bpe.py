"""Byte-level BPE by a lazily determinised finite-state transducer.

The merges are compiled from the rank file into two things: a trie of all
tokens, and the relation "token ``b`` may follow token ``a``", which holds when
merging the bytes of ``a + b`` by rank gives back exactly ``(a, b)``.  The
encoding of a piece is the one path of tokens whose neighbours all may follow
each other, and every prefix has exactly one such path.  So a nondeterministic
transducer reads bytes while it guesses where tokens end: its configurations are
the tokens not yet emitted and the bytes of the token being read.

:class:`Transducer` determinises it lazily.  Its state is the set of live token
prefixes, which the longest of them stands for, and with it go the registers of
the live starts: the last token of the one path that ends there.  A transition,
made the first time a byte is read in a state, extends every live prefix by that
byte and drops what has no continuation; it is memoised.  There are no more
states than nodes in the trie.  A token that ends is taken where it may follow
its start's register.  Tokens are emitted when the paths to all live starts agree
on them, so the lookahead is bounded by the longest token; a long piece is
emitted as it is read, every ``EMIT_EVERY`` bytes.

Decoding joins token bytes in slices of ``DECODE_SLICE`` ids and passes them
through :class:`Utf8Stream`, a state machine that keeps an incomplete sequence
at the end of a slice for the next one.

Defined results: a null or empty text has no ids; repeated rows stay repeated;
other columns are dropped; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import bound_batches, read, small

DEFAULT_VOCABULARY = "byte_bpe_multi_50k.tiktoken"
MAX_PAIRS = 400_000
EMIT_EVERY = 2048
MAX_PIECES = 150_000
LONGEST_CACHED_PIECE = 64
DECODE_SLICE = 4096


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Transducer:
    """Tokens out, bytes in; deterministic as far as it has been used."""

    def __init__(self, ranks: dict[bytes, int], max_pairs: int = MAX_PAIRS):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("a byte-level vocabulary has a token for every single byte")
        self.ranks, self.max_pairs = ranks, max_pairs
        nodes = set(ranks)
        for token in ranks:
            for i in range(1, len(token)):
                nodes.add(token[:i])
        self.nodes = nodes  # of the trie of all tokens
        self.bytes_of = {i: t for t, i in ranks.items()}
        self._pairs: dict[int, bool] = {}
        self._split_table()
        # A state stands for all its live prefixes by the longest of them; 0 is the start.
        self.ids: dict[bytes, int] = {}
        self.strings: list[bytes] = []
        self.steps: list[dict[int, int]] = []
        self.ends: list[list[tuple[int, int]]] = []  # (length, token) of what ends here, longest first
        self._intern(b"")

    def _intern(self, longest: bytes) -> int:
        k = self.ids.get(longest)
        if k is None:
            k = self.ids[longest] = len(self.strings)
            self.strings.append(longest)
            self.steps.append({})
            found = ((len(longest) - i, self.ranks.get(longest[i:])) for i in range(len(longest)))
            self.ends.append([(n, t) for n, t in found if t is not None and self._reachable(t)])
        return k

    def _step(self, k: int, byte: int) -> int:
        """The transition that hasn't been taken before: every live prefix grows by the byte, or dies."""
        grown = self.strings[k] + bytes([byte])
        while grown not in self.nodes:
            grown = grown[1:]
        to = self.steps[k][byte] = self._intern(grown)
        return to

    def _split_table(self) -> None:
        """The last merge of every token: the one split whose halves are tokens that may follow each other."""
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        for token, rank in sorted(self.ranks.items(), key=lambda x: x[1]):
            self.halves[rank] = (rank, rank)
            for i in range(1, len(token)):
                left, right = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if left is not None and right is not None and left < rank and right < rank and self._compatible(left, right):
                    self.halves[rank] = (left, right)
                    self.joined[left, right] = rank
                    break

    def _compatible(self, a: int, b: int) -> bool:
        """Whether merging by rank ever joins bytes across the border of ``a`` and ``b``.

        The merges inside both are undone, highest rank first; at each point the
        pair that then meets at the border must not be a merge that would have come
        before the merge just undone.
        """
        joined, halves = self.joined, self.halves
        bound = len(self.ranks) + 256
        while True:
            over = joined.get((a, b))
            if over is not None and over < bound:
                return False
            a_whole, b_whole = halves[a][0] == a, halves[b][0] == b
            if a_whole and b_whole:
                return True
            if not a_whole and (b_whole or a > b):
                bound = a  # on equal ranks the left merge comes first
                a = halves[a][1]
            else:
                bound = b + 1
                b = halves[b][0]

    def merge(self, piece: bytes) -> list[int]:
        """The merges applied by rank, lowest first, leftmost among equals: the definition (for tests)."""
        ranks = self.ranks
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def follows(self, a: int, b: int) -> bool:
        k = a << 20 | b
        ok = self._pairs.get(k)
        if ok is None:
            if len(self._pairs) >= self.max_pairs:
                self._pairs.clear()
            ok = self._pairs[k] = self._compatible(a, b)
        return ok

    def _reachable(self, token: int) -> bool:
        """Whether the merges of a token's own bytes give that token."""
        return self.halves[token][0] != token or len(self.bytes_of[token]) == 1

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:  # a piece that is a token is that token
            return [whole]
        steps, ends, follows = self.steps, self.ends, self.follows
        out: list[int] = []
        k, last, before = 0, [-1], -1  # last[i]: the token that ends the path of the first i bytes (from the last emission)
        for i, byte in enumerate(piece):
            to = steps[k].get(byte)
            k = self._step(k, byte) if to is None else to
            at = len(last)
            for n, token in ends[k]:
                if n <= at:
                    prior = last[at - n] if n < at else before
                    if prior < 0 or follows(prior, token):
                        last.append(token)
                        break
            if len(last) >= EMIT_EVERY:
                done = self._agreed(last, len(self.strings[k]))
                if done:
                    out.extend(self._path(last, done))
                    before = last[done]
                    last = [-1, *last[done + 1 :]]
        out.extend(self._path(last, len(last) - 1))
        return out

    def _path(self, last: list[int], end: int) -> list[int]:
        found = []
        while end > 0:
            found.append(last[end])
            end -= len(self.bytes_of[last[end]])
        return found[::-1]

    def _agreed(self, last: list[int], live: int) -> int:
        """The furthest border that is on the paths to all live starts: no later byte changes what lies before it."""
        n = len(last) - 1
        common = None
        for start in range(max(0, n - live), n + 1):
            on, at = {start}, start
            while at > 0:
                at -= len(self.bytes_of[last[at]])
                on.add(at)
            common = on if common is None else common & on
        return max(common)


class Utf8Stream:
    """Incremental UTF-8: bytes in, text out; an unfinished sequence waits for the next bytes."""

    def __init__(self) -> None:
        self.held = b""

    @staticmethod
    def _unfinished(data: bytes) -> int:
        """How many bytes at the end of ``data`` begin a sequence that they don't finish."""
        for back in range(1, min(3, len(data)) + 1):
            b = data[-back]
            if b < 0x80:
                return 0
            if b >= 0xC0:
                need = 2 if b < 0xE0 else 3 if b < 0xF0 else 4
                return back if back < need else 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.held + data
        n = self._unfinished(data)
        self.held = data[len(data) - n :]
        return data[: len(data) - n].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


class Codec:
    """Whole texts: pieces by the public pattern, each through the transducer."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.transducer = Transducer(ranks)
        self.find = regex.compile(pattern).finditer
        self.findall = regex.compile(pattern).findall
        self.packed: dict[str, bytes] = {}
        size = max(ranks.values()) + 1
        self.token_bytes = [b""] * size
        for t, i in ranks.items():
            self.token_bytes[i] = t

    def _pack(self, piece: str) -> bytes:
        import array

        ids = array.array("I", self.transducer.encode_piece(piece.encode("utf-8", "surrogatepass")))
        packed = ids.tobytes()
        if len(piece) <= LONGEST_CACHED_PIECE:
            if len(self.packed) >= MAX_PIECES:
                self.packed.clear()
            self.packed[piece] = packed
        return packed

    def encode_packed(self, text: str, slice_chars: int = 1 << 16) -> bytes:
        """The ids of ``text`` as little-endian unsigned 32-bit integers."""
        known, pack = self.packed.get, self._pack
        if len(text) <= slice_chars:
            return b"".join([known(p) or pack(p) for p in self.findall(text)])
        out, batch = [], []
        for m in self.find(text):  # pieces of a long text come one after another
            p = m.group()
            batch.append(known(p) or pack(p))
            if len(batch) >= 1 << 14:
                out.append(b"".join(batch))
                batch.clear()
        out.append(b"".join(batch))
        return b"".join(out)

    def decode(self, packed: bytes) -> Iterator[bytes]:
        """The decoded bytes of packed ids, slice by slice."""
        import array

        token = self.token_bytes.__getitem__
        for i in range(0, len(packed), 4 * DECODE_SLICE):
            ids = array.array("I")
            ids.frombytes(packed[i : i + 4 * DECODE_SLICE])
            yield b"".join(map(token, ids))

    def decode_text(self, packed: bytes) -> Iterator[str]:
        stream = Utf8Stream()
        for part in self.decode(packed):
            yield stream.feed(part)
        yield stream.close()


@functools.lru_cache(maxsize=2)
def codec(vocabulary: str, pattern: str | None = None) -> Codec:
    import public_tokenizers

    return Codec(load_ranks(public_tokenizers.path(vocabulary)), pattern or public_tokenizers.PATTERN)


def digest_batches(vocabulary: str) -> callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for batch in small(batches, 1):
            n_tokens, ids, texts, chars = [], [], [], []
            for text in batch.column(1):
                packed = c.encode_packed(text.as_py() or "")
                n_tokens.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                h = hashlib.sha256()
                stream, n = Utf8Stream(), 0
                for part in c.decode(packed):
                    h.update(part)
                    n += len(stream.feed(part))
                texts.append(h.hexdigest())
                chars.append(n + len(stream.close()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_tokens, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string()), pa.array(chars, pa.int64())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "decoded_chars"],
            )

    return run


def encode_frame(docs: DataFrame, text_col: str = "text", out_col: str = "ids", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``docs`` with ``out_col`` array<int>: the ids of each whole text."""
    bound_batches(docs.sparkSession)
    schema = docs.schema
    names = [f.name for f in schema.fields if f.name != out_col]
    at = names.index(text_col)

    def run(batches):
        import array

        import numpy as np

        c = codec(vocabulary)
        for batch in small(batches, at, 1 << 20):
            packed = [c.encode_packed(t.as_py() or "") for t in batch.column(at)]
            sizes = np.cumsum([0] + [len(p) // 4 for p in packed]).astype(np.int32)
            flat = array.array("i")
            flat.frombytes(b"".join(packed))
            ids = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.array(flat, np.int32), pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], [*names, out_col])

    from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

    kept = [f for f in schema.fields if f.name != out_col]
    return docs.select(*names).mapInArrow(run, StructType([*kept, StructField(out_col, ArrayType(IntegerType()))]))


def decode_frame(docs: DataFrame, ids_col: str = "ids", out_col: str = "decoded", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``docs`` with ``out_col`` string: the text that the ids spell (U+FFFD for what is no UTF-8)."""
    bound_batches(docs.sparkSession)
    schema = docs.schema
    names = [f.name for f in schema.fields if f.name != out_col]
    at = names.index(ids_col)

    def run(batches):
        import array

        c = codec(vocabulary)
        for batch in small(batches, at, 1 << 20):
            out = ["".join(c.decode_text(array.array("I", ids.as_py() or []).tobytes())) for ids in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*names, out_col])

    from pyspark.sql.types import StringType, StructField, StructType

    kept = [f for f in schema.fields if f.name != out_col]
    return docs.select(*names).mapInArrow(run, StructType([*kept, StructField(out_col, StringType())]))


def op1_byte_bpe(spark: SparkSession, sf_dir: str, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (of the bytes), decoded_chars (of the stream) of every whole text of ``documents``."""
    bound_batches(spark)
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.mapInArrow(digest_batches(vocabulary), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, decoded_chars long")
