"""Vectorised word hashing over Arrow text columns.

Words are the maximal runs of bytes other than 0x20 and 0x09-0x0D, which equals
``[^\\x20\\x09-\\x0D]+`` on code points because UTF-8 never uses those bytes
inside a longer sequence.  A word's hash is a polynomial over per-byte random
64-bit values modulo 2**64, read off one prefix sum of the whole batch, then
mixed; all arithmetic wraps.  Two different words collide with a probability of
about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = (1 << 18) - 4096  # with the powers table of one more entry, 2**18

_rng = np.random.default_rng(0x5EED)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_MULT = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SEP = np.zeros(256, bool)
_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C15
_ROLL = 0xD1342543DE82EF95

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i in 0..n-1."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        inv = pow(base, -1, 1 << 64)
        out = []
        for b in (base, inv):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers[base] = have = (out[0], out[1])
    return have[0][:n], have[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public splitmix64 constants)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pa.compute.fill_null(col, "") if col.null_count else col
    col = col.cast(pa.large_binary())
    _, off, data = col.buffers()
    n = len(col)
    offsets = np.frombuffer(off, np.int64, n + 1, col.offset * 8) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer row is a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


class Words:
    """The words of some rows: byte bounds, hashes, and the row each starts in."""

    __slots__ = ("starts", "ends", "hashes", "bounds")

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, lower: bool = False, hashes: bool = True):
        n = len(raw)
        off = offsets - offsets[0]
        if not n:
            self.starts = self.ends = np.zeros(0, np.int64)
            self.hashes = np.zeros(0, np.uint64)
            self.bounds = np.zeros(len(off), np.int64)
            return
        word = ~_SEP[raw]
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        full = off[1:] > off[:-1]
        at = off[:-1][full]
        first[at] = word[at]
        at = off[1:][full] - 1
        last[at] = word[at]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, off)
        self.hashes = np.zeros(0, np.uint64)
        if hashes:
            up, down = powers(_BASE, n + 1)
            total = np.empty(n + 1, np.uint64)
            total[0] = 0
            np.cumsum((_BYTE_LOWER if lower else _BYTE)[raw] * up[:n], out=total[1:])
            h = (total[self.ends] - total[self.starts]) * down[self.starts]
            self.hashes = mix(h + (self.ends - self.starts).astype(np.uint64))


def shingles(words: Words, k: int, whole_if_short: bool = True) -> list[np.ndarray]:
    """Each row's distinct k-word shingle hashes, sorted.

    A row with fewer words has the hash of its whole sequence as its one shingle
    (or none, if ``whole_if_short`` is off); a row without words has none.
    """
    h = words.hashes
    m = max(len(h) - k + 1, 0)
    rolled = np.zeros(m, np.uint64)
    for i in range(k):
        rolled += h[i : i + m] * _MULT[i]
    rolled = mix(rolled)
    out = []
    b = words.bounds.tolist()
    for lo, hi in zip(b, b[1:]):
        n = hi - lo
        if n >= k:
            s = np.sort(rolled[lo : hi - k + 1])
            if n > k:
                keep = np.empty(len(s), bool)
                keep[0] = True
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                s = s[keep]
        elif n and whole_if_short:
            s = mix(np.array([(h[lo:hi] * _MULT[:n]).sum(dtype=np.uint64) + np.uint64(n)], np.uint64))
        else:
            s = h[:0]
        out.append(s)
    return out


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Rabin-Karp hash of every k consecutive words, by one prefix sum."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = powers(_ROLL, n + 1)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(hashes * up[:n], out=total[1:])
    return mix((total[k:] - total[: n - k + 1]) * down[: n - k + 1])


def fold(hashes: list[int] | np.ndarray) -> int:
    """One 64-bit digest of a sorted set of hashes."""
    a = np.asarray(hashes, np.uint64)
    if not len(a):
        return 0
    up, _ = powers(_ROLL, len(a))
    return int(mix(np.array([(mix(a) * up).sum(dtype=np.uint64) + np.uint64(len(a))], np.uint64))[0])
