"""Vectorised kernels over the UTF-8 bytes of whole text columns.

A text column arrives as an Arrow string array.  The kernels work on slices of
about ``CHUNK`` bytes (a longer single text is a slice of its own), so memory
stays bounded by the slice and by the longest text, never by the partition.

Words are maximal runs of bytes outside ``0x20, 0x09-0x0D``.  A word's hash is
a polynomial over odd 64-bit byte codes, made from prefix sums, so hashes of
words and of word prefixes cost a few passes over the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20

_rng = np.random.default_rng(20240229)
_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 2**64)
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_pow: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow[0]) < n:
        for k, base in enumerate((_P, _PINV)):
            table = np.full(n + CHUNK, base, np.uint64)
            table[0] = 1
            _pow[k] = np.multiply.accumulate(table)
    return _pow[0], _pow[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Slice:
    """Rows lo..hi of a batch: their bytes joined, row offsets into them."""

    def __init__(self, lo: int, hi: int, raw: np.ndarray, offs: np.ndarray):
        self.lo, self.hi, self.raw, self.offs = lo, hi, raw, offs


def slices(texts: pa.Array, chunk: int = CHUNK) -> Iterator[Slice]:
    """Cut a string array (null: empty text) into slices of about `chunk` bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    n = len(texts)
    if n == 0:
        return
    bufs = texts.buffers()
    offs = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + chunk, "right")) - 1)
        hi = min(hi, n)
        yield Slice(lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        lo = hi


class Words:
    """Words of a slice: byte starts and ends, owning row, hashes."""

    def __init__(self, s: Slice, lower: bool = True, table: np.ndarray | None = None):
        """`table` marks the bytes that end words (white space if not given)."""
        self.s = s
        b = LOWER[s.raw] if lower else s.raw
        self.bytes = b
        n = len(b)
        inside = ~(SPACE if table is None else table)[b]
        first = np.zeros(n + 1, bool)
        first[s.offs[:-1]] = True
        prev = np.zeros(n, bool)
        prev[1:] = inside[:-1]
        begin = inside & (~prev | first[:-1])
        self.start = np.flatnonzero(begin)
        nxt = np.zeros(n, bool)
        nxt[:-1] = inside[1:]
        first[n] = True
        self.end = np.flatnonzero(inside & (~nxt | first[1:])) + 1
        self.row = np.searchsorted(s.offs, self.start, "right") - 1
        rows = s.hi - s.lo
        # empty rows share an offset: searchsorted right picks the last row that begins there
        self.count = np.bincount(self.row, minlength=rows).astype(np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.count)))
        up, self._down = _powers(n + 1)
        self._sum = np.zeros(n + 1, np.uint64)
        np.cumsum(_CODE[b] * up[:n], out=self._sum[1:])

    def hash(self) -> np.ndarray:
        return mix((self._sum[self.end] - self._sum[self.start]) * self._down[self.start])

    def prefix_hash(self, k: int) -> np.ndarray:
        """Hash of the first k bytes; whole words of up to k bytes hash to 0."""
        ok = self.end - self.start > k
        stop = np.where(ok, self.start + k, self.start)
        h = mix((self._sum[stop] - self._sum[self.start]) * self._down[self.start] + np.uint64(k))
        return np.where(ok, h, np.uint64(0))


def shingles(h: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k-word windows for rows cut at `first`; a row with 1..k-1 words has one, of all its words.

    Returns (hashes, offsets by row); hashes are not made distinct.
    """
    count = np.diff(first)
    n = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    offs = np.concatenate(([0], np.cumsum(n)))
    row = np.repeat(np.arange(len(count)), n)
    at = first[:-1][row] + (np.arange(offs[-1]) - offs[:-1][row])
    left = np.minimum(k, count[row] - (at - first[:-1][row]))
    total = np.zeros(len(at), np.uint64)
    mul = np.uint64(1)
    padded = np.concatenate((h, np.zeros(k, np.uint64)))
    for j in range(k):
        mul = np.uint64((int(mul) * 0xD6E8FEB86659FD93) % 2**64)
        total += np.where(left > j, padded[at + j], np.uint64(j + 1)) * mul
    return mix(total + left.astype(np.uint64)), offs


def sorted_sets(values: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort and make distinct the values of each row; returns (values, offsets)."""
    out, size = [], np.zeros(len(offs) - 1, np.int64)
    for i, (a, b) in enumerate(zip(offs[:-1], offs[1:], strict=True)):
        if b > a:
            v = np.sort(values[a:b])
            if b > a + 1:
                keep = np.empty(len(v), bool)
                keep[0] = True
                np.not_equal(v[1:], v[:-1], out=keep[1:])
                v = v[keep]
            out.append(v)
            size[i] = len(v)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.concatenate(([0], np.cumsum(size)))


def char_at(raw: np.ndarray) -> np.ndarray:
    """For each byte offset 0..n, the code points that begin before it."""
    return np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))


def run(step: np.ndarray, cls: np.ndarray, raw: np.ndarray, lane: int = 512) -> np.ndarray:
    """States of an automaton after each byte of `raw`, in parallel lanes.

    step[state, class] is the next state, 0 the start.  Lanes guess that they
    begin in state 0; those that don't are run again until nothing changes,
    so the states are those of one pass from left to right.
    """
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.int32)
    k = step.shape[1]
    flat = (step.astype(np.int32) * k).ravel()  # rows premultiplied
    w = -(-n // lane)
    c = np.zeros(w * lane, np.int32)
    c[:n] = cls[raw]
    cols = np.ascontiguousarray(c.reshape(w, lane).T)
    out = np.empty((lane, w), np.int32)
    guess = np.zeros(w, np.int32)
    todo = np.arange(w)
    while len(todo):
        st = guess[todo]
        for t in range(lane):
            st = flat[st + (cols[t] if len(todo) == w else cols[t, todo])]
            if len(todo) == w:
                out[t] = st
            else:
                out[t, todo] = st
        nxt = np.concatenate(([0], out[-1, :-1])).astype(np.int32)
        todo = np.flatnonzero(nxt != guess)
        guess = nxt
    return (out.T.ravel()[:n]) // k


def planes(x: np.ndarray) -> bytes:
    """Bytes of an array, compressed place by place."""
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes(), "zstd", asbytes=True)


def unplaned(data: bytes, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(pa.decompress(data, n * size, "zstd"), np.uint8).reshape(size, n)
    return np.ascontiguousarray(raw.T).view(kind).ravel()
