"""Vectorised segmentation and hashing of text columns.

A batch of texts is handled as one byte buffer with offsets, as Arrow stores
it, so words, lines and n-grams of thousands of documents are found and hashed
by a few numpy calls.  Separators are ASCII only (space and \\x09-\\x0D), so
byte-level splitting is exact for UTF-8.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext

U64 = np.uint64
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_BLOCK = 1 << 17

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _random_table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)


_BYTE = _random_table(7)


class _Powers:
    """Powers of an odd base modulo 2**64 and their inverses; grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inv = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            for name, b in (("up", self.base), ("down", self.inv)):
                t = np.full(n, b, dtype=np.uint64)
                t[0] = 1
                np.multiply.accumulate(t, out=t)
                setattr(self, name, t)
        return self.up, self.down


_POWERS = _Powers(_BASE)
_WORD_POWERS = _Powers(0xD1342543DE82EF95)


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (splitmix64)."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


_LIBC = ctypes.CDLL(None)


def release() -> None:
    """Gives memory that is free to the system: workers live on and share a machine with their JVM."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


#: What makes this worker forget a memory, and the stage that used that memory last.
_memories: dict[Callable[[], None], int] = {}


def _stage() -> int:
    task = TaskContext.get()
    return task.stageId() if task else -1


def remembers(forget: Callable[[], None]) -> None:
    """The present stage uses a memory; it lasts until this worker takes texts of a stage that does not."""
    _memories[forget] = _stage()


def pieces(column: pa.Array, limit: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes of text (or one longer row)."""
    for forget in [f for f, stage in _memories.items() if stage != _stage()]:
        del _memories[forget]
        forget()
    _, off = as_bytes(column)
    a, n = 0, len(column)
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)
    release()


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and n + 1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    if not len(column) or where is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and n + 1 offsets of the documents' words."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    inside = ~IS_SPACE[buf]
    first = np.zeros(len(buf), bool)
    first[off[:-1][off[:-1] < len(buf)]] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, off)


def chunks(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As words(), but each span takes the white space before it (and a text's last span what follows)."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    space = IS_SPACE[buf]
    begins = space.copy()
    begins[1:] &= ~space[:-1]
    begins[off[:-1][off[:-1] < len(buf)]] = True
    starts = np.flatnonzero(begins)
    return starts, np.append(starts[1:], len(buf)), np.searchsorted(starts, off)


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every span's bytes; spans ascend and do not overlap."""
    out = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        lo = int(starts[a])
        b = max(a + 1, int(np.searchsorted(ends, lo + _BLOCK, side="right")))
        hi = int(ends[b - 1])
        up, down = _POWERS.to(hi - lo + 1)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_BYTE[buf[lo:hi]] * up[: hi - lo], out=total[1:])
        s, e = starts[a:b] - lo, ends[a:b] - lo
        h = (total[e] - total[s]) * down[s]
        out[a:b] = mix64(h + (e - s).astype(np.uint64) * U64(0xA0761D6478BD642F))
        a = b
    return out


def windows(padded: np.ndarray) -> np.ndarray:
    """The eight bytes that begin at each byte but the last seven, as one number."""
    return np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))


def _windows(buf: np.ndarray) -> np.ndarray:
    """The eight bytes that begin at each byte, as one number; zeros follow the last byte."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    return windows(padded)


_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def same_spans(a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray, length: np.ndarray, padded: bool = False) -> np.ndarray:
    """Whether spans of equal lengths in two buffers hold equal bytes; ``padded``: eight bytes or more follow the second one's spans."""
    out = np.ones(len(length), bool)
    live = np.flatnonzero(length)
    a8 = _windows(a)
    b8 = a8 if b is a else windows(b) if padded else _windows(b)
    at = 0
    while len(live) > 16 or len(live) and at < 64:
        left = length[live] - at
        differ = ((a8[a_start[live] + at] ^ b8[b_start[live] + at]) & _KEEP[np.minimum(left, 8)]) != 0
        out[live[differ]] = False
        live = live[(left > 8) & ~differ]
        at += 8
    for i in live.tolist():  # few long spans
        x, y, n = int(a_start[i]), int(b_start[i]), int(length[i])
        out[i] = np.array_equal(a[x + at : x + n], b[y + at : y + n])
    return out


def distinct_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The number of each span among the distinct ones, and the first span of each.

    Spans are one if their bytes are; their hashes only say which to compare.
    """
    h = hash_spans(buf, starts, ends) if h is None else h
    codes, keys = pd.factorize(h)
    codes = codes.astype(np.int64)
    first = np.empty(len(keys), np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    length = ends - starts
    mine = first[codes]
    other = length != length[mine]
    check = np.flatnonzero(~other & (mine != np.arange(len(codes))))
    other[check] = ~same_spans(buf, starts[check], buf, starts[mine[check]], length[check])
    if other.any():  # unlike spans of one hash
        found: dict[bytes, int] = {}
        more = []
        for i in np.flatnonzero(other).tolist():
            span = buf[starts[i] : ends[i]].tobytes()
            if span not in found:
                found[span] = len(keys) + len(more)
                more.append(i)
            codes[i] = found[span]
        first = np.concatenate([first, np.array(more, np.int64)])
    return codes, first


def gram_codes(codes: np.ndarray, n: int) -> np.ndarray:
    """Numbers of runs of n consecutive codes: equal if and only if all codes are."""
    m = len(codes) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    out, width = codes[:m].astype(np.int64), int(codes.max()) + 1
    for j in range(1, n):
        out = pd.factorize(out * width + codes[j : j + m])[0].astype(np.int64)
    return out


def seen_before(codes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which codes occur earlier in their document."""
    if not len(codes):
        return np.zeros(0, bool)
    pairs = pd.Series(doc * (int(codes.max()) + 1) + codes)
    return pairs.duplicated().to_numpy()


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of every run of n consecutive values (len(h) - n + 1 of them, 0 at least)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    if n <= 8:
        out = np.zeros(m, np.uint64)
        c = 0x2545F4914F6CDD1D
        for j in range(n):
            out += h[j : j + m] * U64(c)
            c = (c * 0xDA942042E4DD58B5 | 1) & _MASK
        return mix64(out)
    out = np.empty(m, np.uint64)
    for a in range(0, m, _BLOCK):
        b = min(m, a + _BLOCK)
        up, down = _WORD_POWERS.to(b - a + n)
        total = np.zeros(b - a + n, np.uint64)
        np.cumsum(h[a : b + n - 1] * up[: b - a + n - 1], out=total[1:])
        out[a:b] = mix64((total[n : n + b - a] - total[: b - a]) * down[: b - a])
    return out


def gram_owner(word_off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For grams over all words of a batch: which lie inside one document, and the document of each word."""
    counts = np.diff(word_off)
    doc = np.repeat(np.arange(len(counts)), counts)
    total = int(word_off[-1])
    m = max(0, total - n + 1)
    return doc[:m] == doc[n - 1 : n - 1 + m], doc


def sum_by(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, weights=values, minlength=n).astype(np.int64)


def counts_in(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many flags are set in each range off[i]..off[i + 1]."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices of all ranges starts[i]..starts[i] + lengths[i], one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.cumsum(lengths) - lengths
    return np.repeat(starts - shift, lengths) + np.arange(total)
