"""Hashes of words and word sequences of whole texts, vectorised over the bytes of an Arrow string column."""

from __future__ import annotations

import ctypes
from functools import lru_cache

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
# White space and ASCII signs: what separates words when punctuation is to be ignored.
SIGNS = SPACE.copy()
SIGNS[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
_BLOCK = 1 << 18
_LANES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_ONE = np.uint64(1)


@lru_cache(1)
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:  # another C library
        return None


def trim() -> None:
    """Give freed memory back to the system: workers are kept for later tasks, and large arrays leave holes."""
    pa.default_memory_pool().release_unused()
    if _libc() is not None:
        _libc().malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int) -> np.ndarray:
    out = np.full(_BLOCK + 1, np.uint64(base))
    out[0] = _ONE
    return np.multiply.accumulate(out)


_POWERS = [(_powers(p), _powers(pow(p, -1, 2**64)), p, pow(p, -1, 2**64)) for p in (0x2545F4914F6CDD1D, 0x5851F42D4C957F2D)]


def _table(lane: int, lower: bool) -> np.ndarray:
    codes = np.arange(256, dtype=np.uint64)
    if lower:
        codes[65:91] += np.uint64(32)
    return mix((codes + _ONE) * np.uint64(_LANES[lane]))


def column_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.cast(pa.large_binary())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null(b"")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


class Words:
    """Words (runs of bytes outside `breaks`, by default `[^\\x20\\x09-\\x0D]+`) of all texts of a column: byte starts and ends, first word of each text, 64-bit hashes."""

    def __init__(self, texts: pa.Array, lower: bool = False, lanes: int = 1, breaks: np.ndarray = SPACE):
        data, offsets = column_bytes(texts)
        self.data, self.offsets = data, offsets
        word = ~breaks[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.concatenate([[False], word[:-1]]) if len(data) else word
        start = word & (~before | edge[:-1])
        after = np.concatenate([word[1:], [False]]) if len(data) else word
        end = word & (~after | edge[1:])
        self.starts, self.ends = np.flatnonzero(start), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.hashes = [self._hash(lane, lower) for lane in range(lanes)]

    def _hash(self, lane: int, lower: bool) -> np.ndarray:
        table = _table(lane, lower)
        up, down, base, inverse = _POWERS[lane]
        at_start, at_end = np.zeros(len(self.starts), np.uint64), np.zeros(len(self.ends), np.uint64)
        scale = np.zeros(len(self.starts), np.uint64)
        carry = np.uint64(0)
        for lo in range(0, len(self.data), _BLOCK):
            part = table[self.data[lo : lo + _BLOCK]] * up[: min(_BLOCK, len(self.data) - lo)] * np.uint64(pow(base, lo, 2**64))
            total = np.concatenate([[carry], part]).cumsum(dtype=np.uint64)
            hi = lo + len(part)
            a, b = np.searchsorted(self.starts, [lo, hi])
            at_start[a:b] = total[self.starts[a:b] - lo]
            scale[a:b] = down[self.starts[a:b] - lo] * np.uint64(pow(inverse, lo, 2**64))
            a, b = np.searchsorted(self.ends, [lo, hi], side="right")
            at_end[a:b] = total[self.ends[a:b] - lo]
            carry = total[-1]
        return mix((at_end - at_start) * scale)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rolling(self, size: int, lane: int = 0) -> np.ndarray:
        """Hash of the `size` words from each word on, over text ends too; mask with `inside`."""
        h = self.hashes[lane]
        n = len(h) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        base = np.uint64(_LANES[lane] | 1)
        out = np.zeros(n, np.uint64)
        for k in range(size):
            out = out * base + h[k : k + n]
        return mix(out)

    def inside(self, size: int) -> np.ndarray:
        """Which of the rolling windows lie within one text."""
        n = max(0, len(self.starts) - size + 1)
        left = np.repeat(self.first[1:], self.counts)[:n] - np.arange(n)
        return left >= size


def packed(values: np.ndarray) -> bytes:
    """Ascending unsigned integers as byte planes of their gaps, which the shuffle codec compresses well."""
    gaps = np.diff(values, prepend=values.dtype.type(0))
    return gaps.view(np.uint8).reshape(-1, values.dtype.itemsize).T.tobytes()


def unpacked(raw: bytes, dtype) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel().cumsum(dtype=dtype)


def planes(values: np.ndarray) -> bytes:
    return values.view(np.uint8).reshape(-1, values.dtype.itemsize).T.tobytes()


def from_planes(raw: bytes, dtype) -> np.ndarray:
    rows = np.frombuffer(raw, np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return np.ascontiguousarray(rows.T).view(dtype).ravel()


def slices(batch: pa.RecordBatch, text: str, limit: int):
    """Parts of a batch of about `limit` bytes of text each, at least one row."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_numpy()
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // limit, prepend=-1))
    for lo, hi in zip(cuts, [*cuts[1:], len(batch)]):
        yield batch.slice(lo, hi - lo)
