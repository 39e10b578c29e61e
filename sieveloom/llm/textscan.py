"""Vectorised scanning of Arrow text columns.

Every function works on the raw UTF-8 bytes of many documents at once, so the
Python cost is per chunk, not per document, and a chunk holds at most
``CHUNK_BYTES`` of text (or one longer document).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_MASK = (1 << 64) - 1
_R = 0x9E3779B97F4A7C15 | 1
_RINV = pow(_R, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 arrays (xor-shift-multiply)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_POW = np.ones(1, np.uint64)
_INV = np.ones(1, np.uint64)

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """R**i and R**-i for i < n, modulo 2**64."""
    global _POW, _INV
    if len(_POW) < n:
        size = max(n, 1 << 16)
        for name, r in (("_POW", _R), ("_INV", _RINV)):
            steps = np.full(size, r, np.uint64)
            steps[0] = 1
            globals()[name] = np.multiply.accumulate(steps)
    return _POW[:n], _INV[:n]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(data: np.ndarray, offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of at most ``limit`` bytes: (first, end, bytes, offsets)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of ``inside`` that do not cross a document's end."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(inside) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(inside), bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(len(inside), bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+``: starts, ends and the row of each."""
    starts, ends = spans(~WHITE[data], offsets)
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def prefix_hash(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(c, inv): (c[e] - c[s]) * inv[s] is the polynomial hash of data[s:e]."""
    power, inverse = _powers(len(data) + 1)
    c = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[:-1], out=c[1:])
    return c, inverse


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, limit: int = CHUNK_BYTES) -> np.ndarray:
    """A 64-bit hash of data[s:e] for each span (spans in ascending order)."""
    out = np.zeros(len(starts), np.uint64)
    i, n = 0, len(starts)
    while i < n:
        j = max(int(np.searchsorted(ends, starts[i] + limit, "right")), i + 1)
        low, high = int(starts[i]), int(ends[j - 1])
        c, inv = prefix_hash(data[low:high])
        s, e = starts[i:j] - low, ends[i:j] - low
        out[i:j] = mix64((c[e] - c[s]) * inv[s] + (e - s).astype(np.uint64))
        i = j
    return out


def window_hash(data: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all len(data) - k + 1 byte windows of length k."""
    if len(data) < k:
        return np.zeros(0, np.uint64)
    c, inv = prefix_hash(data)
    return mix64((c[k:] - c[:-k]) * inv[: len(data) - k + 1])


def row_sums(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of integer values by row index (exact below 2**53)."""
    return np.bincount(rows, weights=values, minlength=n).astype(np.int64) if len(rows) else np.zeros(n, np.int64)
