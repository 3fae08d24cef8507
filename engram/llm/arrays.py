"""Numpy helpers over Arrow text columns, shared by the operators of this subpackage.

A batch of texts is one byte array plus offsets; words, lines and shingles are index arrays
into it, so nothing is done per word in Python.  Words are maximal runs of bytes other than
0x20 and 0x09-0x0D.  Hashes have 64 bits.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Texts are taken this many bytes at a time (a longer text comes alone), which bounds a task's memory.
SLICE_BYTES = 1 << 19
#: Odd multiplier of the rolling hash, and the seed of its byte table.
BASE, SEED = 0x9E3779B97F4A7C15, 20240607

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_PLAIN = np.random.default_rng(SEED).integers(1, 2**64, 256, dtype=U64)
_LOWER = _PLAIN.copy()
_LOWER[65:91] = _PLAIN[97:123]
_POWERS: list[np.ndarray] = []


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (murmur-style finaliser)."""
    h = h + U64((salt * 0xD6E8FEB86659FD93 + 0x632BE59BD9B4E019) % 2**64)
    h = (h ^ (h >> U64(32))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(29))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i <= n; kept for the usual slice length."""
    if _POWERS and len(_POWERS[0]) > n:
        return _POWERS[0], _POWERS[1]
    size = max(n, SLICE_BYTES + (1 << 18)) + 1
    made = []
    for base in (BASE, pow(BASE, -1, 2**64)):
        p = np.full(size, U64(base))
        p[0] = 1
        made.append(np.multiply.accumulate(p))
    if n <= SLICE_BYTES + (1 << 18):
        _POWERS[:] = made
    return made[0], made[1]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, offs, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def give_back() -> None:
    """Return freed memory to the system: Python workers stay between tasks, and would keep the most they ever held."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches cut by SLICE_BYTES of the text column: (rows, bytes, offsets)."""
    for batch in batches:
        data, offs = utf8(batch.column(text))
        at, n = 0, batch.num_rows
        while at < n:
            to = int(np.searchsorted(offs, offs[at] + SLICE_BYTES, "right")) - 1
            to = min(max(to, at + 1), n)
            yield batch.slice(at, to - at), data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
            at = to
    give_back()


def prefix_hash(data: np.ndarray, lower: bool = False) -> np.ndarray:
    """Sums for span_hash: one more than the bytes."""
    h = np.zeros(len(data) + 1, U64)
    np.cumsum((_LOWER if lower else _PLAIN)[data] * _powers(len(data))[0][: len(data)], out=h[1:])
    return h


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte spans; equal spans have equal hashes wherever they stand."""
    return mix((h[end] - h[start]) * _powers(len(h))[1][start] + U64(7) * (end - start).astype(U64))


def runs(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text index of the maximal runs of true bytes; none crosses from one text into the next."""
    n = len(inside)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    start = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    end = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return start, end, np.searchsorted(offs, start, "right") - 1


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return runs(~SPACE[data], offs)


def shingles(hashes: np.ndarray, doc: np.ndarray, docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and text index of k-word windows in order; a text of 1 to k-1 words gives its whole sequence."""
    n = len(hashes)
    full, at = np.zeros(0, U64), np.zeros(0, np.int64)
    if n >= k:
        same = np.flatnonzero(doc[: n - k + 1] == doc[k - 1 :])
        full = np.zeros(len(same), U64)
        for j in range(k):
            full = mix(full + hashes[same + j])
        at = doc[same]
    count = np.bincount(doc, minlength=docs) if n else np.zeros(docs, np.int64)
    short = np.flatnonzero((count > 0) & (count < k))
    if not len(short):
        return full, at
    first = np.searchsorted(doc, short)
    own = np.full(len(short), U64(k))
    for j in range(k - 1):
        has = count[short] > j
        own[has] = mix(own[has] + hashes[first[has] + j], 1)
    order = np.argsort(np.concatenate([at, short]), kind="stable")
    return np.concatenate([full, own])[order], np.concatenate([at, short])[order]


def distinct(h: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text, one text after the other, and their offsets."""
    bounds = np.searchsorted(doc, np.arange(docs + 1))
    h = h.copy()
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a > 1:
            h[a:b].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[keep], np.concatenate([[0], np.cumsum(keep)])[bounds].astype(np.int64)


def spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Concatenated start[i] .. start[i] + count[i] - 1."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    at = np.cumsum(count) - count
    return np.arange(total) - np.repeat(at - start, count)


def sum_by(doc: np.ndarray, docs: int, value: np.ndarray | None = None) -> np.ndarray:
    """Sums (or counts) by text as int64."""
    return np.bincount(doc, value, docs).astype(np.int64) if len(doc) else np.zeros(docs, np.int64)
