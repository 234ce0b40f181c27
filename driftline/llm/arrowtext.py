"""Vectorised text primitives on Arrow arrays, used inside mapInArrow.

Words are maximal runs of bytes other than space and 09-0D, which is what
Arrow's ASCII white-space split yields once empty pieces are removed.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 8 << 20
A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def given_back() -> None:
    """Hand freed memory back to the system: an idle worker keeps what its last task needed otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def texts_of(column: pa.Array) -> pa.Array:
    """A plain string array; null becomes the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != pa.string():
        column = column.cast(pa.string())
    return pc.fill_null(column, "") if column.null_count else column


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each; a longer text stands alone."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(texts):
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield lo, hi
        lo = hi


def lists_of(split: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Flat values and row offsets of a list array, whatever its own offset."""
    offsets = split.offsets.to_numpy().astype(np.int64)
    return split.values.slice(offsets[0], offsets[-1] - offsets[0]), offsets - offsets[0]


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts, and for each text where its words begin and end."""
    flat, offsets = lists_of(pc.ascii_split_whitespace(texts))
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    if not full.all():
        seen = np.concatenate([[0], np.cumsum(full)])
        flat, offsets = flat.filter(pa.array(full)), seen[offsets]
    return flat, offsets


def coded(flat: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Codes and the distinct values of a string array."""
    d = flat.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False), d.dictionary


def strings(values: pa.Array) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False)


def hashes(values: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string, equal on every machine."""
    return pd.util.hash_array(strings(values), categorize=False) if len(values) else np.zeros(0, np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * B
    return h ^ (h >> np.uint64(29))


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the ``n`` values from each position on; the last n - 1 are dropped."""
    count = len(h) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = h[:count].copy()
    for k in range(1, n):
        out = out * A + h[k : k + count]
    return mixed(out)


def owners(offsets: np.ndarray) -> np.ndarray:
    """For each flat value the row that it belongs to."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the flat values of each row; 0 for an empty row."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def summed(code: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct codes in rising order, and the sums of their counts."""
    order = np.argsort(code, kind="stable")
    code = code[order]
    at = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    return code[at], *(np.add.reduceat(n[order], at) if len(at) else n[:0] for n in counts)


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts as one array, and row offsets in it."""
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class HeavyHitters:
    """Misra-Gries summary: at most ``size`` keys; each count is short by at most total / size.

    Summaries of parts can be added, so one pass over all rows is enough and
    memory does not grow with the vocabulary.
    """

    def __init__(self, size: int):
        self.size, self.counts = size, {}

    def add(self, keys, counts) -> None:
        get = self.counts.get
        for k, n in zip(keys, counts):
            self.counts[k] = get(k, 0) + n
        if len(self.counts) > 4 * self.size:
            self.shrink()

    def shrink(self) -> None:
        if len(self.counts) > self.size:
            cut = int(np.partition(np.fromiter(self.counts.values(), np.int64), -self.size - 1)[-self.size - 1])
            self.counts = {k: n - cut for k, n in self.counts.items() if n > cut}
