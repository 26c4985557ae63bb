"""Words of whole Arrow batches and their hashes, by numpy over the text bytes.

A word is a maximal run of bytes outside `[\\x20\\x09-\\x0D]`. Word and window
hashes are 64-bit polynomials over random byte values, finished by a bijective
mixer; a caller that needs certainty takes two of them with different seeds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
CHUNK_BYTES = 4 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finisher of 64-bit integers (public-domain splitmix64 constants)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class WordHasher:
    """Hashes of words and of word windows for one seed."""

    def __init__(self, seed: int = 1, lower: bool = False):
        rng = np.random.Generator(np.random.PCG64(seed))
        table = rng.integers(0, 2**64, 256, dtype=U64)
        if lower:
            table[65:91] = table[97:123]
        self.table = table
        self.base = int(rng.integers(0, 2**63)) * 2 + 1
        self.step = U64(int(rng.integers(0, 2**63)) * 2 + 1)
        self.powers = np.ones(1, U64)

    def _powers(self, n: int) -> np.ndarray:
        if len(self.powers) < n:
            size = max(64, n)
            steps = np.full(size, self.base, U64)
            steps[0] = 1
            self.powers = np.cumprod(steps, dtype=U64)
        return self.powers

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """One hash for each word `data[start:end]`."""
        if not len(starts):
            return np.zeros(0, U64)
        lens = ends - starts
        first = np.cumsum(lens) - lens
        within = np.arange(int(lens.sum()), dtype=np.int64)
        at = within + np.repeat(starts - first, lens)
        within -= np.repeat(first, lens)
        values = self.table[data[at]]
        values *= self._powers(int(lens.max()))[within]
        return mix64(np.add.reduceat(values, first) + lens.astype(U64))

    def windows(self, words: np.ndarray, k: int) -> np.ndarray:
        """The hash of each `k` consecutive words; windows cross documents, callers pick the valid ones."""
        n = len(words) - k + 1
        if n <= 0:
            return np.zeros(0, U64)
        total = words[k - 1 : k - 1 + n].copy()
        for j in range(k - 2, -1, -1):
            total *= self.step
            total += words[j : j + n]
        return mix64(total)


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


SEPARATOR = np.zeros(256, bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
#: Every ASCII character but letters and digits; what is not ASCII is part of a word.
PUNCTUATION = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


class Words:
    """Word bounds of consecutive documents: word i of them is `data[starts[i]:ends[i]]`."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SEPARATOR):
        """`offsets` (one more than documents) cut `data` into documents, bytes of `separator` into words."""
        self.data = data
        n = len(data)
        solid = ~separator[data]
        cut = np.zeros(n + 1, bool)
        cut[offsets] = True
        begins = solid.copy()
        begins[1:] &= ~solid[:-1] | cut[1:n]
        closes = solid.copy()
        closes[:-1] &= ~solid[1:] | cut[1:n]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(closes) + 1
        #: Index of each document's first word; one more entry than documents.
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def position(self) -> np.ndarray:
        """The index of each word in its own document."""
        return np.arange(len(self.starts)) - np.repeat(self.first[:-1], self.counts)


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """(from, to) document ranges of about `limit` bytes; a longer document stands alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def binary_rows(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary column whose row i holds the bytes of `values[bounds[i]:bounds[i+1]]`."""
    values = np.ascontiguousarray(values)
    at = (np.asarray(bounds, np.int64) * values.itemsize).astype(np.int32 if values.nbytes < 2**31 else np.int64)
    kind = pa.binary() if at.dtype == np.int32 else pa.large_binary()
    return pa.Array.from_buffers(kind, len(at) - 1, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(values.tobytes())])


def from_binary(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """(values, counts per row) of a column made by `binary_rows`."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    data, offsets = string_buffers(column) if not column.null_count else string_buffers(pc.fill_null(column, b""))
    size = np.dtype(kind).itemsize
    return np.frombuffer(data.tobytes(), kind), np.diff(offsets) // size
