"""Words of whole texts and hashes of word windows, computed with NumPy over Arrow batches.

A batch's texts stay one UTF-8 buffer. Words are the runs of bytes outside space and \\t \\n \\v \\f
\\r (these never occur inside a multi-byte character). Hashes are Rabin-Karp polynomials modulo
2^64 over a random byte table, taken from prefix sums, and mixed at the end; two independent
seeds give longer keys where equality of hashes is taken for equality of words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1_000_000

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=8)
def _table(seed: int) -> tuple[np.ndarray, int, int]:
    """Random values of the bytes, an odd base and its inverse modulo 2^64."""
    rng = np.random.Generator(np.random.PCG64(seed))
    values = rng.integers(0, 2 ** 64, 256, dtype=np.uint64)
    base = int(rng.integers(0, 2 ** 64, dtype=np.uint64)) | 5
    return values, base, pow(base, -1, 2 ** 64)


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, kept for the next batch unless a long text needs many."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(2 ** 16, 1 << n.bit_length()), base, dtype=np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= 2 * SLICE_BYTES:
            _POWERS[base] = have
    return have[:n]


def run_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """Hash of values[s:e] for each pair; equal runs get equal hashes wherever they stand."""
    _, base, inverse = _table(seed)
    prefix = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(base, len(values)), out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * powers(inverse, len(values) + 1)[starts])


@dataclass
class Words:
    """Words of consecutive documents. starts, ends: bytes; first: index of each document's first
    word, with the total at the end."""
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, seed: int) -> np.ndarray:
        return run_hash(_table(seed)[0][self.data], self.starts, self.ends, seed)

    def windows(self, word_hashes: np.ndarray, n: int, seed: int) -> np.ndarray:
        """Hash of the n words from each word on; only those at ``valid(n)`` lie in one document."""
        m = len(word_hashes) - n + 1
        if m <= 0:
            return np.empty(0, dtype=np.uint64)
        at = np.arange(m)
        return run_hash(word_hashes, at, at + n, seed)

    def valid(self, n: int) -> np.ndarray:
        """Indices of the words that begin a window of n words inside their document."""
        at = np.arange(len(self.starts))
        last = np.repeat(self.first[1:], self.counts)
        return at[at + n <= last]

    def doc_of(self, words: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, words, "right") - 1


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def split_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    word = ~IS_SPACE[data]
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    start[inner] |= word[inner]
    end[inner - 1] |= word[inner - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES
           ) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``limit`` bytes of text (at least one row each), so that memory
    follows the longest text and not the batch."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    begin, held = 0, 0
    for row, size in enumerate(sizes):
        if row > begin and held + size > limit:
            yield batch.slice(begin, row - begin)
            begin, held = row, 0
        held += int(size)
    if begin < batch.num_rows:
        yield batch.slice(begin)
    give_back()


def give_back() -> None:
    """Return freed memory to the system: workers idle between stages, beside the executor's own."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def words_of(batch: pa.RecordBatch, column: str) -> Words:
    return split_words(*utf8(batch.column(column)))
