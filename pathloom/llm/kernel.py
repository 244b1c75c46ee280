"""Vectorised byte and word kernels over Arrow string columns.

Everything works on the UTF-8 bytes of many documents at once, so that the cost
of a numpy call is shared. Hashes are 64-bit and depend only on content, never
on position, partition or process.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Bytes of text worked on at a time; a longer document is worked on alone.
CHUNK_BYTES = 1 << 20

U64 = np.uint64
_MULT = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INV = pow(_MULT, -1, 1 << 64)


def one_thread(spark: SparkSession) -> None:
    """Matrix products in the Python workers of functions that are made from now on use one thread.

    Spark allows as many threads as an executor has cores to each of its tasks; between small products they spin, which costs the other tasks their cores.
    """
    spark.sparkContext.environment["OPENBLAS_NUM_THREADS"] = "1"


def _table(seed: int, n: int) -> np.ndarray:
    """n fixed 64-bit values (splitmix64), odd."""
    out, x = np.empty(n, U64), seed & _MASK
    for i in range(n):
        x = (x + 0x9E3779B97F4A7C15) & _MASK
        z = x
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _MASK
        out[i] = (z ^ (z >> 31)) | 1
    return out


BYTE_VALUE = _table(7, 256)
SHINGLE_VALUE = _table(11, 64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of h over all 64 bits."""
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(29)
    return h


@lru_cache(maxsize=4)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    with np.errstate(over="ignore"):
        p = np.cumprod(np.concatenate([[U64(1)], np.full(n, U64(_MULT))]), dtype=U64)
        q = np.cumprod(np.concatenate([[U64(1)], np.full(n, U64(_INV))]), dtype=U64)
    return p, q


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, for exponents 0 to n at least."""
    return _powers(max(16, int(n).bit_length()))


def text_chunks(col: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in them) with about ``limit`` bytes each; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    n = len(col)
    if not n:
        return
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    offsets = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(n, max(at + 1, end))
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def word_bounds(space: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs that are not space, never across rows; and each row's range of words."""
    n = len(space)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    inside = ~space
    first = inside.copy()
    first[1:] &= space[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= space[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def range_hash(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of symbols[start:end] for every range, from 64-bit symbols."""
    p, q = powers(len(symbols))
    total = np.zeros(len(symbols) + 1, U64)
    np.cumsum(symbols * p[: len(symbols)], out=total[1:])
    return mix((total[ends] - total[starts]) * q[starts] + (ends - starts).astype(U64))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; and each row's range of words."""
    starts, ends, rows = word_bounds(SPACE[data], offsets)
    return range_hash(BYTE_VALUE[LOWER[data]], starts, ends), rows


def shingle_hashes(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Hash of each run of ``size`` words; of fewer words, the whole sequence as one; of none, nothing."""
    n = len(words)
    if not n:
        return words
    k = min(n, size)
    h = np.full(n - k + 1, U64(k))
    for j in range(k):
        h += words[j : n - k + 1 + j] * SHINGLE_VALUE[j]
    return mix(h)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
