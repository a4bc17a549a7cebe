"""Texts of Arrow batches as flat byte arrays, and hashes of their words, for operators in NumPy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of text that are worked on at once; a longer text is worked on alone.
AT_ONCE = 1 << 19
#: Rows a batch that Spark hands over. Its own 10,000 take some 100 MB in the JVM and again in the worker.
ROWS_AT_ONCE = 1000
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = {}


def small_batches(spark: SparkSession) -> None:
    """Lets Spark hand over ROWS_AT_ONCE rows at most at a time, from now on in this session; fewer if it does so already."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ROWS_AT_ONCE:
        spark.conf.set(name, str(ROWS_AT_ONCE))


def powers(base: int, n: int) -> np.ndarray:
    """base^0 ... base^(n-1) modulo 2^64; kept, grown by doubling."""
    have = _powers.get(base, np.ones(1, np.uint64))
    while len(have) < n:
        have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
    if len(have) <= 4 * AT_ONCE:
        _powers[base] = have
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def parts(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) of successive runs of rows of at most AT_ONCE bytes; no text is null."""
    large = texts.cast(pa.large_binary())
    offsets = np.frombuffer(large.buffers()[1], np.int64)[large.offset : large.offset + len(large) + 1]
    data = np.frombuffer(large.buffers()[2], np.uint8) if large.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(large):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + AT_ONCE, "right")) - 1)
        j = min(j, len(large))
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """S with S[i] = sum of value(data[j]) * base^j for j < i, modulo 2^64."""
    s = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * powers(_BASE, len(data)), out=s[1:])
    return s


def span_hash(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], the same for the same bytes wherever they stand."""
    n = int(start.max()) + 1 if len(start) else 1
    return mixed((s[end] - s[start]) * powers(_BACK, n)[start] + (end - start).astype(np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the number of words before each document (one more than documents)."""
    data = LOWER[data]
    space = SPACES[data]
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True
    word = ~space
    first = word.copy()
    first[1:] &= space[:-1] | begins[1:-1]
    last = word.copy()
    last[:-1] &= space[1:] | begins[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return span_hash(prefix_hash(data), start, end), np.searchsorted(start, offsets)
