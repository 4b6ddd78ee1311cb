"""What several operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: The six white-space characters between words, as a Java and RE2 character class.
WS = "[\\x20\\x09-\\x0D]"
#: The same characters as a string, for trim and translate.
WS_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column without copies; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    if column.null_count:
        column = column.fill_null("")
    n, at = len(column), column.offset
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[at : at + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def positional(df: DataFrame) -> DataFrame:
    """df with its columns called c0, c1 and so on, so that no name of the user's can clash or needs quoting."""
    return df.toDF(*(f"c{k}" for k in range(len(df.columns))))


def by_size(column: pa.Array, size: int = 4 << 20, rows: int = 256) -> Iterator[tuple[int, int]]:
    """Ranges of a batch's rows with about so many bytes of text and at most so many rows, to bound what is held at once."""
    _, offsets = buffers(column)
    at = 0
    while at < len(column):
        to = min(at + rows, max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1))
        yield at, to
        at = to


def trimmed(run: Callable) -> Callable:
    """A function over batches that gives the memory it has freed back to the system: workers are used again by later
    tasks, and what one of them keeps is missing on the executor."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


def trim() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it trims by itself or not at all
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over unsigned 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.cumprod(steps, dtype=np.uint64)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every A-Z-lower-cased word of every text, and how many words each text has.

    One pass over the batch's bytes: words are runs without white space, texts end words, and a word's
    hash is the difference of two prefix sums of a polynomial in an odd base, scaled back to the word's
    start and finalised together with the word's length.
    """
    n = len(data)
    if not n:
        return np.empty(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    word = ~_SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < n]
    first[inner] = word[inner]
    last = word.copy()
    last[:-1] &= ~word[1:]
    edge = inner[inner > 0] - 1
    last[edge] = word[edge]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    out = np.empty(len(starts), np.uint64)
    step = 1 << 20
    # Blocks keep the powers in cache; a word belongs to the block of its start and may end in a later one.
    at = 0
    with np.errstate(over="ignore"):
        while at < len(starts):
            to = max(at + 1, int(np.searchsorted(starts, starts[at] + step)))
            lo, hi = int(starts[at]), int(ends[to - 1])
            size = hi - lo
            sums = np.zeros(size + 1, np.uint64)
            np.cumsum((_LOWER[data[lo:hi]].astype(np.uint64) + np.uint64(1)) * _powers_cached(size, False), out=sums[1:])
            s, e = starts[at:to] - lo, ends[at:to] - lo
            value = (sums[e] - sums[s]) * _powers_cached(size, True)[s]
            out[at:to] = mix(value + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            at = to
    counts = np.diff(np.searchsorted(starts, offsets))
    return out, counts


_CACHE: dict[bool, np.ndarray] = {}


def _powers_cached(n: int, inverse: bool) -> np.ndarray:
    if inverse not in _CACHE or len(_CACHE[inverse]) < n:
        with np.errstate(over="ignore"):
            _CACHE[inverse] = _powers(_INVERSE if inverse else _BASE, max(n, (1 << 20) + 4096))
    return _CACHE[inverse][:n]


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of so many words; of the whole sequence if it is shorter; none of none."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    width = min(width, n)
    with np.errstate(over="ignore"):
        h = np.full(n - width + 1, np.uint64(width), np.uint64)
        for k in range(width):
            h = mix(h * np.uint64(0x9FB21C651E98DF25) + words[k : n - width + 1 + k])
    return h
