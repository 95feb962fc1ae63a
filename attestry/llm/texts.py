"""Whole texts as arrays: words, lines and shingles of a block of documents at once.

Python workers get documents in Arrow batches. A batch is cut into blocks of about two megabytes of
UTF-8 (one very long text is a block of its own), and every step below works on the arrays of a block,
so the memory of a task follows the block and not the table. Hashes are 64 bits wide and the same on
every machine: bytes are looked up in a fixed random table and summed as a polynomial.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 2 << 20
SEGMENT_BYTES = 1 << 20
BATCH_ROWS = 1000
SEED = 20240229

_rng = np.random.Generator(np.random.PCG64(SEED))
_BYTE_CODES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_SHINGLE_CODES = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []

#: Bytes of the classes that the operators use.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
SPACED_WORD = ~SPACE
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
ALNUM_WORD = np.zeros(256, bool)  # after lower-casing: digits, a-z and every byte of a character beyond ASCII
ALNUM_WORD[0x30:0x3A] = True
ALNUM_WORD[0x61:0x7B] = True
ALNUM_WORD[0x80:] = True


def small_batches(spark) -> None:
    """Hold Arrow batches to few rows, so that a batch of long texts stays small."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row range, bytes and offsets of each block; a block has one row at least."""
    raw, at = utf8(column)
    low, rows = 0, len(at) - 1
    while low < rows:
        high = max(low + 1, int(np.searchsorted(at, at[low] + limit, "right")) - 1)
        yield low, high, raw[at[low] : at[high]], at[low : high + 1] - at[low]
        low = high


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, kept for the next call."""
    if not _powers or len(_powers[0]) < size:
        n = max(size, SEGMENT_BYTES + 4096)
        made = []
        for base in (_BASE, _INVERSE):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            made.append(np.cumprod(p))
        _powers[:] = made
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit hash over all others."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span; spans are in order and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    low = 0
    while low < len(starts):
        high = max(low + 1, int(np.searchsorted(ends, starts[low] + SEGMENT_BYTES, "right")))
        a, z = int(starts[low]), int(ends[high - 1])
        up, down = powers(z - a + 1)
        total = np.zeros(z - a + 1, np.uint64)
        np.cumsum(_BYTE_CODES[raw[a:z]] * up[: z - a], out=total[1:])
        s, e = starts[low:high] - a, ends[low:high] - a
        out[low:high] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
        low = high
    return out


def spans(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes inside each document, and each document's first run."""
    before = np.zeros(len(member), bool)
    before[1:] = member[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    before[first] = False
    after = np.zeros(len(member), bool)
    after[:-1] = member[1:]
    after[offsets[1:][offsets[:-1] < offsets[1:]] - 1] = False
    starts = np.flatnonzero(member & ~before)
    ends = np.flatnonzero(member & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def words(raw: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words, and each document's first word."""
    starts, ends, bounds = spans(classes[raw], offsets)
    return starts, ends, span_hashes(raw, starts, ends), bounds


def owners(bounds: np.ndarray) -> np.ndarray:
    """The document of each item."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def windows(hashes: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``size`` words that stay in their document, and the words they begin at."""
    if len(hashes) < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(len(hashes) - size + 1, np.uint64)
    for j in range(size):
        total += hashes[j : len(hashes) - size + 1 + j] * _SHINGLE_CODES[j]
    inside = np.ones(len(total), bool)
    ends = bounds[1:-1]
    for j in range(1, size):
        at = ends - j
        inside[at[(at >= 0) & (at < len(total))]] = False
    at = np.flatnonzero(inside)
    return mix(total[at]), at


def shingles(hashes: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of each document and each document's first one.

    A document with fewer words than ``size`` has its whole sequence as one shingle, without words none.
    """
    made, at = windows(hashes, bounds, size)
    owner = np.searchsorted(bounds, at, "right") - 1
    count = np.diff(bounds)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        own = np.full(len(short), 0, np.uint64)
        for j in range(size - 1):
            have = count[short] > j
            own[have] += hashes[bounds[short[have]] + j] * _SHINGLE_CODES[j]
        own = mix(own + count[short].astype(np.uint64) * _SHINGLE_CODES[63])
        order = np.argsort(np.concatenate([owner, short]), kind="stable")
        made, owner = np.concatenate([made, own])[order], np.concatenate([owner, short])[order]
    return made, np.searchsorted(owner, np.arange(len(bounds)))


def distinct_sorted(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct values in ascending order."""
    owner = owners(bounds)
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    first = np.ones(len(v), bool)
    first[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    v, o = v[first], o[first]
    return v, np.searchsorted(o, np.arange(len(bounds)))


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of each document's values."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype == np.uint64 else np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
