"""Texts of an Arrow batch as flat byte arrays, with words and hashes computed for many documents at once.

Every helper works on `data` (the UTF-8 bytes of several documents, one after the other) and `offsets` (n + 1 bounds).
Batches are cut into chunks of whole documents, so working arrays stay a fixed multiple of `CHUNK_BYTES`, or of the
longest single document if that is longer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2_000_000

#: White space of the word pattern `[^\x20\x09-\x0D]+`, by byte.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE_VALUES = np.random.Generator(np.random.PCG64(20240607)).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 65_536)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 4 * CHUNK_BYTES:
            _powers[int(base)] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values, so that every bit depends on every other."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, bounds, values = column.buffers()
    if len(column) == 0 or bounds is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(bounds, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8)[offsets[0] : offsets[-1]] if values is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, bounds) of runs of documents with about `limit` bytes in all."""
    data, offsets = flat(column)
    first, rows = 0, len(offsets) - 1
    while first < rows:
        stop = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, stop, data[offsets[first] : offsets[stop]], offsets[first : stop + 1] - offsets[first]
        first = stop


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums (mod 2**64) with a leading 0; `span_hash` turns two of them into the hash of a span."""
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE_VALUES[data] * _power_table(_BASE, len(data)), out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Equal byte strings have equal hashes wherever they start (the length is mixed in)."""
    value = (sums[stop] - sums[start]) * _power_table(_BASE_INVERSE, len(sums))[start]
    return mix(value + (stop - start).astype(np.uint64))


def gram_hash(sums: np.ndarray, length: int) -> np.ndarray:
    """The hash of the `length` bytes from every position on."""
    n = len(sums) - length
    if n <= 0:
        return np.empty(0, np.uint64)
    return mix((sums[length:] - sums[:n]) * _power_table(_BASE_INVERSE, len(sums))[:n])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document number of every word."""
    n = len(data)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    inside = ~SEPARATOR[data]
    fresh = np.zeros(n + 1, bool)
    fresh[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | fresh[1:n]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | fresh[1:n]
    begins = np.flatnonzero(start)
    return begins, np.flatnonzero(stop) + 1, np.searchsorted(offsets, begins, "right") - 1


def shingles(word_hash: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of `size` words of one document, and the number of its first word."""
    n = len(word_hash) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    value = np.zeros(n, np.uint64)
    for j in range(size):
        value *= np.uint64(0xD6E8FEB86659FD93)
        value += word_hash[j : j + n]
    whole = np.flatnonzero(doc[:n] == doc[size - 1 :])
    return mix(value[whole]), whole
