"""Word and byte hashes of whole Arrow text columns, in numpy.

A text column is one byte buffer with offsets, so a batch is hashed with a few array passes instead of one call a row.
Positional sums ``sum(value[i] * R**i)`` modulo 2**64 give the hash of any range as a difference of two prefix sums,
scaled back by the inverse power; the result is mixed so that all bits can be used.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

# fixed odd multipliers and mixing constants
BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xC2B2AE3D27D4EB4F
MIX_1, MIX_2 = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53
BLOCK = 1 << 20  # bytes hashed at a time

_POWERS: dict = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(MIX_1)
    h ^= h >> np.uint64(33)
    h *= np.uint64(MIX_2)
    h ^= h >> np.uint64(33)
    return h


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and its inverse modulo 2**64 for i < n, kept for the next call."""
    known = _POWERS.get(base)
    if known is None or len(known[0]) < n:
        size = max(n, 1 << 16)
        inverse = pow(base, -1, 1 << 64)
        with np.errstate(over="ignore"):
            up = np.full(size, base, np.uint64)
            down = np.full(size, inverse, np.uint64)
            up[0] = down[0] = 1
            known = np.multiply.accumulate(up), np.multiply.accumulate(down)
        _POWERS[base] = known
    return known[0][:n], known[1][:n]


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hash of ``values[s:e]`` for each pair; equal ranges get equal hashes wherever they stand."""
    up, down = powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, size: int = BLOCK):
    """Ranges of rows that hold about ``size`` bytes; a longer row stands alone."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end
        row = end


def pieces(batches, column: str):
    """Record batches cut so that each holds few megabytes of the text column, or one row."""
    for batch in batches:
        _, offsets = text_buffer(batch.column(column))
        for low, high in slices(offsets, 2 * BLOCK):
            yield batch.slice(low, high - low)


_BYTE_VALUES = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(BASE))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER_VALUES = _BYTE_VALUES[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def byte_values(data: np.ndarray) -> np.ndarray:
    """A random 64-bit number for each byte."""
    return _BYTE_VALUES[data]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word ``[^\\x20\\x09-\\x0D]+`` and the row limits in the word list."""
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[:1] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1:] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_array(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The words themselves as one string array, in order; all that stands between them must be white space."""
    solid = np.ascontiguousarray(data[~_SPACE[data]])
    limits = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=limits[1:])
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(limits), pa.py_buffer(solid)])


def joined_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, limits: np.ndarray, kept: np.ndarray) -> pa.Array:
    """The kept words of each row joined by one space; ``kept`` marks words."""
    rows = len(limits) - 1
    solid = ~_SPACE[data]
    edges = np.zeros(len(data) + 1, np.int8)
    edges[starts[~kept]] += 1
    edges[ends[~kept]] -= 1
    stays = solid & (np.cumsum(edges[:-1], dtype=np.int8) == 0)
    which = np.flatnonzero(kept)
    row = np.searchsorted(limits, which, "right") - 1
    followed = which[:-1][row[1:] == row[:-1]]
    stays[ends[followed]] = True
    flat = np.where(solid, data, np.uint8(32))[stays]
    sizes = np.bincount(row, (ends - starts)[which], rows).astype(np.int64) + np.bincount(np.searchsorted(limits, followed, "right") - 1, minlength=rows)
    offsets = np.zeros(rows + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    kind, width = (pa.string(), np.int32) if offsets[-1] < 2**31 else (pa.large_string(), np.int64)
    return pa.Array.from_buffers(kind, rows, [None, pa.py_buffer(offsets.astype(width)), pa.py_buffer(np.ascontiguousarray(flat))])


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every word, and the row limits in the word list.

    The bytes are hashed in blocks that end at a word's end, so a long text needs a few bytes a word and one block.
    """
    starts, ends, limits = word_spans(data, offsets)
    table = _LOWER_VALUES if lower else _BYTE_VALUES
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        last = int(np.searchsorted(ends, starts[first] + BLOCK, "right"))
        last = max(last, first + 1)
        low, high = starts[first], ends[last - 1]
        out[first:last] = range_hashes(table[data[low:high]], starts[first:last] - low, ends[first:last] - low, BASE)
        first = last
    return out, starts, ends, limits


def sequence_hashes(words: np.ndarray, size: int, base: int = WORD_BASE) -> np.ndarray:
    """Hash of each run of ``size`` consecutive values, by its first position."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    at = np.arange(n)
    return range_hashes(words, at, at + size, base)


def window_starts(limits: np.ndarray, size: int) -> np.ndarray:
    """Marks the positions from which ``size`` values stay inside one row."""
    n = int(limits[-1])
    fits = np.zeros(max(n, 0), bool)
    room = np.repeat(limits[1:], np.diff(limits)) - np.arange(n)
    fits[:] = room >= size
    return fits


def minimisers(values: np.ndarray, width: int) -> np.ndarray:
    """Leftmost position of the smallest of each ``width`` consecutive values, by their upper 40 bits.

    The place stands in the lower 24 bits, so one minimum finds both; longer input goes in overlapping parts.
    """
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    part = (1 << 24) - width
    out = np.empty(n, np.int64)
    for first in range(0, n, part):
        count = min(part, n - first)
        low = (values[first:first + count + width - 1] >> np.uint64(24)) << np.uint64(24)
        low |= np.arange(len(low), dtype=np.uint64)
        reach = 1
        while reach * 2 <= width:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        if reach < width:
            low = np.minimum(low[:count], low[width - reach:width - reach + count])
        out[first:first + count] = (low[:count] & np.uint64((1 << 24) - 1)).astype(np.int64) + first
    return out
