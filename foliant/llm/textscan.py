"""Vectorised word scanning over Arrow string buffers, for the numpy operators.

Words are found by table look-ups on the UTF-8 bytes and hashed to 64 bits from
their 8-byte pieces, so no Python object is made per word. A batch is scanned in
slices of about ``SLICE`` bytes, which bounds memory whatever the batch holds; a
single longer text forms a slice of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
U = np.uint64


def _tables():
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    word = np.ones(256, dtype=bool)
    word[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
    plain = word.copy()
    plain[[b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)]] = False
    return low, word, plain, np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=U)


LOW, WORD_BYTE, PLAIN_BYTE, MASKS = _tables()


def mix(x):
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def buffers(column):
    """Bytes and offsets of an Arrow string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column, most=SLICE):
    """Yields (first row, bytes, offsets) of runs of rows of about ``most`` bytes."""
    data, offsets = buffers(column)
    at = 0
    while at < len(offsets) - 1:
        end = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        end = min(max(end, at + 1), len(offsets) - 1)
        yield at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def spans(data, offsets, punct=False):
    """Starts and ends (byte positions) of the words, and the first word of each row."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = np.take(PLAIN_BYTE if punct else WORD_BYTE, data)
    edge = np.zeros(n + 2, dtype=bool)
    edge[offsets + 1] = True  # a word doesn't go on in the next row
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[1:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[2:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data, starts, ends, lower=True):
    """64-bit hashes of the words; equal words have equal hashes in any batch."""
    if not len(starts):
        return np.zeros(0, U)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[:-8] = np.take(LOW, data) if lower else data
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))
    length = ends - starts
    out = _step(length.astype(U), eight[starts] & MASKS[np.minimum(length, 8)])
    rows = np.flatnonzero(length > 8)
    at, left = starts[rows] + 8, length[rows] - 8
    while len(rows):
        out[rows] = _step(out[rows], eight[at] & MASKS[np.minimum(left, 8)])
        more = left > 8
        rows, at, left = rows[more], at[more] + 8, left[more] - 8
    return out


def _step(state, piece):
    state = (state + U(0x9E3779B97F4A7C15)) ^ piece
    state *= U(0xBF58476D1CE4E5B9)
    state ^= state >> U(29)
    state *= U(0x94D049BB133111EB)
    state ^= state >> U(32)
    return state


def scan(data, offsets, punct=False, lower=True):
    """(hashes of all words in order, first word of each row and the end)."""
    starts, ends, first = spans(data, offsets, punct)
    return hashes(data, starts, ends, lower), first
