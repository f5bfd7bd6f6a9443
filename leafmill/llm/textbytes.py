"""Vectorised text primitives over the UTF-8 buffers of Arrow string columns.

Every operator that runs Python inside tasks works on whole Arrow batches: a batch is cut into
blocks of rows, a block is one flat ``uint8`` array plus row offsets, and words, hashes and n-grams
are computed for the whole block at once.  Nothing here knows about Spark.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that are processed at once; a longer document is a block of its own.
BLOCK_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_MIX_A, _MIX_B = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_SEED = U64(0x9E3779B97F4A7C15)
#: Masks of the lowest 0 to 8 bytes of a lane.
_LANE = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
#: Bytes beyond which a range is hashed or compared by itself.
LONG_RANGE = 256


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection that spreads every input bit."""
    h = (h ^ (h >> U64(30))) * _MIX_A
    h = (h ^ (h >> U64(27))) * _MIX_B
    return h ^ (h >> U64(31))


def mix_int(x: int) -> int:
    """mix() of one Python integer."""
    return int(mix(np.array([x & (2**64 - 1)], U64))[0])


@dataclass
class Block:
    """Rows lo to hi of a batch: their bytes end to end, and where each row starts."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return self.hi - self.lo


def buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * kind().itemsize).astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[at[0] : at[-1]], at - at[0]


def blocks(column: pa.Array | pa.ChunkedArray, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut a text column into blocks of whole rows of about ``size`` bytes."""
    data, offsets = buffer(column)
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield Block(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


@dataclass
class Words:
    """Words of a block in order; ``rows`` holds, for each row, the index of its first word (and the total)."""

    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), np.diff(self.rows))


def words(block: Block, separator: np.ndarray | None = None) -> Words:
    """Maximal runs of bytes that are not separators, never across rows.

    separator: 256 booleans by byte value, or a boolean for each byte of the block; white space if not given.
    """
    n = len(block.data)
    if not n:
        return Words(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(block.rows + 1, np.int64))
    gap = SPACE[block.data] if separator is None else separator[block.data] if len(separator) == 256 else separator
    edge = np.empty(n + 1, bool)
    edge[1:] = gap
    edge[0] = True
    edge[block.offsets] = True
    starts = np.flatnonzero(~gap & edge[:-1])
    edge[:-1] = gap
    edge[n] = True
    edge[block.offsets[1:]] = True
    ends = np.flatnonzero(~gap & edge[1:]) + 1
    return Words(starts, ends, np.searchsorted(starts, block.offsets))


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on (zeros beyond the end), as one number; a view that takes no more memory than data."""
    return np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))


def new_key() -> int:
    """A key for the hashes of one run, from the system's random numbers; the driver draws it and hands it to all tasks."""
    return secrets.randbits(64)


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: int = 0) -> np.ndarray:
    """64-bit hashes of byte ranges; equal ranges have equal hashes wherever they stand.

    Eight bytes at a time go through a bijection, so ranges of one length up to eight bytes never collide;
    a range of over LONG_RANGE bytes is hashed by BLAKE2b.  No array is longer than the list of ranges.  The steps are
    public and can be undone, so where texts may be written to collide a key is needed: every step starts from it.
    """
    n, view = ends - starts, lanes(data)
    h = mix(mix(mix(n.astype(U64) + _SEED) + U64(key)) ^ (view[starts] & _LANE[np.minimum(n, 8)])) if key else mix(mix(n.astype(U64) + _SEED) ^ (view[starts] & _LANE[np.minimum(n, 8)]))
    live, k = np.flatnonzero((n > 8) & (n <= LONG_RANGE)), 8
    while len(live):
        left = n[live] - k
        h[live] = mix((h[live] + U64(key)) * U64(3) ^ (view[starts[live] + k] & _LANE[np.minimum(left, 8)]))
        live, k = live[left > 8], k + 8
    for r in np.flatnonzero(n > LONG_RANGE):
        h[r] = int.from_bytes(hashlib.blake2b(data[starts[r] : ends[r]], digest_size=8, key=key.to_bytes(8, "little") if key else b"").digest(), "little")
    return h


def same_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, other_starts: np.ndarray, other_ends: np.ndarray) -> np.ndarray:
    """Whether each range of data holds the bytes of the same-numbered range of other."""
    n, a, b = ends - starts, lanes(data), lanes(other)
    same = n == other_ends - other_starts
    live, k = np.flatnonzero(same & (n > 0) & (n <= LONG_RANGE)), 0
    while len(live):
        left = n[live] - k
        equal = ((a[starts[live] + k] ^ b[other_starts[live] + k]) & _LANE[np.minimum(left, 8)]) == 0
        same[live[~equal]] = False
        live, k = live[equal & (left > 8)], k + 8
    for r in np.flatnonzero(same & (n > LONG_RANGE)):
        same[r] = np.array_equal(data[starts[r] : ends[r]], other[other_starts[r] : other_ends[r]])
    return same


def word_hashes(data: np.ndarray, w: Words, key: int = 0) -> np.ndarray:
    return range_hashes(data, w.starts, w.ends, key)


def shingles(hashes: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every ``size`` consecutive words, by row, and the row offsets of the result.

    A row with fewer words gives one shingle of them all, a row without words none.
    """
    factors = [U64(mix_int(0xA5A5 + 7 * k) | 1) for k in range(size)]
    counts = np.diff(rows)
    made = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    out_rows = np.concatenate([[0], np.cumsum(made)])
    first = np.repeat(rows[:-1] - out_rows[:-1], made) + np.arange(out_rows[-1])
    padded = np.concatenate([hashes, np.zeros(size, U64)])
    total = np.zeros(len(first), U64)
    for k in range(size):
        total += padded[first + k] * factors[k]
    for r in np.flatnonzero((counts > 0) & (counts < size)):
        h = hashes[rows[r] : rows[r + 1]]
        total[out_rows[r]] = sum((int(x) * int(f) for x, f in zip(h, factors, strict=False)), 0x51ED * len(h)) % 2**64
    return mix(total), out_rows


def distinct_sorted(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row, and row offsets."""
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    order = np.lexsort((values, row))
    values, row = values[order], row[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    return values[keep], np.searchsorted(row[keep], np.arange(len(rows)))


def gather_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all the ranges [start, start+length), end to end."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def arrow_bytes(data: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow string or binary array from flat bytes and row offsets."""
    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int32)), pa.py_buffer(np.ascontiguousarray(data, np.uint8))])


_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[48:58] = _WORD_BYTE[65:91] = _WORD_BYTE[97:123] = True
_WORD_BYTE[128:] = True


def punctuation(data: np.ndarray) -> np.ndarray:
    """True for each byte that is not part of a letter or digit: ASCII signs, U+00A0 to U+00BF, and U+2000 to U+203F."""
    gap = ~_WORD_BYTE[data]
    for lead, second, length in ((0xC2, None, 2), (0xE2, 0x80, 3)):
        at = np.flatnonzero(data[: max(len(data) - length + 1, 0)] == lead)
        if second is not None and len(at):
            at = at[data[at + 1] == second]
        for k in range(length):
            gap[at + k] = True
    return gap
