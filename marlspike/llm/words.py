"""Words of whole Arrow batches as 64-bit hashes, with numpy only.

A word is a maximal run of word bytes; which bytes those are is a table of 256 flags.  Its hash is a
polynomial over random byte values, taken from running sums modulo 2**64, then mixed; a word longer than
``HUGE`` bytes is hashed by xxhash instead, in either case by its content alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U = np.uint64
HUGE = 1 << 16
PIECE = 1 << 20
BATCH = 2 << 20
_rng = np.random.Generator(np.random.PCG64(20240229))
BYTES = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = U(0x9E3779B97F4A7C15 | 1)
_BACK = U(pow(int(_BASE), -1, 1 << 64))
POWERS = np.concatenate([[U(1)], np.multiply.accumulate(np.full(PIECE + HUGE, _BASE))])
INVERSE = np.concatenate([[U(1)], np.multiply.accumulate(np.full(PIECE + HUGE, _BACK))])

SPACES = np.ones(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = False
#: ASCII letters and digits and every byte of other characters; text is put in lower case first.
LETTERS = np.zeros(256, bool)
LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def texts(column: pa.Array | pa.ChunkedArray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if lower:
        column = pc.utf8_lower(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, last byte + 1) of every word, and for each text where its words begin."""
    inside = flags[data]
    if not len(data):
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    cut = offsets[:-1][offsets[:-1] < len(data)]
    before[cut] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    hashes = np.empty(len(start), U)
    at = 0
    while at < len(start):
        base = start[at]
        to = max(at + 1, int(np.searchsorted(start, base + PIECE)))
        s, e = start[at:to] - base, end[at:to] - base
        huge = e - s > HUGE
        last = int(e[-1]) if not huge[-1] else int(s[-1])
        part = data[base : base + last]
        sums = np.concatenate([[U(0)], np.cumsum(BYTES[part] * POWERS[: len(part)])])
        stop = np.where(huge, s, e)
        h = mix((sums[stop] - sums[s]) * INVERSE[s] ^ (e - s).astype(U))
        for k in np.flatnonzero(huge):
            h[k] = xxhash.xxh64_intdigest(data[start[at + k] : end[at + k]].tobytes())
        hashes[at:to] = h
        at = to
    return hashes, start, end, np.searchsorted(start, offsets)


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word runs that begin at each word but the last k - 1."""
    n = max(0, len(h) - k + 1)
    out = np.full(n, U(k * 0x632BE5AB))
    for j in range(k):
        out = mix(out * U(0xD6E8FEB86659FD93) + h[j : j + n])
    return out


def slices(sizes: np.ndarray, most: int = BATCH) -> Iterator[tuple[int, int]]:
    """Consecutive rows of about ``most`` bytes, one row at least."""
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        yield at, to
        at = to


def row_slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
    for a, b in slices(np.asarray(sizes, np.int64)):
        yield batch.slice(a, b - a)
