"""Vectorised text kernels on Arrow buffers: words, hashes and windows.

All functions work on the raw UTF-8 bytes of a chunk of rows.  A 64-bit
polynomial prefix hash gives the hash of any byte or word range in O(1), so
that no Python object is made for a word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
MUL_A = 0x9E3779B97F4A7C15
MUL_B = 0xBF58476D1CE4E5B9
BASE_BYTES = 0xD6E8FEB86659FD93
BASE_WORDS = 0xA0761D6478BD642F
MASK = (1 << 64) - 1

#: The bytes that separate words: space and 0x09 to 0x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x):
    """Finaliser: spreads every bit of a uint64 array over all bits."""
    x = (x ^ (x >> U(30))) * U(MUL_B)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_powers: dict = {}


def powers(base, n):
    """base**0..n and its inverse powers modulo 2**64; grown when needed."""
    have = _powers.get(base)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, 1 << 16)
        up, down = np.full(size, base, U), np.full(size, pow(base, -1, 1 << 64), U)
        up[0] = down[0] = 1
        have = _powers[base] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return have


def prefix(values, base):
    """Prefix sums of values[i] * base**i."""
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(base, len(values))[0][: len(values)], out=out[1:])
    return out


def ranges(sums, start, end, base):
    """Hashes of the ranges start..end of the sequence behind sums."""
    return mix((sums[end] - sums[start]) * powers(base, len(sums))[1][start] + (end - start).astype(U) * U(MUL_A))


def windows(values, width, base=BASE_WORDS):
    """Hash of every window of width consecutive values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, U)
    sums = prefix(values, base)
    return mix((sums[width:] - sums[:n]) * powers(base, len(sums))[1][:n] + U((width * MUL_A) & MASK))


def text_buffer(array):
    """Bytes and int64 offsets of a string array; nulls are empty."""
    array = array.cast(pa.large_string()) if not pa.types.is_large_string(array.type) else array
    if array.null_count:
        array = array.fill_null("")
    offsets = np.frombuffer(array.buffers()[1], np.int64, len(array) + 1, array.offset * 8)
    data = array.buffers()[2]
    if data is None or not len(array):
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches, column, most):
    """The batches' rows in pieces of about `most` text bytes: small batches together, large ones
    cut; a row of more bytes is a piece of its own."""
    held, size = [], 0
    for batch in batches:
        _, offsets = text_buffer(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + most - size, "right")) - 1
            if to <= at and held:
                to = at
            else:
                to = max(to, at + 1)
                held.append(batch.slice(at, to - at))
                size += int(offsets[to] - offsets[at])
            if to < batch.num_rows:
                yield whole(held)
                held, size = [], 0
            at = to
    if held:
        yield whole(held)


def whole(batches):
    return batches[0] if len(batches) == 1 else pa.concat_batches(batches)


class Words:
    """Words of a chunk: byte spans, hashes, and the first word of each row."""

    __slots__ = ("data", "offsets", "start", "end", "rows", "hash")

    def __init__(self, array, lower=False):
        data, self.offsets = text_buffer(array)
        self.data = LOWER[data] if lower else data
        inside = ~IS_SPACE[data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        full = self.offsets[1:] > self.offsets[:-1]
        edge = self.offsets[:-1][full]
        first[edge] = inside[edge]
        edge = self.offsets[1:][full] - 1
        last[edge] = inside[edge]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.rows = np.searchsorted(self.start, self.offsets)
        sums = prefix(self.data.astype(U) + U(1), BASE_BYTES)
        self.hash = ranges(sums, self.start, self.end, BASE_BYTES)

    def counts(self):
        return np.diff(self.rows)

    def row_of(self):
        """Row number of each word."""
        return np.repeat(np.arange(len(self.rows) - 1), self.counts())


def window_rows(rows, width):
    """For windows of a row-wise sequence: a mask of starts whose window stays within its row."""
    n = max(0, int(rows[-1]) - width + 1)
    ok = np.ones(n, bool)
    if n:
        left = np.repeat(rows[1:], np.diff(rows))[:n]
        ok = np.arange(n) + width <= left
    return ok


def binary(values):
    """A binary Arrow array of bytes objects, of any total size."""
    return pa.array(values, pa.binary())
