"""Words and word n-grams of a batch of texts as 64-bit hashes, computed on the bytes of an Arrow column with numpy.

A word is a maximal run of bytes outside ASCII white space; its hash takes the word's bytes eight at a time, each block
mixed into the value so far, and its length; words over LONG_WORD bytes take a cryptographic digest instead. Work goes in blocks of about
BLOCK bytes, cut at white space, so memory follows the block and a long text needs no more than its words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

BLOCK, ROWS_BYTES, LONG_WORD = 1 << 20, 4 << 20, 1024
_RANDOM = np.random.default_rng(20240229)
_SEED = _RANDOM.integers(0, 1 << 64, 2, dtype=np.uint64)
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_GRAM = _RANDOM.integers(0, 1 << 64, 64, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of the bytes of each span."""
    size = end - start
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    at_byte = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each byte on
    h = mix(size.astype(np.uint64) ^ _SEED[0])
    left, at, done = np.arange(len(start)), start, 0
    while len(left):
        part = at_byte[at] & _FIRST_BYTES[np.minimum(size[left] - done, 8)]
        h[left] = mix((h[left] ^ part) + _SEED[1])
        done += 8
        goes_on = (size[left] > done) & (size[left] <= LONG_WORD)
        left, at = left[goes_on], at[goes_on] + 8
    for k in np.flatnonzero(size > LONG_WORD):
        h[k] = int.from_bytes(hashlib.blake2b(data[start[k]:end[k]].tobytes(), digest_size=8).digest(), "little")
    return h


class Words(NamedTuple):
    """The words of some rows: their hashes and byte offsets, and for row r the words first[r] to first[r + 1]."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    data: np.ndarray


def row_chunks(column: pa.Array, limit: int = ROWS_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) of runs of rows of at most ``limit`` bytes, or of one longer row."""
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offs = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, j, data[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
        i = j


def words(data: np.ndarray, offs: np.ndarray, lower: bool = False) -> Words:
    if lower:
        data = _LOWER[data]
    hashes, starts, ends = [], [], []
    at, n = 0, len(data)
    while at < n:
        to = min(n, at + BLOCK)
        if to < n:  # on to the next white space, or to the end of the text
            row_end = int(offs[np.searchsorted(offs, to, "left")])
            step = 4096
            while to < row_end:
                gap = np.flatnonzero(_SPACE[data[to:min(to + step, row_end)]])
                if len(gap):
                    to += int(gap[0])
                    break
                to, step = min(to + step, row_end), 2 * step
        part = data[at:to]
        word = ~_SPACE[part]
        begin, stop = word.copy(), word.copy()
        begin[1:] &= ~word[:-1]
        stop[:-1] &= ~word[1:]
        cuts = offs[(offs > at) & (offs < to)] - at
        begin[cuts] = word[cuts]
        stop[cuts - 1] = word[cuts - 1]
        s, e = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        hashes.append(hash_spans(part, s, e))
        starts.append(s + at)
        ends.append(e + at)
        at = to
    if not hashes:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), none, none, np.zeros(len(offs), np.int64), data)
    start = np.concatenate(starts)
    return Words(np.concatenate(hashes), start, np.concatenate(ends), np.searchsorted(start, offs, "left"), data)


def again(row: np.ndarray, key: np.ndarray, rows: int) -> np.ndarray:
    """How many keys of each row occurred before in it (by as many bits as the row number leaves)."""
    bits = np.uint64(max(1, rows).bit_length())
    both = np.sort(row.astype(np.uint64) << (np.uint64(64) - bits) | key >> bits)
    same = both[1:][both[1:] == both[:-1]] >> (np.uint64(64) - bits)
    return np.bincount(same.astype(np.int64), minlength=rows)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` values; one shorter sequence counts as a whole, none as nothing."""
    m = min(n, len(h))
    if not m:
        return h
    total = np.full(len(h) - m + 1, np.uint64(m))
    for k in range(m):
        total += h[k:len(h) - m + 1 + k] * _GRAM[k]
    return mix(total)
