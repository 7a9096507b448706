"""Words of an Arrow text column as arrays: where they lie and their 64-bit hashes, with no Python object for a word.

A word's hash is a polynomial over its bytes, each replaced by a random number, so all hashes of a slice come from one
running sum: (sum up to the word's end - sum up to its start) / base ^ start, modulo 2^64, where the odd base has an
inverse. A last multiplication mixes the bits.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed at a time, and bytes of the texts in a slice.
PIECE, SLICE = 1 << 18, 1 << 21
MIX = np.uint64(0x9E3779B97F4A7C15)
_random = np.random.default_rng(20240503)
BYTES = _random.integers(0, 1 << 64, 256, dtype=np.uint64)
BASE = int(_random.integers(0, 1 << 64, dtype=np.uint64)) | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32)) ^ np.uint64(seed)) * MIX
    x = (x ^ (x >> np.uint64(29))) * MIX
    return x ^ (x >> np.uint64(32))


def lowered(data: np.ndarray) -> np.ndarray:
    """LOWER of each byte, by arithmetic that is faster than a look-up."""
    return data | ((data - np.uint8(65)) < 26).view(np.uint8) << np.uint8(5)


def spaces(data: np.ndarray) -> np.ndarray:
    """SPACE of each byte."""
    return (data == 32) | (data - np.uint8(9) < 5)


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values in order; np.sort is much faster than np.unique here."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and its n + 1 offsets; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, places, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(places, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    bytes_ = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return bytes_, offsets - offsets[0]


def slices(column: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First and last row (exclusive), bytes and offsets of runs of rows with about so many bytes."""
    data, offsets = text_bytes(column)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; none reaches from one text into the next."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~(spaces(data) if space is SPACE else space[data])
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    full = np.flatnonzero(np.diff(offsets))
    start[offsets[full]] = inside[offsets[full]]
    end[offsets[full + 1] - 1] = inside[offsets[full + 1] - 1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


@functools.lru_cache(4)
def powers(base: int, bits: int) -> np.ndarray:
    """base ^ 0 to base ^ (2^bits - 1), modulo 2^64."""
    out, step = np.ones(1, np.uint64), base
    while len(out) < 1 << bits:
        out = np.concatenate([out, out * np.uint64(step)])
        step = step * step % (1 << 64)
    return out


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The words' hashes."""
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        at = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, at + PIECE, "right")))
        part = data[at : ends[j - 1]]
        bits = max(18, int(len(part)).bit_length())
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(BYTES[part] * powers(BASE, bits)[: len(part)], out=sums[1:])
        a, b = starts[i:j] - at, ends[i:j] - at
        out[i:j] = (sums[b] - sums[a]) * powers(INVERSE, bits)[a]
        i = j
    return mixed(out)
