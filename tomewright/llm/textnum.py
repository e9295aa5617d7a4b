"""Vectorised tokenising and hashing of Arrow string batches with numpy.

A whole batch is handled as one byte buffer: words are found from a byte table, and their 64-bit hashes
come from one prefix sum of a polynomial over the buffer, so no Python code runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Odd multiplier of the polynomial word hash, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)
#: A piece of a batch that is hashed at once holds about so many bytes (one longer text is a piece alone).
PIECE_BYTES = 2_000_000

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words(NamedTuple):
    """Words of several texts: text i has words first[i]:first[i + 1]."""

    hashes: np.ndarray  # uint64 by word
    first: np.ndarray  # int64, texts + 1
    starts: np.ndarray  # byte offsets into data
    ends: np.ndarray
    data: np.ndarray  # uint8
    bounds: np.ndarray  # byte offsets of texts into data, texts + 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, np.ndarray] = {}


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base**0 to base**(n - 1), modulo 2**64; one growing table a base is kept."""
    if len(_POWERS.get(base, ())) < n:
        out = np.full(1 << max(12, int(n - 1).bit_length()), base, np.uint64)
        out[0] = 1
        _POWERS[base] = np.multiply.accumulate(out)
    return _POWERS[base][:n] if n else np.zeros(0, np.uint64)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an array of strings or binaries; nulls are empty."""
    binary = pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type)
    if texts.null_count:
        texts = texts.fill_null(b"" if binary else "")
    if texts.type not in (pa.large_string(), pa.large_binary()):
        texts = texts.cast(pa.large_binary() if binary else pa.large_string())
    n, at = len(texts), texts.offset
    _, offsets, data = texts.buffers()
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(offsets, np.int64)[at : at + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def pieces(data: np.ndarray, bounds: np.ndarray, most: int = PIECE_BYTES, texts: int = 1 << 40) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes, and of at most ``texts`` texts, each."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + most, "right")) - 1)
        yield i, min(j, n, i + texts)
        i = min(j, i + texts)


def word_bounds(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and the number of each text's first word."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    edges = bounds[(bounds > 0) & (bounds < len(data))]
    begins[edges] = inside[edges]
    stops[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def tokenise(data: np.ndarray, bounds: np.ndarray, lower: bool = False) -> Words:
    """Words of the texts that bounds cuts data into, with a 64-bit hash each."""
    bounds = bounds - bounds[0]
    if lower:
        data = _LOWER[data]
    starts, ends, first = word_bounds(data, bounds)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data)), out=sums[1:])
    h = (sums[ends] - sums[starts]) * powers(len(data) + 1, BASE_INV)[starts]
    return Words(mix(h + (ends - starts).astype(np.uint64)), first, starts, ends, data, bounds)


def token_pieces(texts: pa.Array, lower: bool = False, most: int = PIECE_BYTES) -> Iterator[tuple[int, int, Words]]:
    """Words of a batch, piece by piece: first and last text of the piece, and its words."""
    data, bounds = buffers(texts)
    for i, j in pieces(data, bounds, most):
        yield i, j, tokenise(data[bounds[i] : bounds[j]], bounds[i : j + 1], lower)


def window_hashes(hashes: np.ndarray, size: int, base: int = BASE) -> np.ndarray:
    """Hash of every ``size`` consecutive word hashes, by one rolling polynomial over the sequence."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(len(hashes), base), out=sums[1:])
    return mix((sums[size:] - sums[:n]) * powers(n, pow(base, -1, 1 << 64)))


def span_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASE) -> np.ndarray:
    """Hash of the word sequences hashes[starts:ends], each of any length."""
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(len(hashes), base), out=sums[1:])
    h = (sums[ends] - sums[starts]) * powers(len(hashes) + 1, pow(base, -1, 1 << 64))[starts]
    return mix(h + (ends - starts).astype(np.uint64))


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the byte strings data[starts:ends]."""
    return span_hashes(data.astype(np.uint64) + np.uint64(1), starts, ends)


def code_points(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Code points of UTF-8 in data[starts:ends]."""
    sums = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=sums[1:])
    return sums[ends] - sums[starts]


def repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur at least twice, and which have occurred before."""
    twice, before = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    if len(keys) > 1:
        order = np.argsort(keys)
        same = keys[order[1:]] == keys[order[:-1]]
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        before |= twice
        at = np.flatnonzero(np.r_[True, ~same])
        before[np.minimum.reduceat(order, at)] = False
    return twice, before


def covered(marks: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n words lie in a marked window of ``size`` words, by the windows' first words."""
    depth = np.zeros(n + 1, np.int32)
    depth[: len(marks)] += marks
    depth[size : size + len(marks)] -= marks
    return np.cumsum(depth[:n]) > 0


def sums_by(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of the values of each text's words."""
    out = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=out[1:])
    return out[first[1:]] - out[first[:-1]]


def owners(first: np.ndarray) -> np.ndarray:
    """For each word the number of its text."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
