"""Vectorised word and shingle hashing for Arrow batches (runs inside Spark tasks).

Words are maximal runs of bytes outside space and 0x09-0x0D. A word's hash is
a polynomial over a fixed random table of byte values, finished with an
avalanche step; with 64 bits, two different words of one comparison meet with
a chance of about 2**-64. Work is done in byte segments, so the memory beyond
the text itself is bounded for texts of any length.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEGMENT_BYTES = 1 << 20
_U = np.uint64
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_COEF = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * _U(2) + _U(1)
_P = 0x9E3779B97F4A7C15
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, SEGMENT_BYTES + 4096)
        inv = pow(_P, -1, 2**64)
        _powers[:] = [np.multiply.accumulate(np.full(size, _U(x))) for x in (_P, inv)]
    return _powers[0], _powers[1]


def mix64(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values (a bijection)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def words(data: np.ndarray, offsets: np.ndarray, sep: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the index of its first word (n + 1 entries)."""
    gap = np.ones(len(data) + 1, bool)
    np.take(sep, data, out=gap[:-1])
    begins = ~gap[:-1]
    ends = begins.copy()
    begins[1:] &= gap[:-2]
    ends &= gap[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    begins[inner] |= ~gap[inner]
    ends[inner - 1] |= ~gap[inner - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SEGMENT_BYTES, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        power, inverse = _power_tables(hi - lo)
        piece = data[lo:hi]
        run = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_BYTE[LOWER[piece] if lower else piece] * power[:hi - lo], out=run[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix64((run[e] - run[s]) * inverse[s] + (e - s).astype(np.uint64) * _COEF[63])
        i = j
    return out


def shingle_sets(column: pa.Array, k: int, whole: bool = True) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its ``k``-word shingles (A-Z lower-cased).

    Rows with fewer words give their whole sequence as one shingle if
    ``whole``, else nothing; rows without words give an empty array.
    """
    hashes, first = text_shingles(column, k)
    out = []
    for seq, n in zip(hashes, np.diff(first)):
        out.append(np.unique(seq) if n >= k or whole else seq[:0])
    return out


def text_shingles(column: pa.Array, k: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each row its shingle hashes in text order, and the word index of each row's start."""
    data, offsets = utf8(column)
    starts, ends, first = words(data, offsets)
    return shingles(word_hashes(data, starts, ends), first, k), first


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> list[np.ndarray]:
    """Shingle hashes of each row of word hashes; a row of 1 to k-1 words gives one for its whole sequence."""
    n = len(hashes) - k + 1
    if n > 0:
        rolled = hashes[:n] * _COEF[0]
        for j in range(1, k):
            rolled += hashes[j:n + j] * _COEF[j]
        rolled = mix64(rolled)
    else:
        rolled = hashes[:0]
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            out.append(rolled[a:b - k + 1])
        elif b > a:
            short = (hashes[a:b] * _COEF[:b - a]).sum(dtype=np.uint64, keepdims=True)
            out.append(mix64(short + _COEF[32 + (b - a) % 30]))
        else:
            out.append(hashes[:0])
    return out


def row_ranges(column: pa.Array, limit: int = 1 << 22):
    """Row ranges ``(from, to)`` of a string column with at most ``limit`` bytes each (one row at least)."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)) if len(column) else []
    lo = 0
    while lo < len(column):
        done = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield lo, hi
        lo = hi
