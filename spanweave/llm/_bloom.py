"""Two Bloom filters of 64-bit hashes: seen once and seen twice, built in tasks and merged by blocks."""
from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spanweave.llm._store import merged_blocks, packed, release

PROBES = 3
BLOCK_BITS = 1 << 20


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return np.stack([(hashes + np.uint64(j) * step) & np.uint64(bits - 1) for j in range(PROBES)]).astype(np.int64)


def _set(bitmap: np.ndarray, places: np.ndarray) -> None:
    places = np.sort(places, axis=None)
    if len(places):
        byte = places >> 3
        first = np.flatnonzero(np.concatenate([[True], byte[1:] != byte[:-1]]))
        bitmap[byte[first]] |= np.bitwise_or.reduceat(np.left_shift(1, places & 7).astype(np.uint8), first)


def twice_filter(rows: DataFrame, hashes: Callable[[pa.RecordBatch], Iterable[np.ndarray]], bits: int, once_only: bool = False) -> np.ndarray:
    """Packed bits of the filter of hashes that occur twice or more in ``rows`` (or once); its size is ``bits / 8`` bytes.

    ``hashes`` turns a batch into arrays of 64-bit hashes. Merged with
    ``twice |= other.twice | (once & other.once)``: no repeated hash is ever
    missed, other hashes may be held.
    """
    block_bits = min(BLOCK_BITS, bits)
    half = block_bits // 8

    def build(batches):
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for h in hashes(batch):
                h, n = np.unique(h, return_counts=True)
                if len(h):
                    _set(twice, _places(h[(n > 1) | held(once, h)], bits))
                    _set(once, _places(h, bits))
        for b in np.flatnonzero(once.reshape(-1, half).any(axis=1)).tolist():
            payload = packed(np.concatenate([once[b * half:(b + 1) * half], twice[b * half:(b + 1) * half]]))
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([payload], pa.binary())], ["block", "payload"])
        del once, twice
        release()

    def fold(held, more):
        held[half:] |= more[half:] | (held[:half] & more[:half])
        held[:half] |= more[:half]

    blocks = merged_blocks(rows.mapInArrow(build, "block int, payload binary"), bits // block_bits, "uint8", 2 * half, fold)
    out = np.zeros(bits // 8, np.uint8)
    for b, x in blocks.items():
        out[b * half:(b + 1) * half] = x[:half] if once_only else x[half:]
    return out


def held(filter_bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes the filter holds."""
    at = _places(hashes, 8 * len(filter_bits))
    return ((filter_bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=0)
