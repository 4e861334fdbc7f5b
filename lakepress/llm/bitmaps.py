"""Bitmaps of key sets: of bounded size at any number of keys, and no key is ever missed.

A bitmap is made in Spark from a table of 64-bit keys, collected by its parts, and sent to all tasks. It only saves
rows from being moved: what passes it is joined with the keys themselves.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .wordhash import mix

#: So many bits for each key, up to a bound of 2 ** MOST_BITS; each key sets PROBES of them.
BITS_A_KEY, MOST_BITS, CHUNK_BITS, PROBES = 256, 27, 16, 4


def probe(key: np.ndarray, bits: int, k: int) -> np.ndarray:
    """The k-th bit of each key in the bitmap."""
    return (mix(key ^ np.uint64(k * 0x2545F4914F6CDD1D & (1 << 64) - 1)) >> np.uint64(64 - bits)).astype(np.int64)


def _probed(bits: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = b.column("key").to_numpy().view(np.uint64)
            at = np.concatenate([probe(key, bits, k) for k in range(PROBES)])
            yield pa.RecordBatch.from_arrays([pa.array((at >> CHUNK_BITS).astype(np.int32)), pa.array((at & ((1 << CHUNK_BITS) - 1)).astype(np.int32))], names=["chunk", "bit"])

    return run


def _packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sets: dict[int, np.ndarray] = {}
    for b in batches:
        chunk, bit = b.column("chunk").to_numpy(), b.column("bit").to_numpy()
        for k in np.unique(chunk).tolist():
            sets.setdefault(k, np.zeros(1 << CHUNK_BITS, bool))[bit[chunk == k]] = True
    for k, x in sets.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(x).tobytes()], pa.binary())], names=["chunk", "bits"])


def bitmap(table: DataFrame, n: int) -> tuple[int, bytes]:
    """(bits, packed bitmap) of the n keys of table; at most 2 ** MOST_BITS bits at any size."""
    bits = min(MOST_BITS, max(CHUNK_BITS, (BITS_A_KEY * n).bit_length()))
    out, width = bytearray(1 << (bits - 3)), 1 << (CHUNK_BITS - 3)
    parts = table.select("key").mapInArrow(_probed(bits), "chunk int, bit int").repartition("chunk").mapInArrow(_packed, "chunk int, bits binary")
    for r in parts.toLocalIterator():
        out[r.chunk * width : (r.chunk + 1) * width] = r.bits
    return bits, bytes(out)


def within(keys: np.ndarray, bits: int, packed: np.ndarray) -> np.ndarray:
    """Places of the keys whose bits are all set; packed as bytes."""
    at = np.arange(len(keys))
    for k in range(PROBES):
        p = probe(keys[at], bits, k)
        at = at[(packed[p >> 3] >> (7 - (p & 7))) & 1 == 1]
    return at
