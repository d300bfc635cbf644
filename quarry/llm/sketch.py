"""Fixed-size counts of hash values over a whole table.

64-bit hashes fall into ``2**SLOT_BITS`` slots by their top bits. Tasks sort
what they meet and send, per shard of slots, the sorted differences as byte
planes (small numbers, so the shuffle's compression takes them to about a byte
a value). Reducers add one shard at a time. Only one bit per slot comes back:
8 MB for any input, which is what is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SLOT_BITS = 26
SHARDS = 256
FLUSH = 1 << 22


def slot_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.uint32)


def has_bit(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slots = slot_of(hashes)
    return (bits[slots >> np.uint32(3)] >> (np.uint8(7) - (slots & np.uint32(7)).astype(np.uint8)) & 1).astype(bool)


def _sent(values: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    slots = np.sort(slot_of(np.concatenate(values)))
    width = 1 << (SLOT_BITS - SHARDS.bit_length() + 1)
    bounds = np.searchsorted(slots, np.arange(SHARDS + 1, dtype=np.int64) * width)
    shards, blobs = [], []
    for s in range(SHARDS):
        own = slots[bounds[s]:bounds[s + 1]]
        if len(own):
            steps = np.diff(own - np.uint32(s * width), prepend=np.uint32(0)).astype(np.uint32)
            shards.append(s)
            blobs.append(steps.view(np.uint8).reshape(-1, 4).T.tobytes())
    yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(blobs, pa.binary())], ["shard", "steps"])


def slot_bits(df: DataFrame, hashes: Callable[[pa.RecordBatch], Iterable[np.ndarray]],
              frequent: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Bit per slot, packed: ``frequent(counts of a shard's slots)``."""
    width = 1 << (SLOT_BITS - SHARDS.bit_length() + 1)

    def send(batches):
        held, n = [], 0
        for batch in batches:
            for values in hashes(batch):
                held.append(values)
                n += len(values)
                if n >= FLUSH:
                    yield from _sent(held)
                    held, n = [], 0
        if n:
            yield from _sent(held)

    def add(batches):
        at, counts = None, None

        def done():
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array(
                [np.packbits(frequent(counts)).tobytes()], pa.binary())], ["shard", "bits"])

        for batch in batches:
            for s, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if s != at:
                    if at is not None:
                        yield done()
                    at, counts = s, np.zeros(width, dtype=np.int64)
                planes = np.frombuffer(blob, dtype=np.uint8).reshape(4, -1)
                slots = np.cumsum(np.ascontiguousarray(planes.T).view(np.uint32).ravel(), dtype=np.int64)
                counts += np.bincount(slots, minlength=width)
        if at is not None:
            yield done()

    sent = df.mapInArrow(send, "shard int, steps binary")
    found = sent.repartition("shard").sortWithinPartitions("shard").mapInArrow(add, "shard int, bits binary")
    bits = np.zeros((SHARDS, width // 8), dtype=np.uint8)
    for row in found.collect():  # 8 MB in all
        bits[row["shard"]] = np.frombuffer(bytes(row["bits"]), dtype=np.uint8)
    return bits.ravel()
