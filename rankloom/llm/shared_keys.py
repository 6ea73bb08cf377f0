"""Which 64-bit keys occur often in a corpus: exact counts by hash slices, kept as tables of a checked size."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import small_batches, stored
from rankloom.llm.hashing import sized

LEAST_BITS, MOST_BITS, HEAVY_BITS = 20, 30, 22
KEYS_OF_SLICE = 1_000_000
MOST_SLICES = 1 << 16


@dataclass(frozen=True)
class SharedKeys:
    """Answers for keys by their upper bits.

    `bitmap` has a bit for every value of a key's upper `bits` bits, set where some key occurs twice or more; `heavy`
    has a byte for every value of the upper HEAVY_BITS bits, the largest binary logarithm of a count there. Both err
    to the frequent side only: a key whose bit is not set occurs once. `bits` follows the number of keys up to
    MOST_BITS (128 MB); a corpus beyond that has more keys wrongly taken for frequent, which costs time in the
    operators that use this, never results.
    """

    bits: int
    bitmap: np.ndarray
    heavy: np.ndarray

    def repeated(self, keys: np.ndarray) -> np.ndarray:
        at = keys >> np.uint64(64 - self.bits)
        return (self.bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 != 0

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """0 for keys that occur once; else 1 or the binary logarithm of the count, whichever is larger."""
        heavy = self.heavy[keys >> np.uint64(64 - HEAVY_BITS)]
        return np.where(self.repeated(keys), np.maximum(heavy, 1), 0).astype(np.uint8)


def slice_rows(keys: np.ndarray, slice_bits: int) -> pa.RecordBatch:
    """Keys of one batch (repeats allowed) as one row for each hash slice: the 32 bits after the slice's, counted.

    Differences of sorted values are stored byte plane by byte plane, so the shuffle's compression halves them. A
    key that repeats in the batch is one entry with a count, so hot keys are summed before the shuffle.
    """
    keys, counts = np.unique(keys, return_counts=True)
    edges = np.searchsorted(keys, np.arange(1 << slice_bits, dtype=np.uint64) << np.uint64(64 - slice_bits))
    edges = np.append(edges, len(keys))
    rows = []
    for s in np.flatnonzero(np.diff(edges)).tolist():
        a, b = edges[s], edges[s + 1]
        part = ((keys[a:b] << np.uint64(slice_bits)) >> np.uint64(32)).astype(np.uint32)
        steps = np.diff(part, prepend=np.uint32(0)).astype("<u4")
        rows.append((s, steps.view(np.uint8).reshape(-1, 4).T.tobytes(), np.minimum(counts[a:b], 65535).astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes()))
    cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], names=["slice", "steps", "counts"])


def planes(raw: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(kind).ravel()


def shared_keys(texts: DataFrame, keys_of: Callable[[pa.Array], np.ndarray], n_keys: int, chunk: int) -> SharedKeys:
    """Count the keys of all rows of a one-column table of texts.

    keys_of gives the keys of an Arrow array of about `chunk` bytes of texts, each key once for a text; n_keys: about
    how many keys there are. Every slice of the hash range is counted exactly by one task, which holds about
    KEYS_OF_SLICE keys; the driver gets only the finished tables. Of more than KEYS_OF_SLICE * MOST_SLICES keys
    (6.5 * 10**10, some 0.4 TB of text for words) no bitmap of a bounded size could tell which are single: all are then
    answered as repeated, which sends more of them through the exact joins behind, and only the levels of frequent
    keys, which order the work, come from every second, fourth, ... text by hash, scaled up. So tasks stay within
    their memory at every size.
    """
    small_batches(texts.sparkSession)
    bits = min(MOST_BITS, max(LEAST_BITS, int(n_keys).bit_length()))
    most = KEYS_OF_SLICE * MOST_SLICES
    every = 1 << max(0, int(n_keys // most).bit_length())  # one text of so many is counted
    if every > 1:
        texts = texts.where(F.pmod(F.xxhash64(texts.columns[0]), F.lit(every)) == 0)
    slice_bits = min(MOST_SLICES.bit_length() - 1, max(6, int(n_keys // every // KEYS_OF_SLICE).bit_length()))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in sized(batches, 0, chunk):  # gives memory back at its end
            held.append(keys_of(batch.column(0)))
            size += len(held[-1])
            if size > KEYS_OF_SLICE:
                yield slice_rows(np.concatenate(held), slice_bits)
                held, size = [], 0
        if size:
            yield slice_rows(np.concatenate(held), slice_bits)

    def count(group: pa.Table) -> pa.Table:
        s = group.column("slice")[0].as_py()
        keys = np.concatenate([np.cumsum(planes(r, "<u4"), dtype=np.uint32) for r in group.column("steps").to_pylist()])
        counts = np.concatenate([planes(r, "<u2") for r in group.column("counts").to_pylist()]).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.diff(keys, prepend=keys[0] ^ np.uint32(1)))
        keys, counts = keys[first], np.add.reduceat(counts, first)
        keys, counts = keys[counts > 1], counts[counts > 1]
        flags = np.zeros(1 << (bits - slice_bits), np.uint8)
        flags[keys >> np.uint32(32 - bits + slice_bits)] = 1
        packed = np.packbits(flags, bitorder="little").tobytes()
        heavy = np.zeros(1 << max(0, HEAVY_BITS - slice_bits), np.uint8)
        np.maximum.at(heavy, keys >> np.uint32(32 - HEAVY_BITS + slice_bits), np.log2(counts).astype(np.uint8))
        return pa.table({"slice": pa.array([s], pa.int32()), "bitmap": pa.array([packed], pa.binary()), "heavy": pa.array([heavy.tobytes()], pa.binary())})

    rows = texts.mapInArrow(emit, "slice int, steps binary, counts binary")
    tables = rows.groupBy("slice").applyInArrow(count, "slice int, bitmap binary, heavy binary")
    bitmap, heavy = np.zeros(1 << (bits - 3), np.uint8), np.zeros(1 << HEAVY_BITS, np.uint8)
    for row in stored(tables, "slices").toLocalIterator():  # counted by all executors, then fetched one by one
        part, loud = np.frombuffer(row["bitmap"], np.uint8), np.frombuffer(row["heavy"], np.uint8)
        bitmap[row["slice"] * len(part) : (row["slice"] + 1) * len(part)] = part
        heavy[row["slice"] * len(loud) : (row["slice"] + 1) * len(loud)] = loud
    if every > 1:
        bitmap[:] = 255
        heavy[heavy > 0] += np.uint8(every.bit_length() - 1)
    return SharedKeys(bits, bitmap, heavy)
