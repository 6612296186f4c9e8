"""Bloom filters of a size that is chosen from a count and bounded by a parameter, kept as numpy bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean

PROBES = 4
#: Filters have 2^16 bits at least, and are merged in so many segments.
LEAST_BITS, SEGMENTS = 1 << 16, 64
#: No filter has more bits: 128 MB. Beyond some 10^8 entries more of what isn't in them passes, which costs work and never
#: changes a result.
MOST_BITS = 1 << 30


def bits_for(entries: int, most: int = MOST_BITS) -> int:
    """A power of two that gives each entry 10 bits at least, by which about 1 in 50 strangers passes; ``most`` at most."""
    return min(most, max(LEAST_BITS, 1 << max(0, 10 * entries - 1).bit_length()))


def positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """PROBES bit positions of each hash: (n, PROBES). The halves of the hash give the steps of double hashing."""
    a, b = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
    return (a[:, None] + b[:, None] * np.arange(1, PROBES + 1, dtype=np.uint64)) % np.uint64(bits)


def has(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether all positions of each row of ``at`` are set."""
    return ((table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def put(table: np.ndarray, at: np.ndarray) -> None:
    flat = at.ravel()
    np.bitwise_or.at(table, flat >> np.uint64(3), np.left_shift(1, (flat & np.uint64(7)).astype(np.uint8), dtype=np.uint8))


def of(hashes: DataFrame, bits: int, tasks: int | None = None) -> np.ndarray:
    """The filter of a one-column frame of 64-bit hashes: each of ``tasks`` tasks makes one, segments meet by their number."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            put(table, positions(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), bits))
        for k, part in enumerate(table.reshape(SEGMENTS, -1)):
            if part.any():
                yield pa.RecordBatch.from_pydict({"segment": pa.array([k], pa.int32()), "part": pa.array([part.tobytes()], pa.binary())})

    def join(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.zeros(bits // 8 // SEGMENTS, np.uint8)
        for part in parts:
            for x in part.column("part"):
                whole |= np.frombuffer(x.as_py(), np.uint8)
        yield pa.RecordBatch.from_pydict({"segment": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([whole.tobytes()], pa.binary())})

    made = hashes.coalesce(tasks or hashes.sparkSession.sparkContext.defaultParallelism).mapInArrow(lean(build), "segment int, part binary")
    table = np.zeros((SEGMENTS, bits // 8 // SEGMENTS), np.uint8)
    for segment, part in made.groupBy("segment").applyInArrow(join, "segment int, part binary").toLocalIterator():
        table[segment] = np.frombuffer(part, np.uint8)
    return table.ravel()


def known_in(hash_column: str, shared, bits: int) -> Column:
    """Whether the hash may be in the broadcast filter ``shared``. Only the hashes go through Python."""

    @F.arrow_udf("boolean")
    def known(hashes: pa.Array) -> pa.Array:
        return pa.array(has(np.frombuffer(shared.value, np.uint8), positions(hashes.to_numpy(zero_copy_only=False).view(np.uint64), bits)))

    return known(hash_column)
