"""A count sketch of bounded size over hashes of a whole table: one row of counters."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docmill.llm.words import lean

SEGMENT = 1 << 15
#: Counters (8 bytes each) of a sketch; the bound of what is broadcast.
WIDTH = 1 << 21


def slots(hashes: np.ndarray) -> np.ndarray:
    return ((hashes >> np.uint64(20)) & np.uint64(WIDTH - 1)).astype(np.int64)


class Counters:
    """The counters of one task: 32 bits each; before one would overflow, all go out and begin again at 0. Sums over tasks have 64 bits."""

    def __init__(self, width: int = WIDTH, most: int = 0xFFFFFFFF):
        self.total, self.most, self.full = np.zeros(-(-width // SEGMENT) * SEGMENT, np.uint32), most, []

    def add(self, at: np.ndarray) -> None:
        found, counts = np.unique(at, return_counts=True)
        after = self.total[found].astype(np.int64) + counts
        if len(found) and after.max() > self.most:
            self.full += self._payloads()
            self.total[:] = 0
            after = counts
        self.total[found] = after

    def _payloads(self) -> list[tuple[int, bytes]]:
        pieces = self.total.reshape(-1, SEGMENT)
        return [(k, zlib.compress(pieces[k].astype(np.uint64).tobytes(), 1)) for k in np.flatnonzero(pieces.any(1)).tolist()]

    def segments(self) -> Iterator[tuple[int, bytes]]:
        yield from self.full
        yield from self._payloads()


def summed(table: DataFrame, width: int = WIDTH) -> np.ndarray:
    """The sum of the counters in ``table`` (segment, counts), in 64 bits, segment by segment, in memory of one segment."""
    schema = pa.schema([("segment", pa.int32()), ("counts", pa.binary())])

    def row(segment, total):
        return pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], schema=schema)

    def merge(parts):
        at, total = -1, None
        for batch in parts:
            for r in batch.to_pylist():
                piece = np.frombuffer(zlib.decompress(r["counts"]), np.uint64)
                if r["segment"] != at:
                    if at >= 0:
                        yield row(at, total)
                    at, total = r["segment"], piece
                else:
                    total = total + piece
        if at >= 0:
            yield row(at, total)

    merged = table.repartition("segment").sortWithinPartitions("segment").mapInArrow(lean(merge), "segment int, counts binary")
    out = np.zeros(-(-width // SEGMENT) * SEGMENT, np.uint64)
    for r in merged.toLocalIterator():
        lo = r["segment"] * SEGMENT
        out[lo : lo + SEGMENT] = np.frombuffer(zlib.decompress(bytes(r["counts"])), np.uint64)
    return out[:width]


def count_sketch(table: DataFrame, slots_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], width: int = WIDTH) -> np.ndarray:
    """How often ``slots_of`` names each of ``width`` counters, over all of ``table``."""

    def partial(parts):
        own = Counters(width)
        for batch in parts:
            held = list(slots_of(batch))
            if held:
                own.add(np.concatenate(held))
        for k, payload in own.segments():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([payload], pa.binary())], names=["segment", "counts"])

    return summed(table.mapInArrow(lean(partial), "segment int, counts binary"), width)
