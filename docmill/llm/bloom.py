"""Bloom filters for once-seen and twice-seen hashes, built over all partitions of a table.

Each task sets bits for the hashes it has and sends the filters in segments. Merging keeps a bit in the second
filter when two contributions set it, so that every hash contributed twice or more has all its bits there:
the filter has false positives, which a later exact step removes, and no false negatives.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docmill.llm.words import lean, mix

SEGMENT = 1 << 19
#: Bits of the largest filter (32 MB): the bound of what is broadcast. Past its capacity more hashes pass on to the exact step.
MOST_BITS = 1 << 28
LEAST_BITS = 1 << 21
_SALTS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def bits_for(expected: float, per_key: int = 16) -> int:
    """A power of two of bits for about ``expected`` hashes, within the bounds."""
    return int(min(MOST_BITS, max(LEAST_BITS, 1 << int(np.ceil(np.log2(max(2.0, expected * per_key)))))))


def _positions(hashes: np.ndarray, bits: int, probes: int) -> list[np.ndarray]:
    return [mix(hashes ^ np.uint64(s)) & np.uint64(bits - 1) for s in _SALTS[:probes]]


def contains(packed: np.ndarray, hashes: np.ndarray, probes: int = 2) -> np.ndarray:
    """Which hashes may be in the filter, as a boolean array."""
    found = np.ones(len(hashes), bool)
    for p in _positions(hashes, len(packed) * 8, probes):
        found &= (packed[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return found


def _packed(at: np.ndarray) -> np.ndarray:
    flat = np.zeros(SEGMENT, np.uint8)
    flat[at] = 1
    return np.packbits(flat, bitorder="little")


def _segments(hashes: np.ndarray, bits: int, probes: int) -> Iterator[tuple[int, bytes, bytes]]:
    found, counts = np.unique(np.concatenate(_positions(hashes, bits, probes)), return_counts=True)
    segment = (found // np.uint64(SEGMENT)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(segment)) + 1
    for at, times in zip(np.split(found, cuts), np.split(counts, cuts), strict=True):
        if len(at):
            inner = (at % np.uint64(SEGMENT)).astype(np.int64)
            yield int(at[0]) // SEGMENT, zlib.compress(_packed(inner), 1), zlib.compress(_packed(inner[times > 1]), 1)


_SCHEMA = pa.schema([("segment", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])


def build(table: DataFrame, hashes_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int, which: str = "twice", probes: int = 2) -> np.ndarray:
    """The filter (``once`` or ``twice``) of the hashes that ``hashes_of`` yields for each Arrow batch of ``table``.

    A hash counts as often as it is yielded. The filter has ``bits`` bits, whatever the table's size.
    """

    def partial(batches):
        held, size = [], 0

        def flush():
            rows = list(zip(*_segments(np.concatenate(held), bits, probes), strict=True)) or [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(r, t.type) for r, t in zip(rows, _SCHEMA, strict=True)], schema=_SCHEMA)

        for batch in batches:
            for hashes in hashes_of(batch):
                held.append(hashes)
                size += len(hashes)
                if size > 1 << 21:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    def merge(batches):
        at, once, twice = -1, None, None

        def out():
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([zlib.compress(once, 1)], pa.binary()), pa.array([zlib.compress(twice, 1)], pa.binary())], schema=_SCHEMA)

        for batch in batches:
            for row in batch.to_pylist():
                a, b = (np.frombuffer(zlib.decompress(row[c]), np.uint8) for c in ("once", "twice"))
                if row["segment"] != at:
                    if at >= 0:
                        yield out()
                    at, once, twice = row["segment"], a.copy(), b.copy()
                else:
                    twice |= b
                    twice |= once & a
                    once |= a
        if at >= 0:
            yield out()

    schema = "segment int, once binary, twice binary"
    merged = table.mapInArrow(lean(partial), schema).repartition("segment").sortWithinPartitions("segment").mapInArrow(lean(merge), schema)
    out = np.zeros(bits // 8, np.uint8)
    for row in merged.select("segment", which).toLocalIterator():
        lo = row["segment"] * SEGMENT // 8
        piece = np.frombuffer(zlib.decompress(bytes(row[which])), np.uint8)
        out[lo : lo + len(piece)] = piece
    return out


def contains_one(packed: np.ndarray, hashed: int, probes: int = 2) -> bool:
    """As :func:`contains`, for one hash."""
    for salt in _SALTS[:probes]:
        x = hashed ^ salt
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
        x = (x ^ x >> 27) * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF
        p = (x ^ x >> 31) & (len(packed) * 8 - 1)
        if not packed[p >> 3] >> (p & 7) & 1:
            return False
    return True
