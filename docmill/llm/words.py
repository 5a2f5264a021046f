"""Vectorised word splitting and hashing over batches of UTF-8 texts.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``. Hashes are 64-bit polynomials over the bytes
of a word (wrapping arithmetic, random byte table, final mixing), so that they do not depend on where the word
stands; window hashes are polynomials over word hashes. Work goes in pieces of bounded size, so that one very
long text needs eight bytes a word and not a multiple of its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from docmill.runtime import lean as lean

#: Bytes (words, for windows) handled at once: what fits the processor's cache is fastest.
PIECE = 1 << 18
BATCH = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_NOT_ALNUM = np.ones(256, bool)
_NOT_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, k, 1 << 64))])
        return self.up[:n], self.down[:n]


_POWERS = [_Powers(b) for b in _BASES]


def _runs(x: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
    """The polynomial of x[start:end] for each pair, as if it began at 0."""
    up, down = _POWERS[which].get(len(x) + 1)
    total = np.empty(len(x) + 1, np.uint64)
    total[0] = 0
    np.cumsum(x * up[: len(x)], out=total[1:])
    return (total[ends] - total[starts]) * down[starts]


def batches(texts: list[bytes], limit: int = BATCH) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``limit`` bytes, a longer text alone."""
    lo = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield lo, k
            lo, size = k, 0
        size += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts)


def hashed(texts: list[bytes], lower: bool = False, alnum: bool = False, prefixes: tuple[int, ...] = (), suffix: int = 0) -> tuple[np.ndarray, ...]:
    """(hash of every word, offsets): the words of text k are ``[offsets[k]:offsets[k + 1]]``.

    ``lower`` lower-cases A-Z; ``alnum`` takes every ASCII byte but letters and digits as a separator. For each
    number of bytes in ``prefixes`` an array follows: the hash of a word's beginning, 0 where the word isn't longer.
    With ``suffix``, the hash of the last so many bytes of each word follows.
    """
    joined = b"\n".join(texts)
    if lower:
        joined = joined.lower()
    lookup = _NOT_ALNUM if alnum else _SPACE
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=bounds[1:])
    out, at, starts_all, begun, ended = [], 0, [], [[] for _ in prefixes], []
    while at < len(joined):
        to = min(len(joined), at + PIECE)
        if to < len(joined):  # a piece ends at a separator
            gap = np.flatnonzero(lookup[np.frombuffer(joined, np.uint8, to - at, at)])
            while not len(gap) and to < len(joined):
                more = np.frombuffer(joined, np.uint8, min(PIECE, len(joined) - to), to)
                gap = np.flatnonzero(lookup[more])
                to += int(gap[0]) + 1 if len(gap) else len(more)
                gap = np.array([to - at - 1]) if len(gap) else gap
            if len(gap):
                to = at + int(gap[-1]) + 1
        buf = np.frombuffer(joined, np.uint8, to - at, at)
        edges = np.flatnonzero(np.diff(np.concatenate([[True], lookup[buf], [True]])))
        starts, ends = edges[::2], edges[1::2]
        values = _TABLE[buf]
        out.append(mix(_runs(values, starts, ends, 0) + (ends - starts).astype(np.uint64)))
        for k, found in zip(prefixes, begun, strict=True):
            longer = ends - starts > k
            part = np.zeros(len(starts), np.uint64)
            part[longer] = mix(_runs(values, starts[longer], starts[longer] + k, 0) ^ np.uint64(0xA5A5A5A5 + k))
            found.append(part)
        if suffix:
            ended.append(mix(_runs(values, np.maximum(starts, ends - suffix), ends, 0) ^ np.uint64(0x5EED5EED)))
        starts_all.append(starts + at)
        at = to
    words = np.concatenate(out) if out else np.zeros(0, np.uint64)
    starts = np.concatenate(starts_all) if starts_all else np.zeros(0, np.int64)
    none = np.zeros(0, np.uint64)
    return words, np.searchsorted(starts, bounds), *(np.concatenate(x) if x else none for x in begun), *([np.concatenate(ended) if ended else none] if suffix else [])


def windows(words: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """The hash of every window of k consecutive words; the result is k - 1 shorter than ``words``."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    out = np.empty(len(words) - k + 1, np.uint64)
    for lo in range(0, len(out), PIECE):
        part = words[lo : lo + PIECE + k - 1]
        at = np.arange(len(part) - k + 1)
        out[lo : lo + PIECE] = mix(_runs(part, at, at + k, which))
    return out


#: Bits of a hash that give way to a place, to find the first of equal minima.
LOW = np.uint64((1 << 24) - 1)


def minima(x: np.ndarray, n: int) -> np.ndarray:
    """The minimum of every n elements in a row."""
    span = 1
    while span * 2 <= n:
        x, span = np.minimum(x[:-span], x[span:]), span * 2
    return np.minimum(x[: len(x) - (n - span)], x[n - span :]) if n > span else x


def sequence(words: np.ndarray, which: int = 0) -> int:
    """One hash of a whole sequence and its length."""
    total = np.uint64(len(words))
    for lo in range(0, len(words), PIECE):
        part = words[lo : lo + PIECE]
        piece = _runs(part, np.array([0]), np.array([len(part)]), which)
        total = mix(np.array([total], np.uint64) + mix(piece))[0]
    return int(mix(np.array([total], np.uint64))[0])


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def as_bytes(column) -> list[bytes]:
    """A string column of an Arrow batch as UTF-8 bytes, null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if t is None else t for t in column.cast(kind).to_pylist()]
