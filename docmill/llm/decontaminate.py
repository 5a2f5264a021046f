"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

Words are lower-cased runs of letters and digits. A document leaks an item of L words if some stretch of it is within
k = floor((100 - percent) / 100 x L) word edits of the item.

- The Chakraborty-Goldenberg-Koucky random walk maps a window to strings of words whose Hamming distance follows the edit distance: step j
  writes the current word and moves on if a random bit of (j, word) is set. The walk from a place of a text doesn't depend on how
  long the window is, so one walk from each place embeds the windows of items of all sizes at once; ``WALKS`` walks of ``STEPS`` steps are taken.
- Bit sampling: each sample is ``SAMPLED`` steps of one walk, its key what the walk wrote there. The index holds the keys of each item's windows: an
  item of up to 16 words has one from each of its words to its end, a longer one 16 or more, evenly spaced and never more than ``PART`` words apart. Of the
  parts between them at least one has no more than its share of the edits, so recall doesn't fall with an item's length, as that
  of a single sample of a whole long item would.
- Every place of every text is probed with every sample, and items propose where their keys are met. The tests measure the share of leaks at the
  edit limit that the samples alone propose.
- A proposal is dropped unread only by an exact bound: a stretch at distance e holds at least L - e words of the item. What is left is settled
  by the exact edit distance to the best stretch around the proposal (Myers' bit-parallel rows). So whatever is reported is exact.

The items are the query set: they are brought to the executors in blocks of about ``block`` items of up to 16 windows (at most 2.5 KB of keys
each; longer items count as several), and all documents are held against each block in one pass, without a shuffle of texts.

Edge cases: null or empty texts and items match nothing. Items of fewer than five words have no edit to give, so they must stand there
exactly. Very long texts are walked in pieces, very long items verified in memory proportional to their length. Rows with the same id count
as one document (a null id too), items with the same id as one item, ties in the distance go to the first place. Empty tables give an empty
table. Other columns of either table don't matter, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.words import as_bytes, batches, hashed, lean, mix
from docmill.runtime import bounded_batches

WALKS, STEPS, SAMPLES, SAMPLED = 4, 12, 3, 4
#: Words between windows of a long item.
PART = 8
#: Log10 of how often chance may meet a key at a place of a text.
CHANCE = -9.0
#: Items (of up to 16 windows; longer ones count as more) on the executors at once.
BLOCK = 1 << 13
#: Places of a text that are walked at once.
PIECE = 1 << 15


def _draws(n: int, seed: int) -> list[int]:
    return mix(np.arange(n, dtype=np.uint64) + np.uint64(seed << 40)).tolist()


_BITS = (mix(np.arange(WALKS * STEPS, dtype=np.uint64) + np.uint64(1 << 32)) >> np.uint64(32)).astype(np.uint32).reshape(WALKS, STEPS) | np.uint32(1)


def samples() -> list[tuple[int, tuple[int, ...]]]:
    """(walk, steps): the samples of each walk, and last the first word alone, for items too short for any other. A sample's steps lie in the first half, the
    first two thirds or all of the walk, so that both short and long clean stretches are met."""
    out = []
    for w in range(WALKS):
        for s in range(SAMPLES):
            span = STEPS * (3 + s) // (2 + SAMPLES)
            order = sorted(range(span), key=lambda j, r=_draws(span, 7 + w * SAMPLES + s): r[j])
            out.append((w, tuple(sorted(order[:SAMPLED]))))
    return [*out, (0, (0,))]


SAMPLE_SET = samples()


def repetitions(differ: float, target: float) -> int:
    """Samples, so that strings that differ in a share ``differ`` of positions collide in one with probability ``target``."""
    return math.ceil(math.log(1 - target) / math.log(1 - (1 - differ) ** SAMPLED))


def walked(words: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """What each walk from places ``lo`` to ``hi`` writes at each step, and the offset it writes it from: walks x steps x places. ``words`` (32 bits) goes on for
    ``STEPS`` words after ``hi``."""
    n = hi - lo
    out, at = np.empty((WALKS, STEPS, n), np.uint32), np.empty((WALKS, STEPS, n), np.int8)
    for w in range(WALKS):
        place = np.arange(lo, hi)
        for j in range(STEPS):
            now = words[place]
            out[w, j] = now
            at[w, j] = place - np.arange(lo, hi)
            place += (now * _BITS[w, j] >> np.uint32(31)).astype(np.int64)
    return out, at


_FACTORS = mix(np.arange(SAMPLED, dtype=np.uint64) + np.uint64(3 << 40)) | np.uint64(1)


def _salts() -> np.ndarray:
    return mix(np.arange(len(SAMPLE_SET), dtype=np.uint64) + np.uint64(5 << 40))


def _keys(wrote: np.ndarray, sample: int) -> np.ndarray:
    """The keys of one sample at all places that were walked."""
    w, steps = SAMPLE_SET[sample]
    out = np.full(wrote.shape[2], _salts()[sample])
    for j, factor in zip(steps, _FACTORS):
        out += wrote[w, j] * factor
    return out


def _index_keys(own: np.ndarray, log_share: np.ndarray, repeat: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, start) of an item's windows: those samples that lie inside it, without those of words so common that any text has them; but ``repeat`` for every 64 words stay.

    ``log_share`` is the log10 of each word's share of all words of the items."""
    n = len(own)
    short = np.concatenate([(own >> np.uint64(32)).astype(np.uint32), np.zeros(STEPS, np.uint32)])
    wrote, at = walked(short, 0, n)
    starts = np.arange(0, n, min(PART, max(1, n // 16)))
    keys, places, chance = [], [], []
    for s, (w, steps) in enumerate(SAMPLE_SET[:-1]):
        inside = starts[starts + at[w, steps[-1]][starts] < n]
        keys.append(_keys(wrote, s)[inside])
        places.append(inside)
        # a word that the walk wrote several times counts once
        where = [inside + at[w, j][inside] for j in steps]
        chance.append(sum((log_share[x] * (x != y) for x, y in zip(where[1:], where, strict=False)), log_share[where[0]]))
    if not sum(map(len, keys)):
        return _keys(wrote, len(SAMPLE_SET) - 1)[:1], np.zeros(1, np.int64)
    keys, places, chance = (np.concatenate(x) for x in (keys, places, chance))
    order = np.argsort(chance, kind="stable")
    keep = order[: max(repeat * -(-n // 64), int((chance < CHANCE).sum()))]
    return keys[keep], places[keep]


def edit_search(item: list[int], text: list[int]) -> tuple[int, int]:
    """(smallest edit distance of ``item`` to any stretch of ``text``, where that stretch ends): Myers' bit-parallel rows."""
    size = len(item)
    masks: dict[int, int] = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    every, top = (1 << size) - 1, 1 << (size - 1)
    up, down, score = every, 0, size
    best = (size, 0)
    for j, w in enumerate(text):
        eq = masks.get(w, 0)
        x = eq | down
        zero = ((x & up) + up ^ up) | x
        plus, minus = down | ~(zero | up) & every, zero & up
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus, minus = plus << 1 & every, minus << 1 & every
        up, down = minus | ~(zero | plus) & every, plus & zero
        if score < best[0]:
            best = (score, j + 1)
    return best


def lowered(texts: list[bytes]) -> list[bytes]:
    """Texts in lower case, also beyond ASCII (whose letters are lower-cased when hashed)."""
    return [t if t.isascii() else t.decode().lower().encode() for t in texts]


class Items:
    """A block of items with the keys of their windows."""

    def __init__(self, ids: list[int], texts: list[bytes], percent: int, least_words: int = 1, target: float = 0.999):
        words, offsets = hashed(lowered(texts), lower=True, alnum=True)
        _, which, count = np.unique(words, return_inverse=True, return_counts=True)
        log_share = np.log10((count[which] + 0.5) / (len(words) + 1000))
        # the share of positions in which the best of an item's windows may differ, at 20 % edits
        self.repeat = repetitions(0.4, target)
        self.ids, self.words, keys, windows = [], [], [], []
        for i, item_id in enumerate(ids):
            own = words[offsets[i] : offsets[i + 1]]
            if len(own) >= max(1, least_words):
                key, start = _index_keys(own, log_share[offsets[i] : offsets[i + 1]], self.repeat)
                keys.append(key)
                windows.append(np.stack([np.full(len(key), len(self.ids)), start], 1).astype(np.int32))
                self.ids.append(item_id)
                self.words.append(own)
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.k = (100 - percent) * self.sizes // 100
        key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        order = np.argsort(key, kind="stable")
        self.key, self.window = key[order], (np.concatenate(windows) if keys else np.zeros((0, 2), np.int32))[order]
        # which words are whose: sorted hashes of (item, word)
        self.own = np.unique(np.concatenate([mix(w + mix(np.array([i], np.uint64))) for i, w in enumerate(self.words)])) if self.words else np.zeros(0, np.uint64)
        # whether an item is so short that only its first word alone is a key
        self.alone = any(len(k) == 1 for k in keys)
        self._filter = None

    def __getstate__(self):
        return self.__dict__ | {"_filter": None}

    def _maybe(self, key: np.ndarray) -> np.ndarray:
        """Indices of keys that may be in the index, by two bits of a table of 32 bits a key, made where it is first used."""
        if self._filter is None:
            bits = min(26, max(18, int(32 * len(self.key)).bit_length()))
            table = np.zeros(1 << bits, bool)
            shift = np.uint64(64 - bits)
            table[self.key >> shift] = True
            table[self.key * _FACTORS[0] >> shift] = True
            self._filter = table, shift
        table, shift = self._filter
        at = np.flatnonzero(table[key >> shift])
        return at[table[key[at] * _FACTORS[0] >> shift]]

    def proposals(self, words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows (place where the item would begin, item, document), distinct: where a sample of a text has a key of the index."""
        found = [np.zeros((0, 3), np.int64)]
        if not len(self.key):
            return found[0]
        short = np.concatenate([(words >> np.uint64(32)).astype(np.uint32), np.zeros(STEPS, np.uint32)])
        use = range(len(SAMPLE_SET) - (not self.alone))
        for lo in range(0, len(words), PIECE):
            hi = min(lo + PIECE, len(words))
            wrote = walked(short, lo, hi)[0]
            part = []
            for s in use:
                key = _keys(wrote, s)
                at = self._maybe(key)
                h = key[at]
                first = np.searchsorted(self.key, h)
                hit = self.key[np.minimum(first, len(self.key) - 1)] == h
                at, first, h = at[hit], first[hit], h[hit]
                n = np.searchsorted(self.key, h, "right") - first
                window = self.window[np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())]
                part.append(np.stack([lo + np.repeat(at, n) - window[:, 1], window[:, 0], np.repeat(at, n) + lo], 1))
            part = np.concatenate(part)
            part[:, 2] = np.searchsorted(offsets, part[:, 2], "right") - 1
            found.append(np.unique(part, axis=0))
        return np.unique(np.concatenate(found), axis=0)

    def held(self, words: np.ndarray, offsets: np.ndarray, seeds: np.ndarray) -> np.ndarray:
        """How many words around each proposal are words of its item: at most so many can be matched."""
        sizes, k = self.sizes[seeds[:, 1]], self.k[seeds[:, 1]]
        first = np.maximum(offsets[seeds[:, 2]], seeds[:, 0] - k)
        n = np.maximum(0, np.minimum(offsets[seeds[:, 2] + 1], seeds[:, 0] + sizes + k) - first)
        out, ends = np.zeros(len(seeds), np.int64), np.cumsum(n)
        lo = 0
        while lo < len(seeds):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + (1 << 20))))
            m = n[lo:hi]
            row = np.repeat(np.arange(hi - lo), m)
            at = np.arange(len(row)) - np.repeat(np.cumsum(m) - m, m) + first[lo:hi][row]
            key = mix(words[at] + mix(seeds[lo:hi, 1].astype(np.uint64))[row])
            found = self.own[np.minimum(np.searchsorted(self.own, key), len(self.own) - 1)] == key
            out[lo:hi] = np.bincount(row[found], minlength=hi - lo)
            lo = hi
        return out

    def leaks(self, texts: list[bytes]) -> list[tuple[int, int, int, int]]:
        """(text, item, distance, first word) for each leak, the best place of each."""
        words, offsets = hashed(lowered(texts), lower=True, alnum=True)
        seeds = self.proposals(words, offsets)
        seeds = seeds[self.held(words, offsets, seeds) >= (self.sizes - self.k)[seeds[:, 1]]] if len(seeds) else seeds
        best: dict[tuple[int, int], tuple[int, int]] = {}
        # proposals near each other are settled by one search over all their stretches, so that no word is read twice
        order = np.lexsort((seeds[:, 0], seeds[:, 1], seeds[:, 2]))
        start, item, doc = seeds[order].T
        new = np.ones(len(order), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (np.diff(start) > self.sizes[item[1:]])
        edges = np.append(np.flatnonzero(new), len(order))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            d, i = int(doc[a]), int(item[a])
            k, own = int(self.k[i]), self.words[i].tolist()
            first = max(int(offsets[d]), int(start[a]) - k)
            stretch = words[first : max(first, min(int(offsets[d + 1]), int(start[b - 1]) + len(own) + k))].tolist()
            distance, end = edit_search(own, stretch)
            if distance <= k:
                # where a stretch of this distance begins, read backwards
                back = edit_search(own[::-1], stretch[:end][::-1])[1]
                now = (distance, first + end - back - int(offsets[d]))
                best[d, i] = min(best.get((d, i), now), now)
        return [(d, item, *v) for (d, item), v in sorted(best.items())]


def contamination(docs: DataFrame, benchmark: DataFrame, percent: int = 80, least_words: int = 1, target: float = 0.999, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, distance, first_word): each document and item it leaks, once."""
    spark = docs.sparkSession
    bounded_batches(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    # an item of more than 16 windows, by its length in characters, counts as several
    most = F.greatest(F.lit(1), F.ceil(F.length("text") / F.lit(2 * 16 * PART)))
    blocks = max(1, math.ceil((items.agg(F.sum(most)).first()[0] or 0) / block))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for b in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        shared = spark.sparkContext.broadcast(Items([r["item_id"] for r in mine], [r["text"].encode() for r in mine], percent, least_words, target))

        def search(parts, shared=shared):
            for batch in parts:
                texts, ids = as_bytes(batch.column("text")), batch.column("doc_id").to_pylist()
                rows = []
                for lo, hi in batches(texts, 1 << 22):
                    rows += [(ids[lo + d], shared.value.ids[i], distance, first) for d, i, distance, first in shared.value.leaks(texts[lo:hi])]
                columns = list(zip(*rows, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "distance", "first_word"])

        found = slim.mapInArrow(lean(search), "doc_id long, item_id long, distance long, first_word long")
        out = found if out is None else out.unionByName(found)
    best = F.min(F.struct("distance", "first_word"))
    return out.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.distance", "b.first_word")


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
