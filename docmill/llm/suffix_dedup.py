"""Substring deduplication over bytes with a sparse suffix array that is range-partitioned by sampled splitters.

A window is ``length`` consecutive bytes of one document. Every byte of a window that also starts earlier (in a document with a smaller id, or
before in the same one) goes. Suffixes of all bytes would be a hundred times the input, so those are sorted that any repeat must go through:

1. Anchors. Each window has one anchor, the place within it whose ``length - 63`` bytes have the smallest hash (the leftmost of these), a function of
   its bytes alone. Equal windows have equal anchors at the same place; one place in 32 is an anchor. Hashes that occur at one place only, of a text
   or of its exact copies, are counted out by an aggregate; their windows can't repeat. No filter of fixed size is in the way, so that holds at any scale.
2. Suffixes. What is left goes on as its context: the bytes from the anchor to the end of its last window (the suffix), and those before it. Equal contexts are
   combined before and in the shuffle, with the earliest place; a passage that very many documents share is one row.
3. Sampled splitters deal the suffixes out by their leading bytes, in buckets of about ``BUCKET`` rows. A bucket sorts its suffixes, and what stands
   before them read backwards, by multikey quicksort on eight bytes at a time. Runs of neighbours with enough bytes in common, on both sides of the anchor,
   are equal windows; the earliest place of each is its first.
4. Across boundaries: a window whose part from the anchor on is the beginning of a splitter may be in the next bucket too. The first place that its bucket has for it is
   compared with those of the others by an aggregate on its bytes.
5. Documents get their anchors and the windows that they have first as lists, and drop what other windows cover.

No step gathers documents that share text, and texts are shuffled twice, to their anchors and to their lists. The driver gets a sample of eight suffixes a bucket.

Edge cases: null or empty text has no bytes. Documents without id keep everything and take nothing from others. Rows that share an id are ordered by a hash of their
text; rows that share both are alike, and none takes from the others. Exact copies of a smaller id lose all. Texts under ``length`` bytes stay whole. Bytes are cut
without regard to characters. Very long texts are hashed in pieces; of anchors one after the other with the same context (a text of one repeated character) only
the first goes on. An empty table gives an empty table. Other columns don't matter, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.copies import classes_of, slim
from docmill.llm.words import _TABLE, LOW, PIECE, as_bytes, batches, minima, windows
from docmill.runtime import bounded_batches, discard, join_keys, small_enough, tidy, written

#: Windows an anchor can stand for, one bit each.
PLACES = 64
#: Rows of a bucket, whatever the input.
BUCKET = 1 << 17
#: Suffixes that the driver samples for each bucket.
SAMPLES = 8


def _anchors_of(data: bytes, bounds: np.ndarray, length: int, places: int) -> tuple[np.ndarray, ...]:
    """(document, anchor, first window, last window, hash) over documents that lie one after the other; places count from the start of ``data``."""
    buf = np.frombuffer(data, np.uint8)
    if len(buf) < length:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    hashes = windows(_TABLE[buf], length - places + 1)
    at = minima((hashes & ~LOW) | np.arange(len(hashes), dtype=np.uint64), places) & LOW
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    starts = np.flatnonzero(bounds[doc[: len(at)] + 1] - np.arange(len(at)) >= length)
    anchor = at[starts].astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (np.diff(anchor) != 0) | (np.diff(starts) != 1)
    first, last = np.flatnonzero(new), np.flatnonzero(np.append(new[1:], True)[: len(new)])
    return doc[starts[first]], anchor[first], starts[first], starts[last], hashes[anchor[first]]


def anchors(texts: list[bytes], length: int, places: int = PLACES) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, anchor, first window, last window, hash, again) by pieces; ``again`` marks anchors whose context equals that of the one just before."""
    for lo, hi in batches(texts):
        if hi - lo == 1 and len(texts[lo]) > PIECE:
            pieces = [(texts[lo][s : s + PIECE + length - 1], np.array([0, min(len(texts[lo]) - s, PIECE + length - 1)]), s) for s in range(0, len(texts[lo]) - length + 1, PIECE)]
        else:
            pieces = [(b"".join(texts[lo:hi]), np.concatenate([[0], np.cumsum([len(t) for t in texts[lo:hi]])]), 0)]
        for data, bounds, base in pieces:
            doc, at, first, last, h = _anchors_of(data, bounds, length, places)
            again = np.zeros(len(at), bool)
            near = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1]) & (np.diff(at) == np.diff(first)) & (np.diff(at) == np.diff(last))
            for k in np.flatnonzero(near) + 1:
                again[k] = data[first[k] : last[k] + length] == data[first[k - 1] : last[k - 1] + length]
            shift = base - bounds[doc]
            yield doc + lo, at + shift, first + shift, last + shift, h, again


def packed(at: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """An anchor and the distances to its first and last window in one integer."""
    return (at << 12) | ((at - first) << 6) | (at - last)


def unpacked(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = x >> 12
    return at, at - ((x >> 6) & 63), at - (x & 63)


def multikey_order(words: np.ndarray) -> np.ndarray:
    """The order of rows of 64-bit keys: sorted by one key at a time, and only rows that tie go on to the next."""
    order = np.arange(len(words))
    group, live = np.zeros(len(words), np.int64), np.arange(len(words))
    for column in words.T:
        rows = order[live]
        by = np.lexsort((column[rows], group[live]))
        order[live] = rows[by]
        keys, own = column[order[live]], group[live]
        new = np.ones(len(live), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (own[1:] != own[:-1])
        group[live] = live[np.maximum.accumulate(np.where(new, np.arange(len(live)), 0))]
        ends = np.append(new[1:], True)
        live = live[~(new & ends)]
        if not len(live):
            break
    return order


def _matrix(strings: list[bytes], wide: int) -> tuple[np.ndarray, np.ndarray]:
    """Strings as rows of bytes, filled up with zeros, and their lengths."""
    sizes = np.array([len(s) for s in strings], np.int64)
    out = np.zeros((len(strings), wide), np.uint8)
    out[np.arange(wide) < sizes[:, None]] = np.frombuffer(b"".join(strings), np.uint8)
    return out, sizes


def _common(a: np.ndarray, a_sizes: np.ndarray, b: np.ndarray, b_sizes: np.ndarray) -> np.ndarray:
    """Bytes that rows have in common at their beginning."""
    differ = np.concatenate([a != b, np.ones((len(a), 1), bool)], axis=1)
    return np.minimum(differ.argmax(axis=1), np.minimum(a_sizes, b_sizes))


def sorted_runs(strings: list[bytes], wide: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, bytes in common with the one before in that order, matrix, lengths) of strings of at most ``wide`` bytes."""
    rows, sizes = _matrix(strings, -(-wide // 8) * 8)
    keys = np.concatenate([rows.view(">u8").astype(np.uint64), sizes[:, None].astype(np.uint64)], axis=1)
    order = multikey_order(keys)
    common = np.zeros(len(order), np.int64)
    common[1:] = _common(rows[order[1:]], sizes[order[1:]], rows[order[:-1]], sizes[order[:-1]])
    return order, common, rows, sizes


def _first_places(rights: list[bytes], lefts: list[bytes], length: int, places: int, edges: list[bytes]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Of contexts in the order of their places: a bit for each window that the context has first, and (context, window) of those that may be in other buckets too."""
    n = len(rights)
    order, common, rows, sizes = sorted_runs(rights, length)
    back, before, _, back_sizes = sorted_runs(lefts, places)
    reach = np.full(n, -1, np.int64)
    for edge in edges:
        e, size = _matrix([edge], rows.shape[1])
        reach = np.maximum(reach, _common(rows, sizes, e, size))
    kept, open_, run, side = np.zeros(n, np.uint64), [], np.empty(n, np.int64), np.empty(n, np.int64)
    for r in range(places):
        at = np.flatnonzero((sizes >= length - r) & (back_sizes >= r))
        if not len(at):
            continue
        run[order] = np.cumsum(common < length - r)
        side[back] = np.cumsum(before < r)
        first = at[np.unique(run[at] * (n + 1) + side[at], return_index=True)[1]]
        kept[first] |= np.uint64(1 << r)
        open_ += [(int(k), r) for k in first[reach[first] >= length - r]]
    return kept, open_


def _covered(size: int, length: int, places: int, notes: np.ndarray) -> np.ndarray:
    """Which bytes go, from notes (kind, at, mask): anchors (0), windows that are first (1) or turned out not to be (2), windows all of which go (3)."""
    gone = np.zeros(size + 1, bool)
    for at, upto in notes[notes[:, 0] == 3][:, 1:]:
        gone[at : upto + 1] = True
    own = np.unique(notes[notes[:, 0] == 0][:, 1])
    keep = np.zeros(len(own), np.uint64)
    for kind in (1, 2):
        of = notes[notes[:, 0] == kind]
        where, bits = np.searchsorted(own, of[:, 1]), of[:, 2].view(np.uint64) if len(of) else np.zeros(0, np.uint64)
        if kind == 1:
            np.bitwise_or.at(keep, where, bits)
        else:
            np.bitwise_and.at(keep, where, ~bits)
    at, first, last = unpacked(own)
    for r in range(places):
        lost = (keep >> np.uint64(r)) & np.uint64(1) == 0
        starts = (at - r)[lost & (at - r >= first) & (at - r <= last)]
        gone[starts] = True
    upto = np.concatenate([[0], np.cumsum(gone[:size])])
    return upto[1:] - upto[np.maximum(0, np.arange(1, size + 1) - length)] > 0


def suffix_dedup(docs: DataFrame, length: int = 100) -> DataFrame:
    """(doc_id, kept, n_bytes, n_removed, n_spans) for every row: the bytes that stay, and counts of bytes before, of bytes that go and of runs of these."""
    spark = docs.sparkSession
    places = min(PLACES, length // 2)
    bounded_batches(spark)
    base = slim(docs).withColumn("same", F.xxhash64("text"))
    live = base.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= length))

    def scan(parts):
        for batch in parts:
            texts, ids, same = as_bytes(batch.column("text")), batch.column("doc_id").to_numpy(), batch.column("same").to_numpy()
            for doc, at, first, last, h, again in anchors(texts, length, places):
                go = np.flatnonzero(~again)
                yield pa.RecordBatch.from_arrays([pa.array(h[go].view(np.int64)), pa.array(ids[doc[go]]), pa.array(same[doc[go]]), pa.array(packed(at[go], first[go], last[go]))], names=["h", "doc_id", "same", "at"])
                # the windows of a run of repeated contexts, as (-1 - first, last) in place of (at, h)
                runs = np.flatnonzero(again & ~np.concatenate([[False], again[:-1]])), np.flatnonzero(again & ~np.concatenate([again[1:], [False]]))
                if len(runs[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(last[runs[1]]), pa.array(ids[doc[runs[0]]]), pa.array(same[doc[runs[0]]]), pa.array(-1 - first[runs[0]])], names=["h", "doc_id", "same", "at"])

    found = written(live.mapInArrow(scan, "h long, doc_id long, same long, at long"), "anchors")
    place = F.xxhash64("same", F.shiftright("at", 12))
    several = found.where("at >= 0").groupBy("h").agg(F.min(place).alias("lo"), F.max(place).alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi").select("h", "n")
    several = written(several, "repeated-anchors")
    tidy(spark)

    prints = written(live.select("doc_id", F.octet_length("text").cast("long").alias("n"), F.col("same").alias("f1"), F.xxhash64("text", F.lit(1)).alias("f2")), "prints")
    classes = classes_of(prints)
    copies = join_keys(prints, classes.where(F.col("members") > 1), ["f1", "f2", "n"], "members").where(F.col("doc_id") > F.col("rep"))
    copies = written(copies.select("doc_id", F.col("f1").alias("same")).distinct(), "copies")
    discard(prints)
    marks = join_keys(found.where("at >= 0"), several, ["h"], "n").select("doc_id", "same", "at", F.lit(0).cast("long").alias("mask"))
    marks = marks.unionByName(found.where("at < 0").select("doc_id", "same", "at", F.col("h").alias("mask")))
    marks = written(marks.join(small_enough(copies), ["doc_id", "same"], "left_anti"), "marks")
    discard(found)
    tidy(spark)

    def contexts(parts):
        for batch in parts:
            texts, ids, same, lists = as_bytes(batch.column("text")), batch.column("doc_id").to_pylist(), batch.column("same").to_pylist(), batch.column("ats")
            held, size = {}, 0

            def out(held=held):
                rights, lefts, own = zip(*((r, x, o) for (r, x), o in held.items()), strict=True)
                return pa.RecordBatch.from_arrays([pa.array(rights, pa.binary()), pa.array(lefts, pa.binary()), *(pa.array(c, pa.int64()) for c in zip(*own, strict=True))], names=["rights", "lefts", "doc_id", "same", "at"])

            for k, text in enumerate(texts):
                own = lists[k].values.to_numpy()
                for a, lo, hi, x in zip(*(v.tolist() for v in (*unpacked(own), own)), strict=True):
                    key, place = (text[a : hi + length], text[lo:a][::-1]), (ids[k], same[k], x)
                    if key not in held or place < held[key]:
                        size += key not in held
                        held[key] = place
                if size > 1 << 15:
                    yield out()
                    held.clear()
                    size = 0
            if held:
                yield out()

    lists = marks.where("at >= 0").groupBy("doc_id", "same").agg(F.collect_set("at").alias("ats"))
    with_lists = live.join(lists.hint("shuffle_hash"), ["doc_id", "same"]).select("doc_id", "same", "text", "ats")
    found = with_lists.mapInArrow(contexts, "rights binary, lefts binary, doc_id long, same long, at long")
    found = written(found.groupBy("rights", "lefts").agg(F.min(F.struct("doc_id", "same", "at")).alias("first")).select("rights", "lefts", "first.*"), "contexts")
    tidy(spark)

    total = found.count()
    n_buckets = max(1, -(-total // BUCKET))
    splitters = _splitters(found, total, n_buckets)

    def dealt(parts):
        for batch in parts:
            keys = zip(batch.column("rights").to_pylist(), batch.column("lefts").to_pylist(), strict=True)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([bisect_right(splitters, k) for k in keys], pa.int64())], names=[*batch.schema.names, "bucket"])

    def settled(key: tuple, table: pa.Table) -> pa.Table:
        b = key[0].as_py()
        ids, same, at = (table.column(c).to_numpy() for c in ("doc_id", "same", "at"))
        order = np.lexsort((at, same, ids))
        table, ids, same, at = table.take(pa.array(order)), ids[order], same[order], at[order]
        rights, lefts = table.column("rights").to_pylist(), table.column("lefts").to_pylist()
        kept, open_ = _first_places(rights, lefts, length, places, [splitters[k][0] for k in (b - 1, b) if 0 <= k < len(splitters)])
        some = np.flatnonzero(kept)
        which = np.array([k for k, _ in open_], np.int64)
        bytes_ = [None] * len(some) + [lefts[k][:r][::-1] + rights[k][: length - r] for k, r in open_]
        masks = np.concatenate([kept[some], np.array([1 << r for _, r in open_], np.uint64)]).view(np.int64)
        rows = np.concatenate([some, which])
        start = np.concatenate([np.zeros(len(some), np.int64), (at[which] >> 12) - np.array([r for _, r in open_], np.int64)])
        return pa.table({"doc_id": ids[rows], "same": same[rows], "start": start, "at": at[rows], "mask": masks, "bytes": pa.array(bytes_, pa.binary())})

    firsts = found.mapInArrow(dealt, "rights binary, lefts binary, doc_id long, same long, at long, bucket long")
    firsts = written(firsts.groupBy("bucket").applyInArrow(settled, "doc_id long, same long, start long, at long, mask long, bytes binary"), "first-windows")
    discard(found)
    own = F.struct("doc_id", "same", "start", "at", "mask")
    # a window has one row for each bucket that holds it, so this list has no more than there are buckets
    met = firsts.where(F.col("bytes").isNotNull()).groupBy("bytes").agg(F.collect_list(own).alias("all")).where(F.size("all") > 1)
    lost = met.select(F.explode(F.filter("all", lambda x: x != F.array_min("all"))).alias("x")).select("x.*")

    notes = marks.select("doc_id", "same", F.when(F.col("at") < 0, 3).otherwise(0).alias("kind"), F.when(F.col("at") < 0, -1 - F.col("at")).otherwise(F.col("at")).alias("at"), "mask")
    for kind, rows in ((1, firsts.where(F.col("bytes").isNull())), (2, lost)):
        notes = notes.unionByName(rows.select("doc_id", "same", F.lit(kind).alias("kind"), "at", "mask"))
    notes = notes.unionByName(copies.select("doc_id", "same", F.lit(4).alias("kind"), F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("mask")))
    notes = notes.groupBy("doc_id", "same").agg(F.collect_list(F.struct(F.col("kind").cast("long").alias("kind"), "at", "mask")).alias("notes"))
    joined = base.join(notes.hint("shuffle_hash"), ["doc_id", "same"], "left").select("doc_id", "text", "notes")

    def rewrite(parts):
        for batch in parts:
            texts, lists, rows = as_bytes(batch.column("text")), batch.column("notes"), []
            for k, text in enumerate(texts):
                if not lists[k].is_valid:
                    rows.append((text, len(text), 0, 0))
                    continue
                notes = np.stack([lists[k].values.field(c).to_numpy() for c in ("kind", "at", "mask")], axis=1)
                gone = np.ones(len(text), bool) if (notes[:, 0] == 4).any() else _covered(len(text), length, places, notes)
                spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[:1].sum())
                rows.append((np.frombuffer(text, np.uint8)[~gone].tobytes(), len(text), int(gone.sum()), spans))
            kept, *counts = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, pa.binary()), *(pa.array(c, pa.int64()) for c in counts)], names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    return joined.mapInArrow(rewrite, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")


def _splitters(contexts: DataFrame, total: int, n_buckets: int) -> list[tuple[bytes, bytes]]:
    """Sorted (suffix, bytes before it backwards) that part the contexts into about equal buckets, from a sample by hash of ``SAMPLES`` a bucket."""
    if n_buckets == 1:
        return []
    every = max(1, total // (n_buckets * SAMPLES))
    sample = contexts.where(F.pmod(F.xxhash64("rights", "lefts"), F.lit(every)) == 0).select("rights", "lefts")
    keys = sorted((bytes(r.rights), bytes(r.lefts)) for r in sample.toLocalIterator())
    return sorted({keys[len(keys) * k // n_buckets] for k in range(1, n_buckets)}) if keys else []


def op12_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return suffix_dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: Texts as hexadecimal digits, two a byte. Runs of removed bytes are islands of window starts at most 100 apart.
OP12_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents),
b AS (SELECT doc_id, n, b, substring(x, 2 * b + 1, 2198) AS y FROM (SELECT doc_id, x, n, unnest(range(0, n - 99, 1000)) AS b FROM d WHERE n >= 100)),
s AS (SELECT doc_id, b, y, unnest(range(0, least(1000, n - b - 99))) AS i FROM b),
w AS (SELECT doc_id, b + i AS p, row_number() OVER (PARTITION BY substring(y, 2 * i + 1, 200) ORDER BY doc_id, b + i) AS k FROM s),
g AS (SELECT doc_id, p, coalesce(p - lag(p) OVER (PARTITION BY doc_id ORDER BY p), 1000) > 100 AS new FROM w WHERE k > 1),
i AS (SELECT doc_id, p, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY p) AS island FROM g),
r AS (SELECT doc_id, island, min(p) AS lo, max(p) + 100 AS hi FROM i GROUP BY doc_id, island),
e AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS since FROM r),
k AS (SELECT e.doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans,
             string_agg(substring(x, 2 * since + 1, 2 * (lo - since)), '' ORDER BY lo) || substring(any_value(x), 2 * max(hi) + 1) AS kept FROM e JOIN d USING (doc_id) GROUP BY e.doc_id)
SELECT d.doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
