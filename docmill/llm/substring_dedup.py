"""Substring deduplication with fixed-block anchors.

A window is ``window`` consecutive words of one document. Every word covered by a window whose word sequence also
starts in a document with a smaller id goes. Any window contains a whole block of an even division of its document into
blocks of half its length, so repeats are found from blocks, in those parts of the texts where a repeat can be:

1. The parts. Each window has one place in it whose half-window hashes least, a function of its words alone; one word in 13 is such a place of some window. Windows whose place's
   hash occurs in one document only, counted exactly by an aggregate, repeat nowhere and take no part. So what the filters below hold, and what passes them once they
   are full, is text that does repeat for half a window, however large the input.
2. The index: hashes of the non-overlapping blocks of these parts, as a Bloom filter of bounded size.
3. Every rolling window of a block's length probes it; hits that two documents contribute stay in a second filter.
   These are the anchors. A filter's false hit costs work and never changes the result.
4. Anchors are extended: every full window around an anchor goes on as a 128-bit hash with its document, and the smallest
   document of each hash is found by aggregation on both sides of the shuffle. Windows in a row make up a maximal repeat.
5. The smallest document gets its hashes back as a list, and each document drops what is around its anchors but not in its list (there, among
   the windows of one text, 64 bits tell them apart). So no step gathers the documents that share a passage, however many they are. Texts are shuffled twice, to their places and to their lists.

Whole copies are settled first by a fingerprint of the word sequence (128 bits and the length), so that groups of copies don't repeat all their windows.

Edge cases: null or empty text has no words. Documents without id keep everything and take nothing from others. Rows that
share an id don't take from each other, and get a list each. Texts of fewer than ``window`` words stay, as whitespace-joined words. Very long texts are
hashed in pieces and kept whole. An empty table gives an empty table. Other columns don't matter, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm import bloom
from docmill.llm.copies import classes_of, fingerprints, with_copy_marks
from docmill.llm.words import LOW, as_bytes, batches, hashed, minima, sequence, signed, windows
from docmill.runtime import bounded_batches, discard, join_keys, small_enough, tidy, written


class _Part:
    """The words of some documents one after the other; ``live`` marks words of documents that take part."""

    def __init__(self, texts, ids, copies, window, marks=None):
        """``marks`` has for each document the hashes of places that others share; without it all windows take part."""
        self.texts, self.window = texts, window
        self.words, self.offsets = hashed(texts)
        sizes = np.diff(self.offsets)
        take = np.array([i is not None for i in ids], bool) & (sizes >= window)
        self.copy = np.zeros(len(texts), bool)
        for k, prints in enumerate(copies):
            if prints and take[k]:
                self.copy[k] = sequence(self.words[self.offsets[k] : self.offsets[k + 1]]) in {m % (1 << 64) for m in prints}
        take &= ~self.copy
        self.doc = np.repeat(np.arange(len(texts)), sizes)
        self.at = np.arange(len(self.words)) - self.offsets[self.doc]
        self.live = take[self.doc]
        self.left = self.offsets[self.doc + 1] - np.arange(len(self.words))
        self.suspect = None
        if marks is not None:
            s, h = self.places()
            self.suspect = np.zeros(len(self.words) + 1, bool)
            edges = np.searchsorted(s, self.offsets)
            for k in np.flatnonzero(np.diff(edges)):
                if marks[k] is not None:
                    a, b = edges[k], edges[k + 1]
                    self.suspect[s[a:b][np.isin(h[a:b], marks[k])]] = True
            upto = np.concatenate([[0], np.cumsum(self.suspect[:-1])])
            at = np.arange(len(self.words))
            self.live = self.live & (upto[at + 1] > upto[np.maximum(0, at - window + 1)])

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """(starts of full windows, hash of the half-window that hashes least in each)."""
        half = (self.window + 1) // 2
        s = self.starts(self.window)
        if not len(s):
            return s, np.zeros(0, np.uint64)
        h, places, out = windows(self.words, half), self.window - half + 1, []
        for lo in range(0, len(h) - places + 1, 1 << 23):
            piece = h[lo : lo + (1 << 23) + places - 1]
            out.append(piece[(minima((piece & ~LOW) | np.arange(len(piece), dtype=np.uint64), places) & LOW).astype(np.int64)])
        return s, np.concatenate(out)[s]

    def starts(self, k: int) -> np.ndarray:
        """Where a window of k words begins that lies within one document."""
        return np.flatnonzero(self.live & (self.left >= k))

    def blocks(self, block: int) -> np.ndarray:
        """Hashes of the non-overlapping blocks."""
        s = self.starts(block)
        s = s[self.at[s] % block == 0]
        return windows(self.words, block)[s] if len(s) else np.zeros(0, np.uint64)

    def hits(self, block: int, *filters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, hashes) of rolling windows that all filters hold."""
        s = self.starts(block)
        h = windows(self.words, block)[s] if len(s) else np.zeros(0, np.uint64)
        for f in filters:
            ok = bloom.contains(f, h)
            s, h = s[ok], h[ok]
        return s, h

    def around(self, block: int, *filters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, hashes) of full windows that contain an anchor."""
        hit = np.zeros(len(self.words) + self.window + 1, np.int64)
        hit[self.hits(block, *filters)[0] + 1] = 1
        upto = np.cumsum(hit)
        s = self.starts(self.window)
        s = s[upto[s + self.window - block + 1] > upto[s]]
        if self.suspect is not None:
            s = s[self.suspect[s]]
        return s, windows(self.words, self.window)[s] if len(s) else np.zeros(0, np.uint64)


def _parts(batch, window):
    texts, ids, copies = as_bytes(batch.column("text")), batch.column("doc_id").to_pylist(), batch.column("copy_of").to_pylist()
    marks = None
    if "marks" in batch.schema.names:
        column = batch.column("marks")
        marks = [column[k].values.to_numpy(zero_copy_only=False).view(np.uint64) if column[k].is_valid else None for k in range(batch.num_rows)]
    for lo, hi in batches(texts):
        yield lo, hi, _Part(texts[lo:hi], ids[lo:hi], copies[lo:hi], window, marks and marks[lo:hi])


def substring_dedup(docs: DataFrame, window: int = 50) -> DataFrame:
    """(doc_id, text, n_words, n_removed) for every row: the kept words joined by a space, and counts before and of what went."""
    spark = docs.sparkSession
    block = (window + 1) // 2
    bounded_batches(spark)

    def whole(texts):
        n, f1, f2 = [], [], []
        for lo, hi in batches(texts):
            words, offsets = hashed(texts[lo:hi])
            for k in range(hi - lo):
                own = words[offsets[k] : offsets[k + 1]]
                n.append(len(own))
                # texts too short for a window count as different from any other
                f1.append(sequence(own) if len(own) >= window else 0)
                f2.append(sequence(own, 1) if len(own) >= window else 0)
        return n, f1, f2

    prints = fingerprints(docs, whole)
    long_ones = prints.where(F.col("n") >= window)
    base = with_copy_marks(docs, long_ones, classes_of(long_ones)).withColumn("same", F.xxhash64("text"))

    def place(parts):
        for batch in parts:
            ids, same = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False), batch.column("same").to_numpy()
            for lo, _, part in _parts(batch, window):
                s, h = part.places()
                if len(s):
                    doc = part.doc[s]
                    new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])
                    yield pa.RecordBatch.from_arrays([pa.array(signed(h[new])), pa.array(ids[lo + doc[new]].astype(np.int64)), pa.array(same[lo + doc[new]])], names=["h", "doc_id", "same"])

    places = written(base.mapInArrow(place, "h long, doc_id long, same long"), "places")
    shared = places.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi").select("h", "n")
    shared = written(shared, "shared-places")
    tidy(spark)
    marks = written(join_keys(places, shared, ["h"], "n").groupBy("doc_id", "same").agg(F.collect_set("h").alias("marks")), "marks")
    discard(places)
    tidy(spark)
    n_marks = marks.agg(F.sum(F.size("marks"))).first()[0] or 0
    # the passes below read texts with their places from one table
    base = written(base.join(marks.hint("shuffle_hash"), ["doc_id", "same"], "left").select("doc_id", "text", "copy_of", "marks"), "marked")
    discard(marks)
    tidy(spark)

    def index(batch):
        for _, _, part in _parts(batch, window):
            yield part.blocks(block)

    indexed = spark.sparkContext.broadcast(bloom.build(base, index, bloom.bits_for(n_marks * 4.0), "once"))

    def probes(batch):
        for _, _, part in _parts(batch, window):
            s, h = part.hits(block, indexed.value)
            order = np.lexsort((h, part.doc[s]))
            s, h = s[order], h[order]
            first = np.ones(len(h), bool)
            first[1:] = (h[1:] != h[:-1]) | (part.doc[s[1:]] != part.doc[s[:-1]])
            yield h[first]

    anchors = spark.sparkContext.broadcast(bloom.build(base, probes, bloom.bits_for(n_marks * 50.0, 8)))

    def extended(parts):
        for batch in parts:
            ids = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
            for lo, _, part in _parts(batch, window):
                s, h = part.around(block, indexed.value, anchors.value)
                if len(s):
                    other = windows(part.words, window, 1)[s]
                    owner, mark = ids[lo + part.doc[s]].astype(np.int64), batch.column("same").to_numpy()[lo + part.doc[s]]
                    yield pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(signed(other)), pa.array(owner), pa.array(mark)], names=["h1", "h2", "doc_id", "same"])

    def windows_of(rows):
        return rows.withColumn("same", F.xxhash64("text")).mapInArrow(extended, "h1 long, h2 long, doc_id long, same long")

    first = windows_of(base).groupBy("h1", "h2").agg(F.min("doc_id").alias("__id"))
    # an id that several rows share has no list of its own, as that would be as long as all their texts
    same_id = written(long_ones.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where(F.col("count") > 1).select(F.col("doc_id").alias("__shared")), "shared-ids")
    if same_id.isEmpty():
        # written before texts are shuffled, so that not both shuffles are on disk at once
        kept = written(first.groupBy("__id").agg(F.collect_list("h1").alias("kept")), "lists")
        joined = base.join(kept, F.col("doc_id") == F.col("__id"), "left").select("doc_id", "text", "copy_of", "marks", "kept")
    else:
        first = written(first, "first")
        ids = small_enough(same_id)
        alone, several = (base.join(ids, F.col("doc_id") == F.col("__shared"), how) for how in ("left_anti", "left_semi"))
        kept = first.join(ids, F.col("__id") == F.col("__shared"), "left_anti").groupBy("__id").agg(F.collect_list("h1").alias("kept"))
        # each of its texts gets those of its own windows that its id has first
        own = windows_of(several).distinct().join(first.withColumnRenamed("__id", "doc_id"), ["h1", "h2", "doc_id"])
        lists = own.groupBy(F.col("doc_id").alias("__id"), F.col("same").alias("__same")).agg(F.collect_list("h1").alias("kept"))
        columns = ["doc_id", "text", "copy_of", "marks", "kept"]
        joined = alone.join(kept, F.col("doc_id") == F.col("__id"), "left").select(*columns)
        joined = joined.unionByName(several.join(lists, (F.col("doc_id") == F.col("__id")) & (F.xxhash64("text") == F.col("__same")), "left").select(*columns))

    def rewrite(parts):
        for batch in parts:
            texts, n_words, n_removed = [], [], []
            lists = batch.column("kept")
            for lo, hi, part in _parts(batch, window):
                s, h = part.around(block, indexed.value, anchors.value)
                gone = np.zeros(len(part.words) + 1, np.int64)
                edges = np.searchsorted(s, part.offsets)
                for k in np.flatnonzero(np.diff(edges)):
                    at, hashes = s[edges[k] : edges[k + 1]], h[edges[k] : edges[k + 1]]
                    own = lists[lo + int(k)]
                    if own.is_valid:
                        at = at[~np.isin(hashes, own.values.to_numpy(zero_copy_only=False).view(np.uint64))]
                    gone[at] += 1
                    np.subtract.at(gone, at + window, 1)
                covered = np.cumsum(gone)[:-1] > 0
                for k in range(hi - lo):
                    words = part.texts[k].split()
                    if part.copy[k]:
                        kept_words = []
                    else:
                        out = covered[part.offsets[k] : part.offsets[k + 1]]
                        kept_words = [w for w, x in zip(words, out.tolist(), strict=True) if not x] if out.any() else words
                    texts.append(b" ".join(kept_words))
                    n_words.append(len(words))
                    n_removed.append(len(words) - len(kept_words))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], names=["doc_id", "text", "n_words", "n_removed"])

    return joined.mapInArrow(rewrite, "doc_id long, text string, n_words long, n_removed long")


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(generate_series(1, len(w) - 49)) AS at FROM d WHERE len(w) >= 50),
x AS (SELECT s.doc_id, s.at, array_to_string(d.w[s.at:s.at + 49], ' ') AS seq FROM s JOIN d USING (doc_id)),
f AS (SELECT seq, min(doc_id) AS first FROM x GROUP BY seq),
g AS (SELECT DISTINCT x.doc_id, unnest(generate_series(x.at, x.at + 49)) AS at FROM x JOIN f USING (seq) WHERE f.first < x.doc_id),
p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS at FROM d),
k AS (SELECT p.doc_id, count(*) AS n_words, count(g.at) AS n_removed,
             coalesce(string_agg(p.word, ' ' ORDER BY p.at) FILTER (g.at IS NULL), '') AS kept
      FROM p LEFT JOIN g ON p.doc_id = g.doc_id AND p.at = g.at GROUP BY p.doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
