"""Line deduplication with once-seen and twice-seen Bloom filters.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased. Keys of at least
``min_chars`` code points that at least ``min_docs`` documents hold lose all their lines but those of the largest
``doc_id`` that holds the key.

The first pass puts a hash of each key (once a document) in two Bloom filters of bounded size. The second pass
sends on only keys that the twice-seen filter holds, as 128-bit digests with the document's id, and aggregates
them on both sides of the shuffle: an exact count and the largest id for each key, however many documents share
it. The third pass drops lines. The confirmed keys reach it as a broadcast if they are counted to be few, and else
by joins on the key and then on the document, which shuffle the texts once. Keys that very many documents hold are broadcast in any case.

Edge cases: null or empty text is one empty line. Every row of the table is a document; rows that share the
largest ``doc_id`` all keep the line. A null ``doc_id`` is smaller than any other; a key that only documents without
id hold stays in all of them. Very long texts are split whole. An empty table gives an empty table. Other columns pass through; columns named like
the added ones (``n_lines``, ``n_dropped``) are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm import bloom
from docmill.llm.words import as_bytes, lean
from docmill.runtime import bounded_batches, join_keys, plan_bytes, written

#: Confirmed keys (24 bytes each) up to which they are broadcast.
MOST_BROADCAST_KEYS = 1 << 18


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The key of a line, None if it is shorter than ``min_chars`` code points."""
    if len(line) < min_chars:
        return None
    key = line.strip().lower()
    if len(key) < min_chars or not key.isascii() and len(key.decode()) < min_chars:
        return None
    return key


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, broadcast_keys: int = MOST_BROADCAST_KEYS) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``, plus ``n_lines`` (before) and ``n_dropped``."""
    spark = docs.sparkSession
    bounded_batches(spark)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def hashes_of(batch):
        for text in as_bytes(batch.column("text")):
            keys = {k for line in text.split(b"\n") if (k := line_key(line, min_chars)) is not None}
            if keys:
                yield np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))

    # a key takes 40 bytes of text at least; the files are about half the size of the texts
    bits = bloom.bits_for(plan_bytes(slim) / 20, 8)
    seen = spark.sparkContext.broadcast(bloom.build(slim, hashes_of, bits))

    def suspects(batches):
        for batch in batches:
            ids, keys, owners, marks = batch.column("doc_id").to_pylist(), [], [], []
            for doc_id, text, mark in zip(ids, as_bytes(batch.column("text")), batch.column("same").to_pylist(), strict=True):
                own = list({k for line in text.split(b"\n") if (k := line_key(line, min_chars)) is not None})
                if own:
                    hit = bloom.contains(seen.value, np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own)))
                    found = [_digest(k) for k, h in zip(own, hit.tolist(), strict=True) if h]
                    keys += found
                    owners += [doc_id] * len(found)
                    marks += [mark] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(owners, pa.int64()), pa.array(marks, pa.int64())], names=["key", "doc_id", "same"])

    held = slim.withColumn("same", F.xxhash64("text")).mapInArrow(lean(suspects), "key binary, doc_id long, same long")
    confirmed = written(held.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper")).where(F.col("n_docs") >= min_docs), "line-keys")
    schema = docs.schema.names
    rest = [c for c in schema if c not in ("text", "n_lines", "n_dropped")]
    order = ["text", *rest]
    spec = ", ".join(f"`{f.name.replace('`', '``')}` {'string' if f.name == 'text' else f.dataType.simpleString()}" for f in sorted((f for f in docs.schema if f.name in order), key=lambda f: order.index(f.name)))

    def rewrite(batches, drop_of):
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            for k, text in enumerate(as_bytes(batch.column("text"))):
                lines = text.split(b"\n")
                gone = drop_of(batch, k)
                kept = [x for x in lines if not gone(x)]
                texts.append(b"\n".join(kept))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
            columns = [pa.array(texts, pa.binary()).cast(pa.string()), *(batch.column(c) for c in rest), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*order, "n_lines", "n_dropped"])

    out_spec = f"{spec}, n_lines long, n_dropped long"
    plain = docs.select(F.col("text").cast("string").alias("text"), *(F.col(f"`{c}`") for c in rest))
    if confirmed.limit(broadcast_keys + 1).count() <= broadcast_keys:
        few = spark.sparkContext.broadcast({bytes(r.key): r.keeper for r in confirmed.toLocalIterator()})

        def with_broadcast(batches):
            keepers, filled = few.value, seen.value

            def drop_of(batch, k):
                doc_id = batch.column("doc_id")[k].as_py()
                text_keys = {}

                def gone(line):
                    key = line_key(line, min_chars)
                    if key is None:
                        return False
                    if key not in text_keys:
                        maybe = bloom.contains_one(filled, xxhash.xxh3_64_intdigest(key)) and (d := _digest(key)) in keepers
                        text_keys[key] = bool(maybe) and keepers[d] != doc_id
                    return text_keys[key]

                return gone

            yield from rewrite(batches, drop_of)

        out = plain.mapInArrow(lean(with_broadcast), out_spec)
    else:
        # a list for each id and text, so that no list is longer than its text has lines, however many rows share an id or have none
        lost = join_keys(held.select("key", "doc_id", "same"), confirmed, ["key"], "n_docs", broadcast_keys).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        drops = lost.groupBy("doc_id", "same").agg(F.collect_set("key").alias("__keys")).withColumnRenamed("doc_id", "__id")
        joined = plain.join(drops, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("same")), "left").drop("__id", "same")

        def with_column(batches):
            def drop_of(batch, k):
                keys = batch.column("__keys")[k].as_py()
                keys = set(keys or ())
                return lambda line: bool(keys) and (key := line_key(line, min_chars)) is not None and _digest(key) in keys

            yield from rewrite(batches, drop_of)

        out = joined.mapInArrow(lean(with_column), out_spec)
    return out.select(*schema, *(c for c in ("n_lines", "n_dropped") if c not in schema))


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH lines AS (
  SELECT doc_id, pos, line,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)),
repeated AS (SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT l.*, r.key IS NOT NULL AND l.doc_id <> r.keeper AS gone FROM lines l LEFT JOIN repeated r ON l.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
