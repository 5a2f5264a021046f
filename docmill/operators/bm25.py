"""BM25 (Okapi, with a floor for negative idf) of passages for a set of queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions.text import tokens
from docmill.runtime import written

K1, B, EPSILON = 1.5, 0.75, 0.25


def raw_idf(n: float, df: str = "df") -> Column:
    """ln(N - df + 0.5) - ln(df + 0.5)."""
    return F.ln(F.lit(float(n)) - F.col(df) + 0.5) - F.ln(F.col(df) + 0.5)


def corpus_statistics(passages: DataFrame) -> tuple[DataFrame, int, float]:
    """((term, df, raw_idf), number of passages, mean length) in one scan. Only (term, count) is shuffled, combined within tasks.

    A row with a null term stands for each passage, so that lengths come along.
    """
    words = tokens(F.col("text"), lower=True)
    rows = passages.select(words.alias("w")).select(F.size("w").alias("dl"), F.explode(F.array_append(F.array_distinct("w"), F.lit(None).cast("string"))).alias("term"))
    counted = written(rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum(F.when(F.col("term").isNull(), F.col("dl"))).alias("all")), "terms")
    whole = counted.where("term is null").first()
    n, total = (whole["df"], whole["all"] or 0) if whole else (0, 0)
    return counted.where("term is not null").select("term", "df", raw_idf(n).alias("raw_idf")), n, total / n if n else 0.0


def floored(mean: float | None) -> Column:
    """idf: a negative value becomes ``EPSILON`` times the mean over all terms, negatives included."""
    return F.when(F.col("raw_idf") < 0, F.lit((mean or 0.0) * EPSILON)).otherwise(F.col("raw_idf"))


def query_terms(queries: DataFrame, text: str = "query") -> DataFrame:
    """(query_idx, term, qtf): repeated tokens count as often as they stand."""
    return queries.select("query_idx", F.explode(tokens(F.col(text), lower=True)).alias("term")).groupBy("query_idx", "term").agg(F.count(F.lit(1)).alias("qtf"))


def weighed_terms(passages: DataFrame, queries: DataFrame, text: str = "query") -> tuple[DataFrame, float]:
    """((query_idx, term, weight), mean length): each query's terms that any passage has, with qtf x idf. Written; one scan of the passages."""
    stats, _, mean_length = corpus_statistics(passages)
    mean = stats.agg(F.avg("raw_idf")).first()[0]
    wanted = query_terms(queries, text)
    weighed = wanted.join(stats, "term").select("query_idx", "term", (F.col("qtf") * floored(mean)).alias("weight"))
    return written(weighed, "query-terms"), mean_length


def bm25_scores(passages: DataFrame, queries: DataFrame, key: str, text: str = "query") -> DataFrame:
    """(query_idx, key, bm25) for all pairs that share a term.

    The passages are read twice: for statistics, and to be scored where they are. A pair is made once, whole, by the task that has the passage; nothing is shuffled or gathered.
    """
    weighed, mean = weighed_terms(passages, queries, text)
    return _scored(passages, weighed, mean, key, None, 512).withColumnRenamed("k", key)


def bm25_top_k(passages: DataFrame, queries: DataFrame, key: str, k: int, text: str = "query", block: int = 512) -> DataFrame:
    """(query_idx, key, bm25, rank): the k best passages of each query among those that share a term with it, smallest key first among equals."""
    weighed, mean = weighed_terms(passages, queries, text)
    return top_k(_scored(passages, weighed, mean, key, k, block), "bm25", "k", k).withColumnRenamed("k", key)


def _scored(passages: DataFrame, weighed: DataFrame, mean: float, key: str, k: int | None, block: int) -> DataFrame:
    """(query_idx, k, bm25) of pairs that share a term: of each task the k best of a query and what equals the last of them, or all without ``k``.

    The query set is the small, stated side: it goes to the executors in blocks of ``block`` queries, each task scores its batches against a block and keeps
    k rows a query, and only those are shuffled. No posting is.
    """
    kind = passages.schema[key].dataType.simpleString()
    ids = sorted(r[0] for r in weighed.select("query_idx").distinct().collect())
    out = None
    for lo in range(0, max(1, len(ids)), block):
        part = ids[lo : lo + block]
        place = {q: j for j, q in enumerate(part)}
        mine = weighed.where(F.col("query_idx").between(part[0], part[-1])) if part else weighed.limit(0)
        terms: dict[str, list[tuple[int, float]]] = {}
        for r in mine.toLocalIterator():
            terms.setdefault(r["term"], []).append((place[r["query_idx"]], r["weight"]))
        edges = np.cumsum([0, *map(len, terms.values())])
        flat = [x for pairs in terms.values() for x in pairs]
        columns = np.array([q for q, _ in flat], np.int64), np.array([w for _, w in flat], np.float64)
        shared = passages.sparkSession.sparkContext.broadcast((np.array(part, np.int64), {t: i for i, t in enumerate(terms)}, edges, *columns))

        def search(batches, shared=shared):
            queries, number, edges, column, weight = shared.value
            best, keep = [], 0

            def packed(q, key, s):
                return pa.RecordBatch.from_arrays([pa.array(queries[q]), pa.array(key.tolist(), kind), pa.array(s, pa.float64())], names=["query_idx", "k", "bm25"])

            def cut():
                """The best k rows a query of what is kept; ties at the cut stay until the last step orders them."""
                q, key, s = (np.concatenate(x) for x in zip(*best, strict=True))
                if not len(q):
                    return [(q, key, s)]
                order = np.lexsort((-s, q))
                q, key, s = q[order], key[order], s[order]
                first = np.searchsorted(q, np.arange(len(queries)))
                last = np.searchsorted(q, np.arange(len(queries)), "right")
                least = np.where(last > first, s[np.minimum(first + k, np.maximum(last, 1)) - 1], 0)
                stays = s >= least[q]
                return [(q[stays], key[stays], s[stays])]

            kind = pa.null()
            for batch in batches if len(queries) else ():
                kind = batch.schema.field("k").type
                keys = batch.column("k").to_numpy(zero_copy_only=False)
                for at in range(0, batch.num_rows, 256):
                    texts = batch.column("text")[at : at + 256].to_pylist()
                    words = [(t or "").lower().split() for t in texts]
                    known = [(i, n) for i, own in enumerate(words) for w in own if (n := number.get(w)) is not None]
                    pair, tf = np.unique(np.array(known, np.int64).reshape(-1, 2) @ np.array([len(number) or 1, 1]), return_counts=True)
                    row, term = pair // (len(number) or 1), pair % (len(number) or 1)
                    size = np.array([len(own) for own in words], np.float64)[row]
                    value = tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / (mean or 1.0)))
                    # each posting once for every query that has its term
                    n = edges[term + 1] - edges[term]
                    each = np.repeat(edges[term] - np.cumsum(n) + n, n) + np.arange(n.sum())
                    cell = np.repeat(row, n) * len(queries) + column[each]
                    score = np.bincount(cell, np.repeat(value, n) * weight[each], len(texts) * len(queries)).reshape(len(texts), -1)
                    shares = np.bincount(cell, minlength=len(texts) * len(queries)).reshape(len(texts), -1) > 0
                    i, q = np.nonzero(shares)
                    if k is None:
                        yield packed(q, keys[at + i], np.round(score[i, q], 6))
                        continue
                    best.append((q, keys[at + i], np.round(score[i, q], 6)))
                    keep += len(q)
                    if keep > 1 << 20:
                        best = cut()
                        keep = len(best[0][0])
            if best:
                ((q, key, s),) = cut()
                yield packed(q, key, s)

        found = passages.select(F.col(key).alias("k"), F.col("text").cast("string").alias("text")).mapInArrow(search, f"query_idx long, k {kind}, bm25 double")
        out = found if out is None else out.unionByName(found)
    return out


def top_k(scores: DataFrame, score: str, key: str, k: int) -> DataFrame:
    """The k best rows of each query, smallest key first among equals."""
    order = Window.partitionBy("query_idx").orderBy(F.col(score).desc(), F.col(key).asc())
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def normalised(scores: DataFrame, score: str) -> DataFrame:
    """Scores over the largest of their query; as they are where that is 0 or less. A query's best k rows hold its largest, so they
    can be cut first."""
    best = scores.groupBy("query_idx").agg(F.max(score).alias("__best"))
    out = scores.join(best, "query_idx")
    return out.withColumn(score, F.when(F.col("__best") <= 0, F.col(score)).otherwise(F.col(score) / F.col("__best"))).drop("__best")
