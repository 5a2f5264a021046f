"""Embeddings and exact inner-product search."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.models import Embedder, HashedEmbedder
from docmill.operators.bm25 import top_k
from docmill.runtime import lean

#: Rows whose products with a block of queries a task holds at once.
ROWS = 1 << 10


def embedded(rows: DataFrame, text: str = "text", model: Embedder | None = None, column: str = "embedding") -> DataFrame:
    """``rows`` with the embedding of ``text`` as array<double>."""
    model = model or HashedEmbedder()

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series(list(model.embed(texts.fillna("").tolist())))

    return rows.withColumn(column, embed(F.col(text)))


def check_dimension(rows: DataFrame, column: str, dimension: int) -> DataFrame:
    """``rows`` with every vector of the given length; another length is an error when read."""
    wrong = F.raise_error(F.format_string("expected %d dimensions, got %d", F.lit(dimension), F.size(column)))
    return rows.withColumn(column, F.when(F.size(column) == dimension, F.col(column)).otherwise(wrong.cast(rows.schema[column].dataType)))


def vector_top_k(rows: DataFrame, queries: DataFrame, key: str, k: int, column: str = "embedding", block: int = 1024, within: str | None = None) -> DataFrame:
    """(query_idx, key, dense, rank): the k rows of the largest inner product with each query, smallest key first among equals.

    The queries are the small, stated side: they go to the executors in blocks of ``block``, each task multiplies ``ROWS`` rows at a time by the block and
    keeps k rows a query, and only those are shuffled. No pair of row and query is a row of any table. With ``within``, a column of both sides, only rows
    that agree with the query in it count.
    """
    wanted = queries.where(F.col(column).isNotNull()).select("query_idx", F.col(column).alias("v"), (F.lit(0) if within is None else F.col(within)).alias("w")).orderBy("query_idx").collect()
    kind = rows.schema[key].dataType.simpleString()
    out = None
    for lo in range(0, max(1, len(wanted)), block):
        part = wanted[lo : lo + block]
        ids = np.array([r["query_idx"] for r in part], np.int64)
        matrix = np.array([r["v"] for r in part], np.float64) if part else np.zeros((0, 1))
        shared = rows.sparkSession.sparkContext.broadcast((ids, matrix, np.array([r["w"] for r in part])))

        def search(batches, shared=shared):
            ids, matrix, own = shared.value
            kept, held, least = [], 0, np.full(len(ids), -np.inf)
            kind = pa.null()

            def cut():
                """The best k rows a query of what is kept, and the bar that a query with k of them sets."""
                best = pd.DataFrame(dict(zip(("query", "k", "dense"), map(np.concatenate, zip(*kept, strict=True)), strict=True)))
                best = best.sort_values(["query", "dense", "k"], ascending=[True, False, True]).groupby("query").head(k)
                last = best.groupby("query")["dense"].agg(["size", "min"])
                full = last[last["size"] == k]
                least[full.index] = full["min"]
                return [tuple(best[c].to_numpy() for c in ("query", "k", "dense"))]

            for batch in batches:
                kind = batch.schema.field("k").type
                for at in range(0, batch.num_rows if len(ids) else 0, ROWS):
                    part = batch.slice(at, ROWS)
                    vectors = np.stack(part.column("v").to_numpy(zero_copy_only=False)).astype(np.float64)
                    scores = vectors @ matrix.T
                    np.round(scores, 6, out=scores)
                    if within is not None:
                        scores[part.column("w").to_numpy(zero_copy_only=False)[:, None] != own[None, :]] = -np.inf
                    # ties at the bar stay until the last step orders them
                    bar = least if len(scores) <= k or np.isfinite(least).all() else np.maximum(least, np.partition(scores, len(scores) - k, axis=0)[len(scores) - k])
                    row, query = np.nonzero((scores >= bar) & (scores > -np.inf))
                    kept.append((query, part.column("k").to_numpy(zero_copy_only=False)[row], scores[row, query]))
                    held += len(row)
                    if held > 4 * k * len(ids):
                        kept = cut()
                        held = len(kept[0][0])
            if kept:
                ((query, keys, dense),) = cut()
                yield pa.RecordBatch.from_arrays([pa.array(ids[query.astype(np.int64)], pa.int64()), pa.array(keys.tolist(), kind), pa.array(dense, pa.float64())], names=["query_idx", "k", "dense"])

        slim = rows.where(F.col(column).isNotNull()).select(F.col(key).alias("k"), F.col(column).alias("v"), *([] if within is None else [F.col(within).alias("w")]))
        found = slim.mapInArrow(lean(search), f"query_idx long, k {kind}, dense double")
        out = found if out is None else out.unionByName(found)
    return top_k(out, "dense", "k", k).withColumnRenamed("k", key)
