"""Maximal marginal relevance: a short, diverse selection from candidates of any number."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.runtime import written

#: Rows that a round of selection brings to the driver.
POOL = 1 << 10


def mmr_order(relevance: np.ndarray, vectors: np.ndarray, k: int, balance: float) -> list[int]:
    """Indices in the order of selection: first the most relevant, then the largest balance x relevance - (1 - balance) x similarity to the nearest selected; the lowest index of equals. All in given order if there are no more than k."""
    n = len(relevance)
    if n != len(vectors):
        raise ValueError(f"{n} candidates with {len(vectors)} vectors")
    if n <= k:
        return list(range(n))
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = np.divide(vectors, size, out=np.zeros_like(vectors, dtype=float), where=size > 0)
    chosen = [int(np.argmax(relevance))]
    nearest = unit @ unit[chosen[0]]
    free = np.ones(n, bool)
    free[chosen[0]] = False
    while len(chosen) < k:
        gain = np.where(free, np.round(balance * relevance - (1 - balance) * nearest, 9), -np.inf)
        best = int(np.argmax(gain))
        chosen.append(best)
        free[best] = False
        nearest = np.maximum(nearest, unit @ unit[best])
    return chosen


def _unit(vectors, width: int) -> np.ndarray:
    """Rows of length one; of zeros for a null vector or one without length."""
    rows = np.array([np.zeros(width) if v is None else v for v in vectors], float).reshape(len(vectors), width)
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)


def _best(rows: DataFrame, chosen: list, units: np.ndarray, balance: float, pool: int) -> list:
    """The ``pool`` rows of the largest gain given what is chosen, best first."""

    @F.pandas_udf("double")
    def gain(s: pd.Series, v: pd.Series) -> pd.Series:
        return pd.Series(np.round(balance * s.to_numpy() - (1 - balance) * (_unit(v.tolist(), units.shape[1]) @ units.T).max(axis=1), 9))

    free = rows.where(~F.col("k").isin(chosen)).withColumn("gain", gain("s", "v"))
    return free.orderBy(F.col("gain").desc(), F.col("s").desc(), F.col("k").asc()).limit(pool).collect()


def mmr_select(candidates: DataFrame, k: int = 30, balance: float = 0.30, score: str = "hybrid", vector: str = "embedding", key: str = "item_id", pool: int = POOL) -> DataFrame:
    """(key, rank): at most k of the candidates in the order of selection, which is that of :func:`mmr_order` over rows by score and key.

    A gain only falls as more are selected. So each round takes the ``pool`` rows of the largest gain from all partitions, and selects among them as long as the best is
    better than the last of the pool was, which no row outside can be. There are k - 1 rounds at most, each a pass over the written candidates; the driver holds a pool and the
    selection, whatever the number of candidates. Keys are unique; a null score is less than any.
    """
    spark, kind = candidates.sparkSession, candidates.schema[key].dataType.simpleString()
    rows = written(candidates.select(F.col(key).alias("k"), F.coalesce(F.col(score).cast("double"), F.lit(-1e200)).alias("s"), F.col(vector).alias("v")), "candidates")
    width = max(1, rows.agg(F.max(F.size("v"))).first()[0] or 1)
    first = rows.orderBy(F.col("s").desc(), F.col("k").asc()).limit(k + 1).collect()
    chosen = [r["k"] for r in first] if len(first) <= k else [first[0]["k"]]
    units = _unit([first[0]["v"]], width) if first else np.zeros((0, width))
    while len(first) > k > len(chosen):
        best = _best(rows, chosen, units, balance, pool)
        relevance, vectors = np.array([r["s"] for r in best]), _unit([r["v"] for r in best], width)
        by = sorted(range(len(best)), key=lambda i: (-relevance[i], best[i]["k"]))
        relevance, vectors, keys, free = relevance[by], vectors[by], [best[i]["k"] for i in by], np.ones(len(best), bool)
        nearest = (vectors @ units.T).max(axis=1)
        least, fresh = -np.inf if len(best) < pool else best[-1]["gain"], True
        while len(chosen) < k and free.any():
            gain = np.where(free, np.round(balance * relevance - (1 - balance) * nearest, 9), -np.inf)
            at = int(np.argmax(gain))
            if not fresh and gain[at] <= least:
                break
            fresh, free[at] = False, False
            chosen.append(keys[at])
            units = np.vstack([units, vectors[at]])
            nearest = np.maximum(nearest, vectors @ vectors[at])
    return spark.createDataFrame([(x, i + 1) for i, x in enumerate(chosen)], f"{key} {kind}, rank int")
