"""An inverted index for BM25: postings in blocks with what bounds them, appended to run by run, and exact top-k search that skips blocks.

``append`` writes, for one run of new passages, three tables under ``run=...``: blocks (a term's postings among about ``block`` passages, with the largest term frequency and the least
length), document frequencies, and sizes. A file holds some blocks whole, its terms sorted, so that what a query asks of a block is
added up by the task that reads it. Nothing of earlier runs is read or rewritten, and a run that is written again replaces itself. Passages are dealt to blocks by a hash of their key, the same for all terms, so blocks of different terms line up.

``search`` sums, for each query and block of passages, what its terms can add at most. The blocks with the largest sums are scored first; their k-th best score
is a bar. A block whose sum is below it holds none of the k best and isn't opened; all others are scored. The result is that of ``bm25_top_k`` over all passages.

Edge cases: a passage without a term is counted in the mean length and found by no query. Null texts have no term. Keys are unique over all runs. A query without a term of the
index has no rows; without passages there are none at all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docmill.functions.text import tokens
from docmill.operators.bm25 import EPSILON, K1, B, query_terms, raw_idf, top_k
from docmill.runtime import small_enough, written


#: Words whose postings a task of ``append`` counts at about most.
TASK_WORDS = 1 << 21


def append(passages: DataFrame, key: str, path: str, run: str, block: int = 64, text: str = "text") -> None:
    """Adds a run of passages, whose keys no other run has, or replaces it."""
    spark = passages.sparkSession
    rows = passages.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    length = F.size(tokens(F.col("text"), lower=True))
    sizes = written(rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(length), F.lit(0)).alias("total")), "sizes")
    counted = sizes.first()
    n_blocks = max(1, -(-counted["n"] // block))
    parts = max(counted["total"] // TASK_WORDS + 1, min(n_blocks, spark.sparkContext.defaultParallelism))
    # texts are shuffled once; postings are counted, gathered and sorted where their block is
    placed = rows.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(n_blocks)).cast("int")).repartition(parts, "block")
    words = placed.select("key", "block", tokens(F.col("text"), lower=True).alias("w")).withColumn("dl", F.size("w"))
    posted = words.select("block", "key", "dl", F.explode("w").alias("term")).groupBy("block", "key", "term").agg(F.count(F.lit(1)).cast("int").alias("tf"), F.first("dl").alias("dl"))
    own = F.array_sort(F.collect_list(F.struct("key", "tf", "dl")))
    blocks = posted.groupBy("block", "term").agg(own.alias("p"), F.max("tf").alias("most"), F.min("dl").alias("least")).select("term", "block", "p", "most", "least")
    blocks.sortWithinPartitions("term", "block").write.mode("overwrite").parquet(f"{path}/blocks/run={run}")
    found = spark.read.schema(blocks.schema).parquet(f"{path}/blocks/run={run}")
    found.groupBy("term").agg(F.sum(F.size("p")).alias("df")).write.mode("overwrite").parquet(f"{path}/terms/run={run}")
    sizes.write.mode("overwrite").parquet(f"{path}/sizes/run={run}")


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(f"{schema}, run string").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{schema}, run string")


def size(spark: SparkSession, path: str) -> int:
    """Passages in the index."""
    return _table(spark, f"{path}/sizes", "n long, total long").agg(F.sum("n")).first()[0] or 0


@dataclass(frozen=True)
class Found:
    """``rows`` (query_idx, key, bm25, rank), and of the pairs of a query and a block of passages that share a term how many there are and how many weren't opened."""

    rows: DataFrame
    cells: int
    skipped: int


def _part(tf: Column, dl: Column, mean: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(float(mean or 1.0))))


def search(spark: SparkSession, path: str, queries: DataFrame, key: str, kind: str, k: int, text: str = "query", first: int = 4) -> Found:
    """The k best passages of each query (query_idx, ``text``), smallest key first among equals; keys have the type ``kind``. ``first`` blocks a query are scored for the bar."""
    sizes = _table(spark, f"{path}/sizes", "n long, total long").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    n, mean = sizes["n"] or 0, (sizes["total"] or 0) / (sizes["n"] or 1)
    frequencies = _table(spark, f"{path}/terms", "term string, df long").groupBy("term").agg(F.sum("df").alias("df")).withColumn("raw_idf", raw_idf(n))
    floor = (frequencies.agg(F.avg("raw_idf")).first()[0] or 0.0) * EPSILON
    asked = small_enough(written(query_terms(queries, text), "asked"))
    weight = F.when(F.col("raw_idf") < 0, F.lit(floor)).otherwise(F.col("raw_idf"))
    weights = written(frequencies.join(asked, "term").select("query_idx", "term", (F.col("qtf") * weight).alias("weight")), "weights")
    blocks = _table(spark, f"{path}/blocks", f"term string, block int, p array<struct<key: {kind}, tf: int, dl: int>>, most int, least int")
    held = blocks.join(small_enough(written(weights.select("term").distinct(), "asked-terms")), "term", "left_semi")

    # what the terms of a query can add at most to a passage of a block; a negative weight adds nothing
    bounds = held.select("term", "run", "block", _part(F.col("most"), F.col("least"), mean).alias("bound")).join(small_enough(weights), "term")
    cells = written(bounds.groupBy("query_idx", "run", "block").agg(F.sum(F.greatest("weight", F.lit(0.0)) * F.col("bound")).alias("bound")), "cells")
    place = Window.partitionBy("query_idx").orderBy(F.col("bound").desc(), "run", "block")
    leading = written(cells.withColumn("place", F.row_number().over(place)).where(F.col("place") <= first).select("query_idx", "run", "block"), "leading")

    # which queries open a block: a bit for each, so that no pair of a posting and a query is shuffled
    names = written(weights.select("query_idx").distinct(), "names")
    numbered = written(names.withColumn("at", F.row_number().over(Window.orderBy("query_idx")) - 1), "numbered")
    long, bit = F.expr("cast(at div 64 as int)"), F.expr("cast(at % 64 as int)")
    weighed = written(weights.join(small_enough(numbered), "query_idx"), "weighed")
    n_longs = max(1, -(-numbered.count() // 64))

    def scored(some: DataFrame) -> DataFrame:
        bits = some.join(small_enough(numbered), "query_idx").select("run", "block", long.alias("long"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("bit"))
        opened = bits.groupBy("run", "block").agg(F.array(*(F.coalesce(F.bit_or(F.when(F.col("long") == j, F.col("bit"))), F.lit(0)) for j in range(n_longs))).alias("open"))
        pairs = held.select("term", "run", "block", "p").join(opened, ["run", "block"]).join(small_enough(weighed), "term").where(F.getbit(F.col("open")[long], bit) == 1)
        rows = pairs.select("query_idx", "run", "block", "weight", F.explode("p").alias("x"))
        sums = rows.groupBy("query_idx", "run", "block", F.col("x.key").alias(key)).agg(F.round(F.sum(F.col("weight") * _part(F.col("x.tf"), F.col("x.dl"), mean)), 6).alias("bm25"))
        return sums.select("query_idx", key, "bm25")

    ahead = written(scored(leading), "scored-first")
    bar = top_k(ahead, "bm25", key, k).where(F.col("rank") == k).select("query_idx", F.col("bm25").alias("bar"))
    rest = cells.join(small_enough(leading), ["query_idx", "run", "block"], "left_anti").join(small_enough(written(bar, "bars")), "query_idx", "left")
    # scores are rounded, bounds aren't
    rest = written(rest.where(F.col("bar").isNull() | (F.col("bound") >= F.col("bar") - 2e-6)).select("query_idx", "run", "block"), "rest")
    total = cells.count()
    skipped = total - rest.count() - leading.count()
    return Found(top_k(ahead.unionByName(scored(rest)), "bm25", key, k), total, skipped)
