"""Fusion of dense and lexical scores, roll-up to articles, merge over queries, and the cap a query."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions.text import snippet
from docmill.operators.bm25 import top_k
from docmill.operators.collect import first_by


def fused(dense: DataFrame, lexical: DataFrame, key: str, alpha: float = 0.25, k_merge: int = 500) -> DataFrame:
    """(query_idx, key, dense, bm25, hybrid): both lists joined in full, a missing side 0; hybrid = alpha x bm25 + (1 - alpha) x dense; the best ``k_merge``."""
    both = dense.select("query_idx", key, "dense").join(lexical.select("query_idx", key, "bm25"), ["query_idx", key], "full_outer").fillna(0.0, ["dense", "bm25"])
    scored = both.withColumn("hybrid", F.round(F.lit(alpha) * F.col("bm25") + F.lit(1 - alpha) * F.col("dense"), 8))
    return top_k(scored, "hybrid", key, k_merge).drop("rank")


def rolled_up(scored: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """For each query and article its best chunk by hybrid, the first by ``key`` of equals; chunks that score 0 or less don't count."""
    named = scored.where(F.col("hybrid") > 0).join(chunks.select(key, "item_id", "chunk_index"), key)
    rest = [c for c in named.columns if c not in ("query_idx", "item_id")]
    best = F.max_by(F.struct(*rest), F.struct("hybrid", -F.col(key)))
    return named.groupBy("query_idx", "item_id").agg(best.alias("b")).select("query_idx", "item_id", "b.*")


def merged(rolled: DataFrame, key: str) -> DataFrame:
    """For each article its best score over all queries, the earliest query's of equals, and the queries that matched it in their order."""
    rest = [c for c in rolled.columns if c not in ("query_idx", "item_id")]
    best = F.max_by(F.struct(*rest), F.struct("hybrid", -F.col("query_idx")))
    out = rolled.groupBy("item_id").agg(F.array_sort(F.collect_set("query_idx")).alias("matched"), best.alias("b"))
    return out.select("item_id", "b.*", "matched", F.element_at("matched", 1).alias("primary_query"))


def capped(articles: DataFrame, cap: int = 8) -> DataFrame:
    """The best ``cap`` articles of each primary query (the first that matched); articles no query matched go."""
    order = Window.partitionBy("primary_query").orderBy(F.col("hybrid").desc(), F.col("item_id").asc())
    return articles.where(F.size("matched") > 0).withColumn("query_rank", F.row_number().over(order)).where(F.col("query_rank") <= cap)


def described(winners: DataFrame, chunks: DataFrame, articles: DataFrame, key: str) -> DataFrame:
    """Winners with their chunk's and article's columns; defaults where an article isn't found; of articles with one id the last counts."""
    text = chunks.select(key, "source", "url", "title", "published_at", "topics", "chunk_index", "char_start", "char_end", snippet(F.col("text")).alias("snippet"))
    last = first_by(articles.select("item_id", "ord", "has_fulltext", "full_text_words", "full_text"), ["item_id"], F.col("ord").desc()).drop("ord")
    out = winners.drop("chunk_index").join(text, key).join(last, "item_id", "left")
    return out.select(
        "item_id", "title", "source", "url", "published_at", "topics",
        F.struct("dense", F.col("bm25").alias("lexical"), "hybrid").alias("score"),
        F.struct("chunk_index", "snippet", F.array("char_start", "char_end").alias("char_range")).alias("best_chunk"),
        F.coalesce("has_fulltext", F.lit(True)).alias("has_fulltext"),
        F.coalesce("full_text_words", F.lit(0)).alias("full_text_words"),
        F.coalesce("full_text", F.lit("")).alias("full_text"),
        *[c for c in winners.columns if c not in {"item_id", "dense", "bm25", "hybrid", "chunk_index"}],
    )
