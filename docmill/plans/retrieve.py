"""Hybrid retrieval: articles and a query set to a short, diverse, ranked list."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docmill.config import RetrieveConfig
from docmill.functions.text import expanded_query, retrieval_text
from docmill.models import Embedder, HashedEmbedder, named_embedder
from docmill.operators import bm25, hybrid
from docmill.operators.chunk import chunked
from docmill.operators.dedup import deduplicated
from docmill.operators.mmr import mmr_select
from docmill.operators.vector import embedded, vector_top_k
from docmill.runtime import small_enough, written

KEY = "chunk_key"


def article_chunks(articles: DataFrame, config: RetrieveConfig = RetrieveConfig()) -> DataFrame:
    """Chunks of deduplicated articles with ``chunk_key``, which orders them by article and place without a global sort.

    Articles have the columns of ``schemas.ENRICHED_ITEMS`` and a unique ``ord`` below 2**40.
    """
    once = deduplicated(articles)
    text = retrieval_text(F.col("full_text"), F.col("has_fulltext"), F.col("full_text_words"), F.col("content"), F.col("title"))
    rows = once.select("item_id", "source", "url", "title", "published_at", "topics", "position", text.alias("text"))
    out = chunked(rows, "text", config.chunk_size, config.chunk_overlap)
    at = F.col("position.src").cast("long") * F.lit(1 << 40) + F.col("position.ord").cast("long")
    # past 2**20 chunks (over a gigabyte of text) two articles' keys would meet
    place = F.when(F.col("chunk_index") < 1 << 20, F.col("chunk_index")).otherwise(F.raise_error(F.lit("an article of more than 2**20 chunks")).cast("int"))
    return out.withColumn(KEY, at * F.lit(1 << 20) + place).drop("position")


def scored_chunks(chunks: DataFrame, queries: DataFrame, config: RetrieveConfig = RetrieveConfig(), model: Embedder | None = None) -> DataFrame:
    """(query_idx, chunk_key, dense, bm25, hybrid) of each query's candidates. Queries have query_idx, query, expansions."""
    model = model or HashedEmbedder()
    asked = queries.select("query_idx", expanded_query(F.col("query"), F.col("expansions")).alias("query"))
    dense = vector_top_k(embedded(chunks.select(KEY, "text"), "text", model), embedded(asked, "query", model), KEY, config.k_ann)
    found = written(bm25.bm25_top_k(chunks.select(KEY, "text"), asked, KEY, config.k_bm25), "lexical")
    lexical = bm25.normalised(found, "bm25").withColumn("bm25", F.round("bm25", 6))
    return hybrid.fused(dense, lexical, KEY, config.alpha_lexical, config.k_merge)


def merged_articles(scored: DataFrame, chunks: DataFrame) -> DataFrame:
    return hybrid.merged(hybrid.rolled_up(scored, chunks, KEY), KEY)


def candidates(chunks: DataFrame, queries: DataFrame, config: RetrieveConfig = RetrieveConfig(), model: Embedder | None = None) -> DataFrame:
    """The best articles of each primary query, written."""
    return written(hybrid.capped(merged_articles(scored_chunks(chunks, queries, config, model), chunks), config.per_query_cap), "capped")


def diversified(capped: DataFrame, chunks: DataFrame, config: RetrieveConfig = RetrieveConfig(), model: Embedder | None = None) -> DataFrame:
    """(item_id, rank) of at most ``final_limit`` candidates, by their scores and the vectors of their best chunks."""
    vectors = embedded(chunks.join(small_enough(capped.select(KEY)), KEY, "left_semi").select(KEY, "text"), "text", model or HashedEmbedder()).select(KEY, "embedding")
    return mmr_select(capped.join(vectors, KEY, "left"), config.final_limit, config.mmr_lambda)


def retrieve(articles: DataFrame, queries: DataFrame, config: RetrieveConfig = RetrieveConfig(), model: Embedder | None = None) -> DataFrame:
    """At most ``final_limit`` articles in order of ``rank``, with scores, best chunk, and the queries that matched."""
    model = model or named_embedder(config.embedding_model)
    chunks = written(article_chunks(articles, config), "chunks")
    capped = candidates(chunks, queries, config, model)
    # at most `final_limit` rows
    order = diversified(capped, chunks, config, model)
    chosen = capped.join(F.broadcast(order), "item_id")
    names = queries.select(F.col("query_idx").alias("__q"), F.col("query").alias("__query"))
    matched = chosen.select("item_id", F.explode("matched").alias("__q")).join(small_enough(names), "__q").groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("__q", "__query"))).alias("m"))
    matched = matched.select("item_id", F.transform("m", lambda x: x["__query"]).alias("matched_queries"))
    full = hybrid.described(chosen.drop("matched", "query_rank"), chunks, articles, KEY)
    return full.join(matched, "item_id", "left").drop(KEY, "primary_query")


def retrieval_statistics(chunks: DataFrame, merged: DataFrame, capped: DataFrame, final: DataFrame) -> DataFrame:
    """One row of counts along the way."""
    parts = [df.agg(F.count(F.lit(1)).alias(name)) for name, df in (("n_chunks", chunks), ("n_candidates", merged), ("n_after_cap", capped), ("n_final", final))]
    out = parts[0]
    for part in parts[1:]:
        out = out.crossJoin(part)
    return out


def ranked(rows: DataFrame) -> DataFrame:
    """Rows with ``rank`` renewed from 1 in their order, for a short list."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy("rank")))
