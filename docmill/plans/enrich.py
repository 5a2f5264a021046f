"""Full-text enrichment as one set-oriented plan: gates from cheap to dear, each row's first failure named."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.config import EnrichConfig
from docmill.functions.html import extract_chain, html_variants
from docmill.functions.language import detect
from docmill.functions.urls import registered_domain
from docmill.operators.enrich import enrichment_statistics, failure_reason, merged_result, survivors, with_robots
from docmill.runtime import written


def worklist(items: DataFrame, force: bool = False) -> DataFrame:
    """(item_index, url, title, source_domain, abstract, skipped): enriched items are skipped unless ``force``."""
    done = F.coalesce(F.col("has_fulltext"), F.lit(False)) & F.lit(not force)
    return items.select("item_index", "url", "title", registered_domain(F.col("url")).alias("source_domain"), F.col("content").alias("abstract"), done.alias("skipped"))


def enriched(items: DataFrame, robots: DataFrame, fetches: DataFrame, config: EnrichConfig = EnrichConfig(), agent: str = "*") -> tuple[DataFrame, DataFrame]:
    """(survivors with their full text, statistics). ``items`` have ``item_index``; ``fetches`` are ``schemas.FETCHES``, one row a url.

    A row that a cheap gate stops doesn't reach extraction, as its page is nulled before the UDF.
    """
    rows = with_robots(worklist(items, config.force), robots, agent)
    # of repeated addresses one whole fetch: a success before others, then the higher status, the longer page; equal in all that, the rows are alike
    row = F.struct("status_code", "html", "paywall_detected")
    rank = F.struct(F.coalesce(F.col("status_code") == 200, F.lit(False)).alias("ok"), "status_code", F.octet_length("html").alias("size"), F.xxhash64("html").alias("hash"), "paywall_detected")
    pages = fetches.groupBy("url").agg(F.max_by(row, rank).alias("page")).select("url", "page.*")
    rows = rows.join(pages, "url", "left").withColumn("html_size", F.octet_length("html")).withColumn("paywall_detected", F.col("paywall_detected") & F.lit(config.respect_paywalls))
    open_page = ~F.col("skipped") & F.col("allowed") & ~F.coalesce("paywall_detected", F.lit(False)) & (F.coalesce("status_code", F.lit(0)) == 200)
    rows = rows.withColumn("page", F.when(open_page, F.col("html"))).drop("html")
    rows = rows.withColumn("x", extract_chain(F.col("page"), config.extractor_sequence, config.min_accept_words, config.max_full_text_chars))
    rows = rows.select("*", F.col("x.clean_text").alias("clean_text"), F.col("x.word_count").alias("full_text_words"), F.col("x.extraction_method").alias("extraction_method")).drop("x", "page")
    rows = failure_reason(rows.withColumn("language_detected", detect(F.col("clean_text"))), config.lang_allowlist, config.min_full_text_chars)
    rows = written(rows.withColumn("failure_reason", F.when(~F.col("skipped"), F.col("failure_reason"))), "enriched")
    kept = survivors(rows).select("item_index", F.col("clean_text").alias("full_text"), "extraction_method", "full_text_words")
    out = merged_result(items.join(kept.select("item_index"), "item_index", "left_semi"), kept)
    return out, enrichment_statistics(rows)


def variant_urls(fetches: DataFrame, config: EnrichConfig = EnrichConfig()) -> DataFrame:
    """(url, variant): AMP and print addresses of fetched pages, to fetch where a page itself has too little text; none unless the settings allow."""
    out = fetches.select("url", F.explode(html_variants(F.col("html"), F.col("url"))).alias("variant"))
    return out if config.allow_amp_print_variants else out.limit(0)
