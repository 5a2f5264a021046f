"""Collection: feeds to a table of raw items, batch by batch."""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill import schemas
from docmill.config import CollectConfig
from docmill.models import Fetcher
from docmill.operators.collect import collection_counts, items_from_entries, new_items, usable_feeds
from docmill.sources.fetch import get_simple
from docmill.sources.readers import entries_of, exists
from docmill.sources.writers import append_items, write_body_cache


def fetched_feeds(feeds: DataFrame, client: Fetcher, config: CollectConfig = CollectConfig(), sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """Feeds with ``body``, those that can't be fetched left out."""

    def scan(batches):
        for pdf in batches:
            body = [get_simple(client, u, config.request_timeout, config.max_retries, sleep) for u in pdf["url"]]
            out = pdf.assign(body=[None if b is None else b.decode("utf-8", "ignore") for b in body])
            yield out[out["body"].notna()]

    slim = usable_feeds(feeds).select("url", "label", "topics")
    return slim.mapInPandas(scan, "url string, label string, topics array<string>, body string")


def entries_table(feeds: DataFrame) -> DataFrame:
    """Entries of fetched feeds with source, topics and the ordinal ``ord`` (feed by feed in the order of addresses)."""
    rows = entries_of(feeds.withColumnRenamed("label", "source").withColumnRenamed("url", "feed_url"))
    return rows.withColumn("ord", F.struct("feed_url", "pos"))


def collect_items(spark: SparkSession, entries: DataFrame, path: str, as_of: datetime, config: CollectConfig = CollectConfig(), bodies: DataFrame | None = None, cache_path: str | None = None) -> DataFrame:
    """Adds the recent entries whose ids the table at ``path`` doesn't hold, and returns its counts. Run again, it adds nothing."""
    known = spark.read.schema(schemas.RAW_ITEMS).parquet(path) if exists(spark, path) else spark.createDataFrame([], schemas.RAW_ITEMS)
    items = items_from_entries(entries, F.lit(as_of), config.recent_days, bodies)
    fresh = new_items(items, known).withColumn("cached_path", F.lit(cache_path).cast("string"))
    fresh = fresh.select(*schemas.RAW_ITEMS.names).persist()
    try:
        if cache_path is not None:
            write_body_cache(fresh, cache_path, as_of.strftime("%Y-%m-%d"))
        append_items(fresh, path)
    finally:
        fresh.unpersist()
    return collection_counts(spark.read.schema(schemas.RAW_ITEMS).parquet(path))


def within_budget(steps: list[Callable[[], object]], seconds: float, clock: Callable[[], float] = time.monotonic) -> int:
    """Runs steps in turn until ``seconds`` have passed, and says how many ran."""
    began = clock()
    for k, step in enumerate(steps):
        if clock() - began > seconds:
            return k
        step()
    return len(steps)


def body_table(spark: SparkSession, pages: dict[str, str]) -> DataFrame:
    """(url, html) from a dict, for offline runs."""
    return spark.createDataFrame(pd.DataFrame({"url": list(pages), "html": list(pages.values())}), "url string, html string")
