"""Collection: feed entries to new items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions.html import html_text
from docmill.functions.text import filled, non_empty, strip
from docmill.functions.urls import entry_url, is_recent, item_key, published


def usable_feeds(feeds: DataFrame) -> DataFrame:
    """Feeds with an address; a feed without label is named by its address."""
    return feeds.where(non_empty(F.col("url")).isNotNull()).withColumn("label", F.coalesce(non_empty(F.col("label")), F.col("url")))


def recent(rows: DataFrame, when: Column, as_of: Column, days: int = 3) -> DataFrame:
    """Rows no older than ``days`` at ``as_of``, which the caller fixes."""
    return rows.where(is_recent(when, as_of, days))


def items_from_entries(entries: DataFrame, as_of: Column, days: int = 3, bodies: DataFrame | None = None) -> DataFrame:
    """Entries (of ``schemas.ENTRIES`` with source, topics and an ordinal ``ord``) as raw items.

    An unparseable date counts as ``as_of``, so as recent. The content is the summary's or description's text, even if that cleans
    to nothing; without either it is the text of ``bodies`` (url, html), and without that the entry goes.
    """
    out = entries.select(
        "ord", "source", "topics",
        entry_url(F.col("link"), F.col("id")).alias("url"),
        strip(filled(F.col("title"))).alias("title"),
        published(F.col("published"), F.col("updated"), F.col("created"), as_of).alias("published_at"),
        F.coalesce(non_empty(F.col("summary")), non_empty(F.col("description"))).alias("summary"),
    )
    out = recent(out.where((F.col("url") != "") & (F.col("title") != "")), F.col("published_at"), as_of, days)
    if bodies is not None:
        out = out.join(bodies.select("url", F.col("html").alias("body")).dropDuplicates(["url"]), "url", "left")
    else:
        out = out.withColumn("body", F.lit(None).cast("string"))
    # both texts pass one UDF: the summary's if there is one
    text = html_text(F.coalesce(F.col("summary"), F.col("body").cast("string")))
    out = out.withColumn("content", text).where(F.col("summary").isNotNull() | (F.coalesce("content", F.lit("")) != ""))
    return out.select("ord", item_key(F.col("url")).alias("item_id"), "source", "url", "title", "published_at", "topics", "content")


def first_by(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("__first", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__first = 1").drop("__first")


def new_items(items: DataFrame, known: DataFrame) -> DataFrame:
    """Items whose id isn't in ``known``; of several new ones with one id the first by ``ord``."""
    return first_by(items.join(known.select("item_id").distinct(), "item_id", "left_anti"), ["item_id"], F.col("ord").asc())


def collection_counts(items: DataFrame) -> DataFrame:
    """One row: feeds, items, and items with title, address and content."""
    whole = (filled(F.col("title")) != "") & (filled(F.col("url")) != "") & (filled(F.col("content")) != "")
    return items.agg(F.countDistinct("source").alias("n_feeds"), F.count(F.lit(1)).alias("n_items"), F.count_if(whole).alias("n_non_empty"))


def short_of(items: DataFrame, least: int = 10) -> bool:
    """Whether fewer than ``least`` items are complete: a driver-side warning."""
    return collection_counts(items).first()["n_non_empty"] < least
