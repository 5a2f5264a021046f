"""Article deduplication by address and by title."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.functions.text import filled, strip
from docmill.operators.collect import first_by
from docmill.runtime import small_enough, written


def latest_by_url(articles: DataFrame) -> DataFrame:
    """For each url the row with the latest ``published_at``, the first by ``ord`` of equals."""
    return first_by(articles, ["url"], F.col("published_at").desc_nulls_last(), F.col("ord").asc())


def longest_by_title(articles: DataFrame) -> DataFrame:
    """For each lower-cased, stripped title the row with most ``full_text_words``, the first by ``ord`` of equals."""
    keyed = articles.withColumn("__title", strip(F.lower(filled(F.col("title")))))
    return first_by(keyed, ["__title"], F.coalesce(F.col("full_text_words"), F.lit(0)).desc(), F.col("ord").asc()).drop("__title")


def deduplicated(articles: DataFrame, strict: bool = False) -> DataFrame:
    """The union of both winners, one row an ``item_id``: the title winner's values at the earlier position ``ord``.

    So rows with one title at different addresses all stay. ``strict`` keeps rows that win by both instead. Each row has an ``ord`` of its own.
    """
    # winners are chosen on keys and small columns; whole rows move once, to their winners, or not at all where these are few
    keys = articles.select("ord", "item_id", "url", "title", "published_at", "full_text_words")
    by_url, by_title = (w.select("item_id", "ord") for w in (latest_by_url(keys), longest_by_title(keys)))
    if strict:
        return articles.join(small_enough(written(by_url.join(by_title.select("ord"), "ord", "left_semi").select("ord"), "winners")), "ord", "left_semi")
    both = by_url.withColumn("__src", F.lit(0)).unionByName(by_title.withColumn("__src", F.lit(1)))
    # url winners come first in the order, then those that only won by title
    place = F.struct(F.col("__src").alias("src"), F.col("ord").alias("ord"))
    winners = both.groupBy("item_id").agg(F.min(place).alias("position"), F.max_by("ord", place).alias("ord")).select("ord", "position")
    return articles.join(small_enough(written(winners, "winners")), "ord").select(*articles.columns, "position")
