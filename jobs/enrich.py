"""Enrichment of fetched pages: text, domain and language of each, and the gate that stops it, if one does.

Pages go through the gates in their order: a paywall or an empty page is settled natively and its HTML isn't parsed. The output of a day is written under ``day=.../outcome=...``,
``kept`` or the reason; a run for a day that is there replaces that day alone, with the same result.

Edge cases: a page without HTML is an ``empty_response``; one without enough words an ``empty_extract``. Rows that share an id are judged one by one.
"""

from __future__ import annotations

import logging
import os
import re
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions import text as tx
from docmill.functions.html import html_text
from docmill.functions.language import detect
from docmill.functions.urls import item_key, registered_domain
from docmill.operators.enrich import failure_reason, has_paywall
from jobs.common import parsed

LOG = logging.getLogger("jobs.enrich")
CONFIG = os.path.join(os.path.dirname(os.path.abspath(__file__)), "enrich.json")
PAGES = "page_id long, url string, html string"
ENRICHED = "page_id long, item_id string, url string, domain string, language string, n_words int, full_text string, outcome string"


def enriched(pages: DataFrame, languages: list[str], least_words: int, least_chars: int) -> DataFrame:
    """Every page with its outcome. ``full_text`` is null where a gate before extraction stops the page."""
    wall, size = has_paywall(F.col("html")), F.coalesce(F.length("html"), F.lit(0))
    rows = pages.select("page_id", "url", wall.alias("paywall_detected"), size.alias("html_size"), F.when(~wall & (size > 0), F.col("html")).alias("html"))
    rows = rows.withColumn("full_text", F.when(F.col("html").isNotNull(), html_text(F.col("html")))).withColumn("n_words", tx.word_count(F.col("full_text")))
    rows = rows.withColumns({
        "allowed": F.lit(True), "status_code": F.lit(200), "clean_text": F.when(F.col("n_words") >= least_words, F.col("full_text")),
        "language_detected": detect(F.col("full_text")), "abstract": F.split_part(F.coalesce("full_text", F.lit("")), F.lit("\n"), F.lit(1)),
    })
    judged = failure_reason(rows, languages, least_chars)
    outcome = F.coalesce("failure_reason", F.lit("kept"))
    return judged.select("page_id", item_key(F.col("url")).alias("item_id"), "url", registered_domain(F.col("url")).alias("domain"), F.col("language_detected").alias("language"), "n_words", "full_text", outcome.alias("outcome"))


def run(spark: SparkSession, source: str, target: str, day: str, languages: list[str] | None = None, least_words: int = 200, least_chars: int = 1000) -> dict[str, int]:
    """Enriches the pages at ``source`` as those of ``day``; rows by outcome."""
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", day):
        raise ValueError("day has to be YYYY-MM-DD")
    path = f"{target}/day={day}"
    pages = spark.read.schema(PAGES).parquet(source)
    enriched(pages, languages or [], least_words, least_chars).write.mode("overwrite").partitionBy("outcome").parquet(path)
    counts = {r["outcome"]: r["n"] for r in spark.read.schema(ENRICHED).parquet(path).groupBy("outcome").agg(F.count(F.lit(1)).alias("n")).collect()}
    LOG.info("read %d pages of %s, wrote %s to %s", sum(counts.values()), source, counts, path)
    return counts


def main(argv: list[str] | None = None) -> None:
    args, settings = parsed(__doc__, ("source", "target", "day"), CONFIG, argv)
    spark = SparkSession.builder.appName("enrich").getOrCreate()
    try:
        run(spark, args.source, args.target, args.day, **settings)
    finally:
        spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
