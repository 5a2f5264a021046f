"""Enrichment gates: robots, paywalls, fetch status, extraction, language, length, with the reason of each failure."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions.text import filled
from docmill.functions.urls import netloc
from docmill.runtime import small_enough

#: What marks a page behind a paywall, in lower case.
PAYWALL_MARKS = ("paywall", "subscriber-only", "subscription required", "subscribe to read", "register to continue", "become a member", "premium content", "meter-count", "regwall", "article-locked", "content-gate", "piano.io", "meter.md")
#: Reasons in the order in which they are given.
REASONS = ("robots_disallow", "paywall", "http_4xx", "http_5xx", "timeout", "empty_response", "empty_extract", "lang_mismatch", "too_short")


def has_paywall(html: Column, status: Column | None = None) -> Column:
    """Whether a page fetched with status 200 has one of the marks."""
    low = F.lower(filled(html))
    found = F.lit(False)
    for mark in PAYWALL_MARKS:
        found = found | F.contains(low, F.lit(mark))
    return found if status is None else (status == 200) & found


def with_robots(items: DataFrame, robots: DataFrame, agent: str = "*", url: str = "url") -> DataFrame:
    """``items`` with ``allowed`` by their host's robots file; a host without one that is there and parses allows all."""

    @F.pandas_udf("boolean")
    def may_fetch(bodies: pd.Series, urls: pd.Series) -> pd.Series:
        parsers: dict[str, RobotFileParser] = {}
        out = []
        for body, address in zip(bodies, urls, strict=True):
            try:
                if body not in parsers:
                    parsers[body] = RobotFileParser()
                    parsers[body].parse(body.splitlines())
                out.append(parsers[body].can_fetch(agent, address))
            except Exception:  # noqa: BLE001  a broken file forbids nothing
                out.append(True)
        return pd.Series(out)

    good = robots.where((F.col("status") == 200) & F.col("body").isNotNull()).groupBy("domain").agg(F.max("body").alias("__robots")).withColumnRenamed("domain", "__domain")
    joined = items.withColumn("__host", netloc(F.col(url))).join(small_enough(good), F.col("__host") == F.col("__domain"), "left")
    ruled = joined.withColumn("allowed", F.when(F.col("__robots").isNotNull(), may_fetch(F.coalesce("__robots", F.lit("")), F.col(url))))
    return ruled.withColumn("allowed", F.coalesce("allowed", F.lit(True))).drop("__host", "__domain", "__robots")


def robots_statistics(robots: DataFrame) -> DataFrame:
    """One row: hosts whose robots file is known, and hosts without."""
    good = F.coalesce((F.col("status") == 200) & F.col("body").isNotNull(), F.lit(False))
    return robots.agg(F.count_if(good).alias("cached_domains"), F.count_if(~good).alias("failed_domains"))


def too_short(text: Column, abstract: Column, least: int = 1000) -> Column:
    """Shorter than ``least`` characters and than twice the abstract."""
    return (F.length(filled(text)) < least) & (F.length(filled(text)) < 2 * F.length(filled(abstract)))


def failure_reason(rows: DataFrame, languages: Sequence[str] = ("en",), least_chars: int = 1000) -> DataFrame:
    """``rows`` with ``failure_reason``, null for survivors: the first reason that holds.

    Rows have allowed, paywall_detected, status_code, html_size, clean_text, language_detected and abstract. A timed-out fetch has status 408, which is a 4xx; so
    ``timeout`` is status 0. An empty list of languages allows all.
    """
    status = F.coalesce(F.col("status_code"), F.lit(0))
    wrong = F.lit(False) if not languages else ~F.coalesce(F.col("language_detected").isin(*languages), F.lit(False))
    tests = (
        ~F.coalesce(F.col("allowed"), F.lit(True)),
        F.coalesce(F.col("paywall_detected"), F.lit(False)),
        (status >= 400) & (status < 500),
        status >= 500,
        status.isin(0, 408),
        F.coalesce(F.col("html_size"), F.lit(0)) == 0,
        filled(F.col("clean_text")) == "",
        wrong,
        too_short(F.col("clean_text"), F.col("abstract"), least_chars),
    )
    out = F.lit(None).cast("string")
    for reason, test in zip(reversed(REASONS), reversed(tests), strict=True):
        out = F.when(test, F.lit(reason)).otherwise(out)
    return rows.withColumn("failure_reason", out)


def survivors(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("failure_reason").isNull())


def failure_histogram(rows: DataFrame) -> DataFrame:
    """(failure_reason, n) of the rows that failed."""
    return rows.where(F.col("failure_reason").isNotNull()).groupBy("failure_reason").agg(F.count(F.lit(1)).alias("n"))


def enrichment_statistics(rows: DataFrame) -> DataFrame:
    """One row: attempted, succeeded, failed, skipped, dropped, failed_by_reason (a map). Rows with ``skipped`` weren't attempted."""
    skipped = F.coalesce(F.col("skipped"), F.lit(False))
    failed = F.col("failure_reason").isNotNull() & ~skipped
    counts = rows.agg(F.count_if(~skipped).alias("attempted"), F.count_if(~skipped & ~failed).alias("succeeded"), F.count_if(failed).alias("failed"), F.count_if(skipped).alias("skipped"), F.count_if(failed).alias("dropped"))
    reasons = failure_histogram(rows.where(~skipped)).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("failure_reason", "n")))).alias("failed_by_reason"))
    return counts.crossJoin(reasons)


def merged_result(items: DataFrame, results: DataFrame) -> DataFrame:
    """Items with has_fulltext, full_text, extraction_method and full_text_words of ``results`` by item_index; items without a result keep theirs."""
    new = results.select("item_index", *(F.col(c).alias(f"__{c}") for c in ("full_text", "extraction_method", "full_text_words")))
    out = items.join(new, "item_index", "left")
    there = F.col("__full_text").isNotNull()
    out = out.withColumn("has_fulltext", F.coalesce(F.col("has_fulltext"), F.lit(False)) | there)
    for c in ("full_text", "extraction_method", "full_text_words"):
        out = out.withColumn(c, F.when(there, F.col(f"__{c}")).otherwise(F.col(c)))
    return out.select(*items.columns)
