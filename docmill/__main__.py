"""``python -m docmill``: one stage over tables on disk."""

from __future__ import annotations

import argparse
from datetime import datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from docmill import schemas
from docmill.config import CollectConfig, EnrichConfig, RetrieveConfig
from docmill.plans.collect import collect_items
from docmill.plans.enrich import enriched
from docmill.plans.retrieve import retrieve
from docmill.sources.readers import read_items, read_queries, read_rss
from docmill.sources.writers import replace_table, write_envelope


def arguments() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="docmill", description=__doc__)
    stage = out.add_subparsers(dest="stage", required=True)
    collect = stage.add_parser("collect", help="feed files to the table of raw items")
    collect.add_argument("--rss", required=True)
    collect.add_argument("--source", required=True)
    collect.add_argument("--as-of", required=True, type=datetime.fromisoformat)
    enrich = stage.add_parser("enrich", help="raw items and fetched pages to items with full text")
    enrich.add_argument("--robots", required=True, help="Parquet: domain, status, body")
    enrich.add_argument("--fetches", required=True, help="Parquet: url, status_code, final_url, html, paywall_detected")
    ranked = stage.add_parser("retrieve", help="items with full text and queries to ranked articles")
    ranked.add_argument("--queries", required=True, help="JSON: queries with query and expansions")
    for x in (enrich, ranked):
        x.add_argument("--items", required=True, help="JSON: articles")
    for x in (collect, enrich, ranked):
        x.add_argument("--out", required=True)
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = arguments().parse_args(argv)
    spark = spark or SparkSession.builder.appName("docmill").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.stage == "collect":
        rows = read_rss(spark, args.rss).withColumn("ord", F.struct(F.input_file_name(), F.monotonically_increasing_id()))
        rows = rows.withColumn("source", F.lit(args.source)).withColumn("topics", F.array().cast("array<string>"))
        collect_items(spark, rows, args.out, args.as_of, CollectConfig.load()).show()
    elif args.stage == "enrich":
        items = read_items(spark, args.items).withColumnRenamed("ord", "item_index")
        out, counts = enriched(items, spark.read.parquet(args.robots), spark.read.parquet(args.fetches), EnrichConfig.load())
        replace_table(out, args.out)
        counts.show(truncate=False)
    else:
        out = retrieve(read_items(spark, args.items, schemas.ENRICHED_ITEMS), read_queries(spark, args.queries), RetrieveConfig.load())
        write_envelope(out, args.out, "articles", "rank")


if __name__ == "__main__":
    main()
