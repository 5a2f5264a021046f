"""Incremental collection as a stream: each item once, late ones within the watermark, appended batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docmill import schemas
from docmill.functions.urls import item_key


def item_stream(spark: SparkSession, path: str) -> DataFrame:
    """Raw items from a folder of Parquet files, as they come."""
    return spark.readStream.schema(schemas.RAW_ITEMS).parquet(path)


def once(items: DataFrame, late: str = "3 days") -> DataFrame:
    """Items with their key, the first of each; what is later than ``late`` behind the latest is dropped, as is its state."""
    keyed = items.withColumn("item_id", F.coalesce("item_id", item_key(F.col("url"))))
    return keyed.withWatermark("published_at", late).dropDuplicatesWithinWatermark(["item_id"])


def run_ingest(spark: SparkSession, source: str, target: str, checkpoint: str, late: str = "3 days") -> StreamingQuery:
    """Takes what is there, exactly once over restarts, and stops."""
    return once(item_stream(spark, source), late).writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", target).trigger(availableNow=True).start()
