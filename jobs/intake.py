"""Incremental intake of articles: takes the files of a growing table that it hasn't seen, and stores each article once.

A file stream (``availableNow``) keeps in its checkpoint which files are done. Each batch drops rows without text, keeps of equal texts the one with the smallest id,
leaves out what earlier batches have stored, and writes the rest under ``batch=.../source=...``. A batch that is run again after a failure overwrites its own partitions and
looks only at earlier ones, so the result is the same. Target and checkpoint belong together: use both or neither again.

Only ids of stored items are read to find what is known; where a batch has few ids they are sent to that scan, and neither side is shuffled whole.

Edge cases: null and empty texts, and texts under ``least_words`` words, are counted and left out; rows without id come after all others of their text; a null source is a
partition of its own. A run without new files writes nothing. Columns other than ``doc_id``, ``text`` and ``source`` are not read.
"""

from __future__ import annotations

import logging
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions import text as tx
from docmill.functions.language import detect
from docmill.functions.urls import item_key
from docmill.operators.collect import first_by
from docmill.runtime import small_enough
from jobs.common import parsed, stored

LOG = logging.getLogger("jobs.intake")
CONFIG = os.path.join(os.path.dirname(os.path.abspath(__file__)), "intake.json")
SOURCE = "doc_id long, text string, source string"
ITEMS = "item_id string, doc_id long, title string, segment_id string, language string, n_words int, secs double, text string, batch long, source string"
LEDGER = "n_read long, n_unfit long, n_stored long, n_repeated long, batch long"


def items_of(docs: DataFrame) -> DataFrame:
    """Articles with their key and what later stages need, from native expressions only."""
    title = F.split_part("text", F.lit("\n"), F.lit(1))
    return docs.select(
        item_key(F.col("text")).alias("item_id"), "doc_id", title.alias("title"), tx.segment_id(title).alias("segment_id"), detect(F.col("text")).alias("language"),
        tx.word_count(F.col("text")).alias("n_words"), F.round(tx.duration(F.col("text")), 6).alias("secs"), "text", "source",
    )


def run(spark: SparkSession, source: str, target: str, checkpoint: str, files_per_batch: int = 1000, least_words: int = 1, languages: list[str] | None = None) -> dict[str, int]:
    """Takes what is new in ``source`` (a folder, or a pattern of files or folders) and waits until it is stored; counts of this run. ``languages`` restricts what is stored, an empty list takes all."""
    items_path, ledger_path, totals = f"{target}/items", f"{target}/ledger", {"batches": 0, "n_read": 0, "n_unfit": 0, "n_stored": 0, "n_repeated": 0}

    def store(batch: DataFrame, batch_id: int) -> None:
        items = items_of(batch)
        fit = (F.coalesce(F.col("n_words"), F.lit(0)) >= least_words) & F.col("item_id").isNotNull()
        if languages:
            fit = fit & F.col("language").isin(*languages)
        counts = items.agg(F.count(F.lit(1)).alias("n_read"), F.count_if(~fit).alias("n_unfit")).first()
        good = items.where(fit)
        known = stored(spark, items_path, ITEMS).where(F.col("batch") < batch_id).select("item_id")
        if not known.isEmpty():
            # the batch's ids among the stored ones: where they are few, they are sent to the scan of those
            known = known.join(small_enough(good.select("item_id").distinct()), "item_id", "left_semi").distinct()
            good = good.join(known, "item_id", "left_anti")
        new = first_by(good, ["item_id"], F.col("doc_id").asc_nulls_last())
        new.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "source").parquet(items_path)
        n_stored = stored(spark, items_path, ITEMS).where(F.col("batch") == batch_id).count()
        row = {"n_read": counts["n_read"], "n_unfit": counts["n_unfit"], "n_stored": n_stored, "n_repeated": counts["n_read"] - counts["n_unfit"] - n_stored}
        ledger = spark.createDataFrame([(*row.values(), batch_id)], LEDGER)
        ledger.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(ledger_path)
        LOG.info("batch %d: read %d rows of %s, stored %d in %s, left out %d unfit and %d repeated", batch_id, row["n_read"], source, n_stored, items_path, row["n_unfit"], row["n_repeated"])
        totals["batches"] += 1
        for k, v in row.items():
            totals[k] += v

    stream = spark.readStream.schema(SOURCE).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    LOG.info("run ended: %s", totals)
    return totals


def main(argv: list[str] | None = None) -> None:
    args, settings = parsed(__doc__, ("source", "target", "checkpoint"), CONFIG, argv)
    spark = SparkSession.builder.appName("intake").getOrCreate()
    try:
        run(spark, args.source, args.target, args.checkpoint, **settings)
    finally:
        spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
