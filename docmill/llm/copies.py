"""Exact copies: classes of documents with one fingerprint, each represented by its smallest id."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.words import as_bytes
from docmill.runtime import join_keys, small_enough, written

SLIM = "doc_id long, n long, f1 long, f2 long"


def slim(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def fingerprints(docs: DataFrame, of: Callable[[list[bytes]], tuple[list[int], list[int], list[int]]]) -> DataFrame:
    """(doc_id, n, f1, f2) of every row, written. ``of`` gives sizes and two 64-bit hashes of a list of texts."""

    def scan(parts):
        for batch in parts:
            n, f1, f2 = of(as_bytes(batch.column("text")))
            both = (pa.array(np.array(f, np.uint64).view(np.int64)) for f in (f1, f2))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), *both], names=["doc_id", "n", "f1", "f2"])

    return written(slim(docs).mapInArrow(scan, SLIM), "fingerprints")


def classes_of(prints: DataFrame) -> DataFrame:
    """(f1, f2, n, rep, members), written; rows without id don't take part."""
    return written(prints.where(F.col("doc_id").isNotNull()).groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("members")), "classes")


def with_copy_marks(docs: DataFrame, prints: DataFrame, classes: DataFrame) -> DataFrame:
    """(doc_id, text, copy_of): ``copy_of`` lists the fingerprints under which this id is a copy of a smaller id, null for none.

    The larger table is shuffled only if the list of copies is counted to be too long for a broadcast.
    """
    later = join_keys(prints, classes.where(F.col("members") > 1), ["f1", "f2", "n"], "members").where(F.col("doc_id") > F.col("rep"))
    marks = written(later.groupBy("doc_id").agg(F.collect_set("f1").alias("copy_of")).withColumnRenamed("doc_id", "__id"), "copies")
    return slim(docs).join(small_enough(marks), F.col("doc_id") == F.col("__id"), "left").select("doc_id", "text", "copy_of")
