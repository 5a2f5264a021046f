"""Session-level helpers: the shared folder, written intermediate tables, size-checked broadcasts."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a slim side (ids and a few numbers a row) may be broadcast; larger ones are shuffled.
BROADCAST_ROWS = 1 << 16
#: Keys that may each hold more than one in so many rows are fewer than that.
HOT_KEYS = 1 << 10
#: Spark's setting by which the shuffle files of an execution go when it ends, not when the driver happens to collect its garbage.
SHUFFLES_END = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Only a local session may go without: it gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="docmill-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back: lineage is cut and a lost executor costs no recomputation.

    The shuffle files of the write are gone when it ends, as its rows are in the table.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docmill/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLES_END, None)
    spark.conf.set(SHUFFLES_END, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLES_END)
        else:
            spark.conf.set(SHUFFLES_END, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._docmill_path = path
    return table


def discard(table: DataFrame) -> None:
    """Deletes a table made by :func:`written` once nothing reads it any more."""
    path = getattr(table, "_docmill_path", None)
    if path:
        jvm, conf = table.sparkSession._jvm, table.sparkSession._jsc.hadoopConfiguration()
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)


def tidy(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files and broadcasts that nothing refers to any more, before more disk is taken."""
    gc.collect()
    spark._jvm.System.gc()


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most ``rows`` rows, so that a Python worker holds few long texts at once. It holds for the session."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def lean(scan: Callable) -> Callable:
    """``scan`` over the batches of a task, after which the worker, which serves other tasks, gives back what it no longer holds."""

    def run(batches):
        try:
            yield from scan(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return run


def is_small(table: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a (written, or else cheap) table is counted to be within ``rows``."""
    return table.limit(rows + 1).count() <= rows


def small_enough(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint only if ``table`` is counted to be within ``rows``; else Spark shuffles it."""
    return F.broadcast(table) if is_small(table, rows) else table


def join_keys(rows: DataFrame, side: DataFrame, keys: list[str], n: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """The inner join of ``rows`` with a written ``side`` that has each key once and in column ``n`` how many of ``rows`` have it.

    A small side is broadcast. Of a larger one only keys that hold over a ``HOT_KEYS``-th of the rows are, which are fewer than ``HOT_KEYS`` whatever
    the input; the others are joined by a shuffle in which no key is hot.
    """
    if is_small(side, limit):
        return rows.join(F.broadcast(side), keys)
    total = side.agg(F.sum(n)).first()[0] or 0
    hot = F.coalesce(F.col(n) * HOT_KEYS > F.lit(total), F.lit(False))
    few = F.broadcast(side.where(hot))
    cold = rows.join(F.broadcast(side.where(hot).select(*keys)), keys, "left_anti").join(side.where(~hot), keys)
    return rows.join(few, keys).unionByName(cold)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan (file sizes at a scan), to size sketches in proportion to the input."""
    return min(int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())), 1 << 50)
