"""Writers. A staged folder replaces the old one only when complete; between two renames there is neither."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def replace_table(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Writes beside ``path``, renames the old table away and the new one in. A reader sees the old or the new table whole, or none between the renames: this isn't atomic."""
    spark = df.sparkSession
    staged = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    df.write.format(form).save(staged)
    fs, target = _fs(spark, path)
    old = spark._jvm.org.apache.hadoop.fs.Path(f"{staged}.old")
    if fs.exists(target):
        fs.rename(target, old)
    if not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(staged), target):
        raise OSError(f"{staged} can't take the place of {path}")
    fs.delete(old, True)


def append_items(df: DataFrame, path: str) -> None:
    """A batch of new rows added to a table: the checkpoint after each feed."""
    df.write.mode("append").parquet(path)


def write_body_cache(items: DataFrame, path: str, run_date: str) -> None:
    """One row a body, by item_id, in the folder of its run date."""
    rows = items.select("item_id", "url", "title", "content", F.lit(run_date).alias("run_date"))
    rows.write.mode("append").partitionBy("run_date").parquet(path)


def write_envelope(df: DataFrame, path: str, array: str, order: str, **meta: object) -> None:
    """A JSON file of metadata and one array, for what is small enough to be one file: the selected articles and their like."""
    rest = [c for c in df.columns if c != order]
    rows = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("__at"), F.struct(*rest).alias("row")))), lambda x: x.row)
    one = df.agg(rows.alias(array)).select(*(F.lit(v).alias(k) for k, v in meta.items()), F.size(array).alias("count"), array)
    replace_table(one.coalesce(1), path, "json")


def write_lines(df: DataFrame, path: str, order: str = "line_id") -> None:
    """JSON lines in order, in one file."""
    replace_table(df.orderBy(order).coalesce(1), path, "json")


def write_vectors(df: DataFrame, path: str, key: str = "id") -> None:
    replace_table(df.select(key, "embedding"), path)
