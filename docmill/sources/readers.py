"""Readers of the tables that stages exchange: envelopes of one array, bare arrays, JSON lines, feeds, vector tables."""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill import schemas


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def read_envelope(spark: SparkSession, path: str, array: str, schema: T.StructType, ordinal: str = "ord") -> DataFrame:
    """The elements of one array of a JSON file with their position as ``ordinal``. A missing or broken file, or one without the array, gives no rows;
    a file that is a bare array is that array."""
    empty = spark.createDataFrame([], T.StructType([T.StructField(ordinal, T.IntegerType()), *schema.fields]))
    if not exists(spark, path):
        return empty
    raw = spark.read.text(path, wholetext=True)
    inner = T.StructType([T.StructField(array, T.ArrayType(schema))])
    bare = F.from_json("value", T.ArrayType(schema))
    boxed = F.from_json("value", inner)[array]
    body = F.when(F.startswith(F.ltrim("value"), F.lit("[")), bare).otherwise(boxed)
    return raw.where(F.try_parse_json("value").isNotNull()).select(F.posexplode(body).alias(ordinal, "row")).where("row is not null").select(ordinal, "row.*")


def read_feeds(spark: SparkSession, path: str) -> DataFrame:
    """(url, label, topics, user_agent) of the allowlist."""
    table = spark.read.schema(schemas.FEED_FILE).option("multiLine", True).json(path)
    return table.select(F.col("defaults.user_agent").alias("user_agent"), F.explode("feeds").alias("f")).select("f.*", "user_agent")


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query_idx, query, expansions) in the order of the file."""
    return read_envelope(spark, path, "queries", schemas.QUERIES, "query_idx")


def read_items(spark: SparkSession, path: str, schema: T.StructType = schemas.ENRICHED_ITEMS) -> DataFrame:
    return read_envelope(spark, path, "articles", schema)


def read_rss(spark: SparkSession, path: str) -> DataFrame:
    """Entries of RSS files (of Atom ones with row tag ``entry``: :func:`entries_of`)."""
    schema = "link string, guid string, title string, summary string, description string, pubDate string, published string, updated string, created string"
    rows = spark.read.format("xml").option("rowTag", "item").option("ignoreNamespace", True).schema(schema).load(path)
    return rows.select("link", F.col("guid").alias("id"), "title", "summary", "description", F.coalesce("published", "pubDate").alias("published"), "updated", "created")


def entries_of(feeds: DataFrame, body: str = "body") -> DataFrame:
    """Entries of feed documents in a column, RSS and Atom, with the other columns and the position ``pos``. A document that doesn't parse has none."""
    fields = "link string, id string, title string, summary string, description string, published string, updated string, created string"

    def local(tag):
        return tag.rpartition("}")[2]

    def one(document):
        try:
            root = ET.fromstring(document or "")
        except ET.ParseError:
            return []
        rows = []
        for node in root.iter():
            if local(node.tag) not in ("item", "entry"):
                continue
            row = {}
            for child in node:
                name = {"guid": "id", "pubDate": "published", "content": "summary"}.get(local(child.tag), local(child.tag))
                text = child.get("href") or child.text if name == "link" else child.text
                if name == "link" and child.get("rel", "alternate") != "alternate":
                    continue
                if text is not None:
                    row.setdefault(name, text)
            rows.append({f.split()[0]: row.get(f.split()[0]) for f in fields.split(", ")})
        return rows

    @F.pandas_udf(f"array<struct<{fields.replace(' string', ': string')}>>")
    def parse(documents: pd.Series) -> pd.Series:
        return documents.map(one)

    rest = [c for c in feeds.columns if c != body]
    return feeds.select(*rest, F.posexplode(parse(F.col(body))).alias("pos", "e")).select(*rest, "pos", "e.*")


def read_script_lines(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; blank ones are passed over."""
    return spark.read.schema(schemas.SCRIPT_LINES).json(path)


def read_vectors(spark: SparkSession, path: str, key: str = "id") -> DataFrame:
    return spark.read.parquet(path).select(key, "embedding")


def n_vectors(vectors: DataFrame) -> int:
    return vectors.count()
