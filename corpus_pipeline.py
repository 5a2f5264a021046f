"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Toxic documents go, repeated lines go, one document of each group of near duplicates stays, documents that leak benchmark items
go, and what is left is mixed to target weights. All stages but the last return the columns of ``documents`` (``n_chars`` follows
the text where lines were dropped); the last returns, for each document, how many of its words the mix takes.

Edge cases are those of the operators: null and empty texts pass the first four stages. Rows are judged one by one, whether they share an id or have none: the third
and fourth stage number them where ids don't tell them apart. Of equal texts the one with the smallest id stays, rows without id after
all others. Very long texts pass whole. Other columns pass through, whatever their names. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm.decontaminate import contamination
from docmill.llm.line_dedup import line_dedup
from docmill.llm.mixing import mix_sources
from docmill.llm.ngram_join import ngram_components
from docmill.llm.toxicity import fit_toxicity, score_toxicity
from docmill.runtime import discard, small_enough, written


KEY = "__row_key"


def _keyed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """``docs`` with a key for each row, and whether it is not the id: that is the key where each row has its own, else rows are numbered in a written copy."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    if ids.where(F.col("doc_id").isNull()).isEmpty() and ids.groupBy("doc_id").count().where(F.col("count") > 1).isEmpty():
        return docs.withColumn(KEY, F.col("doc_id").cast("long")), False
    return written(docs.withColumn(KEY, F.monotonically_increasing_id()), "keyed"), True


def _as_ids(keyed: DataFrame) -> DataFrame:
    return keyed.select(F.col(KEY).alias("doc_id"), "text")


def _without(keyed: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows whose key is not in ``gone`` (doc_id), which is broadcast only if counted to be small."""
    return keyed.join(small_enough(written(gone.select(F.col("doc_id").alias(KEY)), "gone")), KEY, "left_anti")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of being toxic is under one half."""
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model).where(F.col("toxic_probability") < 0.5).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that several repeat."""
    out = line_dedup(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links connect: the one with the smallest id, of several with it the first."""
    keyed, apart = _keyed(docs)
    groups = written(ngram_components(_as_ids(keyed)), "groups")
    gone = groups.where(F.col("doc_id") != F.col("component_id"))
    if apart:
        named = groups.where(F.col("n_shingles") > 0).join(keyed.select(F.col(KEY).alias("doc_id"), F.col("doc_id").cast("long").alias("id")), "doc_id")
        best = named.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "doc_id")).alias("b")).select("b.doc_id")
        gone = named.select("doc_id").join(best, "doc_id", "left_anti")
    return _without(keyed, gone).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    keyed, _ = _keyed(docs)
    found = contamination(_as_ids(keyed), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(keyed, found.select("doc_id").distinct()).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mix_sources(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
]

#: A fitted classifier, connected components of near duplicates and edit-distance search are beyond SQL; tests/llm/test_pipeline.py
#: holds every stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents`` in ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        after = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
