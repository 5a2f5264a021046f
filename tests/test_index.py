import random

import pytest
from pyspark.sql import functions as F

from docmill.operators import index
from docmill.operators.bm25 import bm25_top_k


def found(rows):
    return sorted((r["query_idx"], r["k"], r["bm25"], r["rank"]) for r in rows.collect())


def corpus(n, seed=1):
    rng = random.Random(seed)
    common, rare = ["the", "of", "and", "to"], [f"w{k}" for k in range(n)]
    rows = [(i, " ".join(rng.choice(common) for _ in range(rng.randint(3, 30))) + " " + " ".join(rng.choices(rare, k=rng.randint(1, 4)))) for i in range(n)]
    # ties, repeats within a text, one text very long, and texts without a word
    rows += [(n + 1, "w1 w1 w1 w2"), (n + 2, "w1 w1 w1 w2"), (n + 3, None), (n + 4, " \n "), (n + 5, "the " * 50_000 + "w3")]
    return rows


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}/index"


def queries(spark):
    asked = [(0, "w1 w2 the"), (1, "w3 w3 W4 of"), (2, "nothing known"), (3, ""), (4, "the and of to"), (5, "w10 w20 w30 w40 w50 w60")]
    return spark.createDataFrame(asked, "query_idx long, query string")


@pytest.mark.parametrize("first", [1, 4])
def test_appended_runs_equal_one_pass(spark, path, first):
    rows = corpus(600)
    docs = spark.createDataFrame(rows, "k long, text string").repartition(5)
    for run in range(3):
        index.append(docs.where(F.col("k") % 3 == run), "k", path, f"r{run}", block=7)
    out = index.search(spark, path, queries(spark), "k", "long", 5, first=first)
    assert found(out.rows) == found(bm25_top_k(docs, queries(spark), "k", 5)) and len(out.rows.columns) == 4
    assert index.size(spark, path) == len(rows) and 0 < out.skipped < out.cells


def test_appending_leaves_other_runs_and_rerunning_replaces(spark, path):
    docs = spark.createDataFrame(corpus(200), "k long, text string")
    index.append(docs.where("k < 100"), "k", path, "a", block=5)
    before = sorted(spark.read.parquet(f"{path}/blocks/run=a").inputFiles())
    index.append(docs.where("k > 150"), "k", path, "b", block=5)
    index.append(docs.where("k >= 100"), "k", path, "b", block=5)
    assert sorted(spark.read.parquet(f"{path}/blocks/run=a").inputFiles()) == before
    assert found(index.search(spark, path, queries(spark), "k", "long", 8).rows) == found(bm25_top_k(docs, queries(spark), "k", 8))


def test_string_keys_large_k_and_nothing(spark, path):
    assert index.search(spark, path, queries(spark), "k", "string", 3).rows.count() == 0 and index.size(spark, path) == 0
    docs = spark.createDataFrame(corpus(60), "k long, text string").withColumn("k", F.concat(F.lit("d"), F.col("k")))
    index.append(docs, "k", path, "only", block=1000)
    out = index.search(spark, path, queries(spark), "k", "string", 500)
    assert found(out.rows) == found(bm25_top_k(docs, queries(spark), "k", 500)) and out.skipped == 0
