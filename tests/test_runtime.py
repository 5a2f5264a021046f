import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from docmill.llm import substring_dedup, suffix_dedup
from docmill.runtime import SHUFFLES_END, written


def shuffle_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {name for name in blocks.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in name}


def test_a_written_table_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    counted = spark.range(10000).repartition(3).groupBy((F.col("id") % 100).alias("k")).count()
    table = written(counted.join(spark.range(100).withColumnRenamed("id", "k").hint("merge"), "k"), "counted")
    until = time.time() + 3  # executors are told to delete, and no garbage is collected for it
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffle_files(spark) - before
    assert table.count() == 100


def test_the_setting_is_as_it_was(spark):
    for value in ("false", "true"):
        spark.conf.set(SHUFFLES_END, value)
        written(spark.range(3), "three")
        assert spark.conf.get(SHUFFLES_END) == value
    spark.conf.unset(SHUFFLES_END)
    written(spark.range(3), "three")
    assert spark.conf.get(SHUFFLES_END) == "false"


@pytest.mark.parametrize("module, operator", [(suffix_dedup, "suffix_dedup"), (substring_dedup, "substring_dedup")])
def test_no_step_leaves_texts_in_shuffle_files(spark, monkeypatch, module, operator):
    rng = random.Random(5)
    say = lambda n: " ".join(f"{rng.getrandbits(40):x}" for _ in range(n))
    passage = say(100)
    texts = [f"{say(300)} {passage} {say(300)}" for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    before, most, left = shuffle_files(spark), sum(map(len, texts)) // 10, {}
    size = lambda: sum(Path(f).stat().st_size for f in shuffle_files(spark) - before if Path(f).exists())

    def measured(df, label):
        table, until = written(df, label), time.time() + 3
        while size() > most and time.time() < until:
            time.sleep(0.1)
        left[label] = size()
        return table

    monkeypatch.setattr(module, "written", measured)
    assert getattr(module, operator)(docs).count() == len(texts)
    assert left and max(left.values()) <= most, left
