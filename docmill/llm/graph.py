"""Connected components of a table of links.

Links are dealt to tasks, a bounded number to each, which join them by union-find and give back a star for each
component of theirs. If that was one task, the stars are the answer. Else large-star and small-star steps join the stars of all tasks, until every
node has one parent and no parent has one. Every step joins and aggregates; only counts reach the driver. Each
round's links are written to the shared folder, so that lineage stays short and a lost executor repeats one round's task at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.runtime import discard, join_keys, written

#: Links that one task joins: 16 bytes each, and a few hundred as objects.
LINKS_A_TASK = 1 << 16


def _stars(parts):
    """Union-find over the links of a task: (u, v) with v the smallest node of u's component, u not itself."""
    up: dict[int, int] = {}

    def top(x):
        root = x
        while up[root] != root:
            root = up[root]
        while up[x] != root:
            up[x], x = root, up[x]
        return root

    for batch in parts:
        for a, b in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            up.setdefault(a, a)
            up.setdefault(b, b)
            lo, hi = sorted((top(a), top(b)))
            up[hi] = lo
    pairs = np.array([(x, r) for x in up if (r := top(x)) != x], np.int64).reshape(-1, 2)
    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])


def _is_forest_of_stars(links: DataFrame) -> bool:
    """Whether every node has one parent at most and no parent has one."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("parent")).unionByName(links.select(F.col("v").alias("node"), F.lit(0).alias("child"), F.lit(1).alias("parent")))
    return ends.groupBy("node").agg(F.sum("child").alias("child"), F.max("parent").alias("parent")).where((F.col("child") > 1) | (F.col("child") > 0) & (F.col("parent") > 0)).isEmpty()


def components(links: DataFrame, links_a_task: int = LINKS_A_TASK) -> DataFrame:
    """(node, component) of every node that has a link in ``links`` (u, v): the smallest node it reaches."""
    first = written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(F.col("u") > F.col("v")), "links")
    tasks = -(-first.count() // links_a_task)
    now = written(first.coalesce(max(1, tasks)).mapInArrow(_stars, "u long, v long"), "stars")
    discard(first)
    while tasks > 1 and not _is_forest_of_stars(now):
        # large star: larger neighbours of a node link to its smallest
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n")), "least")
        large = written(join_keys(both, least, ["u"], "n").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") > F.col("v")).distinct(), "large")
        # small star: smaller neighbours of a node, and itself, link to its smallest
        low = written(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "low")
        small = join_keys(large, low, ["u"], "n").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        after = written(small.where(F.col("u") > F.col("v")).distinct(), "links")
        for old in (now, least, large, low):
            discard(old)
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
