"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Sources in code-point order (null last) weigh ``weights``, repeating, and share ``share`` of all words; a target
above ``most`` times the source's words is cut to that and the excess shared anew by weight among the others.
A source's target takes every document as often as it fits whole (complete epochs); for the rest, documents are
taken in the order of exponential keys -ln(u) / quality, u from a hash of the document's id, up to the word budget.
The document in which the budget ends is taken in part, so a source meets its target to the word.

The prefix sum within a source goes by key range, level by level: words summed per range of the keys, of which the one in which the budget ends is divided
further, into at most some 2048 each time. After the key come the id, the size and a row number, so that rows that share a key, all rows without id say, are divided
too. Only what at most ``LAST`` rows of a source are left for is sorted row by row. A source that holds a third of all rows is thus spread like any other, and
so is one whose budget ends among many like keys. Sources are ranked by ranges too, and the shares found by passes that bring two numbers to the driver;
each caps at least one more source, so they end.

Edge cases: null text has size 0, as has empty text; a null source is a source of its own, after the others; null
ids are one id. Rows that agree in id and size are interchangeable; each is taken on its own. With no words at all every target is 0. An
empty table gives an empty table. Very long texts count like others: a budget may end inside one. Other columns don't matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.runtime import discard, is_small, join_keys, written

#: Rows of a source that may be sorted in one task.
LAST = 1 << 13
_BLANK = " \t\n\x0b\f\r"
#: Characters that speak against a text's quality.
_MARKS = "0123456789#*$%&|<>{}[]()!_=/\\@"


def n_words(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; null has none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(_BLANK))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, "[ \\t-\\r]+"))).cast("long")


def quality_weight(text: Column) -> Column:
    """The share of a text's characters that are neither digits nor marks, 0.05 at least."""
    filled = F.coalesce(text, F.lit(""))
    return F.greatest(F.lit(0.05), F.coalesce(F.try_divide(F.length(F.translate(filled, _MARKS, "")).cast("double"), F.length(filled).cast("double")), F.lit(0.05)))


def sampling_key(doc_id: Column, weight: Column, seed: int) -> Column:
    """-ln(u) / weight with u in (0, 1) from the md5 of the id and the seed."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f":{seed}")))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / weight


def ranked(table: DataFrame, column: str) -> DataFrame:
    """``table`` with ``rank``, from 0, by ``column`` (null last): ranges first, then rows within each range."""
    order = F.col(column).asc_nulls_last()
    parts = written(table.repartitionByRange(order).withColumn("__part", F.spark_partition_id()), "ranges")
    before = parts.groupBy("__part").count().withColumn("__before", F.sum("count").over(Window.orderBy("__part")) - F.col("count"))
    inner = F.row_number().over(Window.partitionBy("__part").orderBy(order)) - 1
    return parts.withColumn("__inner", inner).join(F.broadcast(before), "__part").withColumn("rank", F.col("__before") + F.col("__inner")).drop("__part", "__before", "__inner", "count")


def shares(sources: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``sources`` (source, source_size) with ``target``. Each pass brings two sums to the driver."""
    weighed = ranked(sources, "source").withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))).drop("rank")
    weighed = written(weighed, "sources")
    full = F.col("source_size") * F.lit(float(most))
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    each, capped = 0.0, None
    while True:
        over = full < F.lit(each) * F.col("weight")
        row = weighed.agg(F.coalesce(F.sum(F.when(over, full)), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)), F.count(F.when(over, 1))).first()
        if row[2] == capped or not row[1]:
            break
        capped, each = row[2], (share * total - row[0]) / row[1]
    # nothing but capped sources (or none): all get what they may
    share_of = F.when(F.lit(bool(row[1])), F.lit(each) * F.col("weight")).otherwise(full)
    return weighed.withColumn("target", F.least(full, share_of)).drop("weight")


def _prefixes(column: str, bits: int) -> list[Column]:
    """A whole number's leading bits, 11 more each time, down to all of it: each divides the one before."""
    return [F.shiftright(F.col(column), max(0, k)) for k in range(bits - 11, -11, -11)]


def _levels() -> list[Column]:
    """What divides the rows of a source in the order of key, id, size and row. A key times a power of two is exact."""
    return [F.floor(F.col("key") * float(1 << k)) for k in (2, 13, 24, 35, 46)] + _prefixes("id", 64) + _prefixes("size", 40) + _prefixes("row", 64)


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 7, last: int = LAST) -> DataFrame:
    """(doc_id, source, size, source_size, target, epochs, taken): how many words of each document the mix takes.

    ``epochs`` is how often the source goes in whole; ``taken`` adds the document's part in the last, partial epoch.
    """
    text = F.col("text").cast("string")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(text).alias("size"), quality_weight(text).alias("w"))
    slim = slim.withColumn("key", sampling_key(F.col("doc_id"), F.col("w"), seed)).withColumn("id", F.coalesce("doc_id", F.lit(-(1 << 63))))
    # a source by a name that is never null, and a number for each row
    slim = slim.withColumn("s", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))).withColumn("row", F.monotonically_increasing_id())
    slim = written(slim.drop("w"), "sizes")
    targets = shares(slim.groupBy("s", "source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), weights, share, most)
    whole = F.coalesce(F.try_divide(F.floor("target"), F.col("source_size")), F.lit(0.0))
    targets = targets.withColumn("epochs", F.floor(whole).cast("long")).withColumn("left", F.floor(F.col("target")) - F.col("epochs") * F.col("source_size"))
    targets = written(targets, "targets")
    inside = join_keys(slim.select("s", "key", "id", "size", "row"), targets.where("left > 0").select("s", "left", "n"), ["s"], "n").drop("n")
    ends, levels, before = None, [], []
    for k, level in enumerate(_levels()):
        levels.append(level)
        rows = inside.withColumn("d", level)
        sums = rows.groupBy("s", "left", "d").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
        upto = sums.withColumn("upto", F.sum("words").over(Window.partitionBy("s").orderBy("d")))
        cut = upto.where((F.col("upto") >= F.col("left")) & (F.col("upto") - F.col("words") < F.col("left")))
        cut = written(cut.select("s", F.col("d").alias(f"e{k}"), (F.col("upto") - F.col("words")).alias("skip"), "n"), "cuts")
        here = join_keys(rows, cut, ["s"], "n").where(F.col("d") == F.col(f"e{k}"))
        after = written(here.select("s", "key", "id", "size", "row", (F.col("left") - F.col("skip")).alias("left")), "inside")
        found = cut.select("s", f"e{k}")
        ends = found if ends is None else ends.join(found, "s")
        before.append(inside)
        inside = after
        if (cut.agg(F.max("n")).first()[0] or 0) <= last:
            break
    for old in before:
        discard(old)
    targets = written(targets.join(ends, "s", "left"), "ends")
    rows = join_keys(slim, targets.drop("source"), ["s"], "n")
    mark, end = F.struct(*(x.alias(f"e{k}") for k, x in enumerate(levels))), F.struct(*(F.col(f"e{k}") for k in range(len(levels))))
    open_source = F.col("e0").isNotNull()
    order = Window.partitionBy("s").orderBy("key", "id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    rest = F.col("left") - F.coalesce(F.sum("size").over(order), F.lit(0))
    parts = written(inside.select("s", "row", F.greatest(F.lit(0), F.least(F.col("size"), rest)).alias("part")), "parts")
    discard(inside)
    early = rows.where(~open_source | (mark != end)).withColumn("part", F.when(open_source & (mark < end), F.col("size")).otherwise(F.lit(0)))
    # the few rows in which budgets end
    here = rows.where(open_source & (mark == end)).join(F.broadcast(parts.drop("s")) if is_small(parts) else parts.drop("s"), "row")
    taken = F.col("epochs") * F.col("size") + F.col("part")
    columns = ["doc_id", "source", "size", "source_size", "target", "epochs"]
    return early.select(*columns, taken.cast("long").alias("taken")).unionByName(here.select(*columns, taken.cast("long").alias("taken")))


def op8_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size,
         greatest(0.05, coalesce(length(translate(coalesce(text, ''), '0123456789#*$%&|<>{}[]()!_=/\@', ''))::DOUBLE / nullif(length(text), 0), 0.05)) AS w,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':7'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight, 1.5::DOUBLE * sum(source_size) OVER () AS budget FROM s),
o AS (SELECT *, 2.0::DOUBLE * source_size AS cap, row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST) AS k FROM r),
p AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS each FROM o),
l AS (SELECT each FROM p WHERE each * weight <= cap ORDER BY k LIMIT 1),
t AS (SELECT p.source, p.source_size, least(p.cap, l.each * p.weight) AS target FROM p, l),
e AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(floor(t.target) / t.source_size) ELSE 0 END::BIGINT AS epochs
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, floor(target)::BIGINT - epochs * source_size AS rest,
             coalesce(sum(size) OVER (PARTITION BY source ORDER BY -ln(u) / w, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM q
"""
