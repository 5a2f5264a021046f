"""Script lines: parsing of model answers, validation, ordering, numbering, balance and duration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions.text import bullets, duration, filled, non_empty, segment_id, ssml, strip, unfenced, word_count

LINE = "struct<line_id: int, segment_id: string, speaker: string, voice: string, item_id: string, text: string, refs: array<int>, pause_ms_after: int, secs_estimate: double, ssml: string, notes: string>"
#: Fields that a line must have, in the order in which they are checked.
REQUIRED = ("line_id", "segment_id", "speaker", "item_id", "text", "refs", "pause_ms_after")


def with_bullets(items: DataFrame, column: str = "headlines") -> DataFrame:
    """Items that have bullets, with them as an array."""
    return items.withColumn("bullets", bullets(F.col(column))).where(F.size("bullets") > 0)


def parsed_lines(responses: DataFrame, column: str = "response") -> DataFrame:
    """A row for each line of an answer, a fence taken off, that is a JSON object: ``pos`` (from 0) and ``line`` (of type ``LINE``), and
    ``present``, its field names. Other lines go."""
    rest = [c for c in responses.columns if c != column]
    rows = responses.select(*rest, F.posexplode(F.split(unfenced(F.col(column)), "\n")).alias("pos", "raw"))
    rows = rows.withColumn("raw", strip(F.col("raw"))).where(F.startswith("raw", F.lit("{")) & F.try_parse_json("raw").isNotNull())
    # a field of another type is null in the struct, so is read as missing
    return rows.select(*rest, "pos", F.from_json("raw", LINE).alias("line"), F.json_object_keys("raw").alias("present"))


def numbered(lines: DataFrame, *order: str, by: Sequence[str] = ()) -> DataFrame:
    """``line_id`` from 1 in the order given, over all lines or in each group ``by``. It is given before validation, so rejected lines leave gaps.

    The lines of one script are as many as the selected items allow, a bounded list, so a window without partitions does for them.
    """
    return lines.withColumn("line_id", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def with_defaults(lines: DataFrame, title: str = "title", words_per_minute: int = 150) -> DataFrame:
    """``segment_id`` from the title if it is missing or empty, ``secs_estimate`` from the words if missing."""
    out = lines.withColumn("segment_id", F.coalesce(non_empty(F.col("segment_id")), segment_id(F.col(title))))
    return out.withColumn("secs_estimate", F.coalesce("secs_estimate", duration(F.col("text"), words_per_minute)))


def line_error(speakers: Sequence[str], most_words: int = 100, n_bullets: str | Column = "n_bullets") -> Column:
    """What is wrong with a line first, null if nothing: a missing field, the speaker, the words, the references.

    References must lie in the item's bullets, and be there at all unless ``item_id`` is empty or ``null``.
    """
    n = F.col(n_bullets) if isinstance(n_bullets, str) else n_bullets
    out = F.lit(None).cast("string")
    content = (F.col("item_id") != "") & (F.col("item_id") != "null")
    words = word_count(F.col("text"))
    inside = F.forall("refs", lambda r: r.isNotNull() & (r >= 0) & (r < n))
    checks = [(F.col(c).isNull(), F.lit(f"missing {c}")) for c in REQUIRED]
    checks += [(~F.col("speaker").isin(*speakers), F.lit("speaker")), (words > most_words, F.lit("too long")), (content & (F.size("refs") == 0), F.lit("no refs")), (content & ~inside, F.lit("refs out of range"))]
    for test, what in reversed(checks):
        out = F.when(test, what).otherwise(out)
    return out


def valid_lines(lines: DataFrame, speakers: Sequence[str], most_words: int = 100) -> DataFrame:
    return lines.withColumn("error", line_error(speakers, most_words)).where("error is null").drop("error")


def order_entries(response: Column) -> Column:
    """The entries of a JSON array of indices or ids, as strings; null if it isn't one. Booleans aren't indices."""
    return F.from_json(unfenced(response), "array<string>")


def applied_order(items: DataFrame, responses: DataFrame, ordinal: str = "ord", key: str = "item_id") -> DataFrame:
    """``items`` with ``position``: as the answer orders them, the first mention of each counting; unknown entries are passed over and items
    not mentioned follow in their own order. An answer that doesn't parse changes nothing."""
    entries = responses.select(F.posexplode(order_entries(F.col("response"))).alias("at", "entry"))
    by_index = entries.where(F.rlike("entry", F.lit("^[0-9]+$"))).select("at", F.col("entry").try_cast("long").alias("__ord"))
    by_id = entries.where(~F.rlike("entry", F.lit("^[0-9]+$"))).select("at", F.col("entry").alias("__key"))
    first_index = by_index.groupBy("__ord").agg(F.min("at").alias("__i"))
    first_id = by_id.groupBy("__key").agg(F.min("at").alias("__k"))
    out = items.join(first_index, F.col(ordinal) == F.col("__ord"), "left").join(first_id, F.col(key) == F.col("__key"), "left")
    at = F.least("__i", "__k")  # least passes over nulls
    order = Window.orderBy(at.asc_nulls_last(), F.col(ordinal).asc())
    return out.withColumn("position", F.row_number().over(order)).drop("__ord", "__key", "__i", "__k")


def polished_segments(original: DataFrame, polished: DataFrame, most_words: int = 100) -> DataFrame:
    """Segment by segment the polished lines, if there are any, all original references are among theirs and none is too long; else the original lines."""
    refs = lambda df, name: df.groupBy("segment_id").agg(F.array_distinct(F.flatten(F.collect_list(F.coalesce("refs", F.array().cast("array<int>"))))).alias(name))
    longest = polished.groupBy("segment_id").agg(F.max(word_count(F.col("text"))).alias("__words"))
    checked = refs(original, "__own").join(refs(polished, "__new"), "segment_id").join(longest, "segment_id")
    good = checked.where((F.size(F.array_except("__own", "__new")) == 0) & (F.col("__words") <= most_words)).select("segment_id")
    kept = original.join(good, "segment_id", "left_anti")
    return polished.join(good, "segment_id", "left_semi").select(*original.columns).unionByName(kept)


def framed(intro: DataFrame, body: DataFrame, outro: DataFrame) -> DataFrame:
    """The three parts in a row, lines numbered from 1; the body's by ``line_id``, a missing one as 0."""
    parts = [part.withColumn("__part", F.lit(k)) for k, part in enumerate((intro, body, outro))]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    order = Window.orderBy("__part", F.coalesce("line_id", F.lit(0)), F.coalesce("segment_id", F.lit("")), F.coalesce("text", F.lit("")))
    return every.withColumn("line_id", F.row_number().over(order)).drop("__part")


def stamped(lines: DataFrame, segment: str, item: str, words_per_minute: int = 150) -> DataFrame:
    """Lines of an intro or outro: their segment and item, no references and estimated seconds where missing."""
    out = lines.withColumn("segment_id", F.lit(segment)).withColumn("item_id", F.lit(item))
    out = out.withColumn("refs", F.coalesce("refs", F.array().cast("array<int>")))
    return out.withColumn("secs_estimate", F.coalesce("secs_estimate", duration(F.col("text"), words_per_minute)))


def with_ssml(lines: DataFrame) -> DataFrame:
    return lines.withColumn("ssml", F.coalesce("ssml", ssml(F.col("text"), F.col("pause_ms_after"))))


def speaker_shares(lines: DataFrame, tolerance: float = 10.0) -> DataFrame:
    """(speaker, n, pct, expected, balanced): shares in percent against equal ones; fewer than two speakers are balanced."""
    counts = lines.groupBy("speaker").agg(F.count(F.lit(1)).alias("n"))
    whole = counts.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("speakers"))
    out = counts.crossJoin(F.broadcast(whole)).withColumn("pct", F.col("n") / F.col("total") * 100).withColumn("expected", 100 / F.col("speakers"))
    return out.withColumn("balanced", (F.col("speakers") < 2) | (F.abs(F.col("pct") - F.col("expected")) <= tolerance)).select("speaker", "n", "pct", "expected", "balanced")


def is_balanced(lines: DataFrame, tolerance: float = 10.0) -> DataFrame:
    """One row: whether every speaker's share is within ``tolerance`` percentage points of an equal one."""
    return speaker_shares(lines, tolerance).agg(F.coalesce(F.every("balanced"), F.lit(True)).alias("balanced"))


def total_duration(lines: DataFrame, *by: str) -> DataFrame:
    """Seconds of speech and pauses, over all lines or by the columns named."""
    secs = F.coalesce("secs_estimate", F.lit(0.0)) + F.coalesce("pause_ms_after", F.lit(0)) / 1000
    return lines.groupBy(*by).agg(F.sum(secs).alias("total_secs"), F.count(F.lit(1)).alias("n_lines"))


def first_speaker(position: Column, speakers: Sequence[str]) -> Column:
    """Who begins an item, by the parity of its position from 0."""
    return F.element_at(F.array(*map(F.lit, speakers)), (F.pmod(position, F.lit(len(speakers))) + 1).cast("int"))


def processed_counts(rows: DataFrame, text: str = "full_text") -> DataFrame:
    """One row: items with a text, and those without, which are passed over."""
    there = strip(filled(F.col(text))) != ""
    return rows.agg(F.count_if(there).alias("processed"), F.count_if(~there).alias("skipped"))
