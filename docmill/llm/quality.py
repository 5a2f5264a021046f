"""Quality rules, on DataFrame functions alone: text statistics, and cross-document line frequency.

A line's key is a hash of the line without white space at its ends, lower-cased, its inner white space made single
spaces. A host's line is too frequent if more than ``max(min_docs, share x documents of the host)`` documents of the host
hold it. Such lines go, wherever they stand in the text, and the others stay as they are; a document that loses more than half
of its lines' characters (each distinct line once) is depleted and not kept, nor is one that fails the base rules.

The texts are read once: statistics, line keys and text go to a written table with a row number, and all counting, joining and
summing is done on that. Counts of (host, line) and sums by document combine on both sides of their shuffles; the frequent
lines are broadcast if counted to be few, else those that hold many documents are, and the others shuffled. A document's own frequent lines are brought to its row, and texts go through that
join only if the caller reads column ``text``.

Edge cases: null text is empty, and has no words and no line with a word; such documents fail the base rules. A null host is a
host of its own. Every row is a document, also with a repeated or null id. An empty table gives an empty table. Very long texts are read
whole; a line is counted once a document however often it stands there. Lines exactly at a limit stay. Other columns don't matter, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.runtime import discard, join_keys, small_enough, written

_BLANK = " \t\n\x0b\f\r"
_SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "line_chars", "frequent_chars")


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(_BLANK))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\t-\\r]+"))


def _normal(line: Column) -> Column:
    return F.regexp_replace(F.lower(F.btrim(line, F.lit(_BLANK))), "[ \\t-\\r]+", " ")


def _repeats(words: Column, hashes: Column, n: Column) -> Column:
    """How many words lie in 3-word windows that occur twice or more. Windows are sorted by hash, so equal ones are neighbours."""
    numbered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    same = lambda s: F.filter(s, lambda x, i: ((i > 0) & (F.get(s, i - 1).h == x.h)) | F.coalesce(F.get(s, i + 1).h == x.h, F.lit(False)))
    covered = lambda s: F.size(F.array_distinct(F.flatten(F.transform(same(s), lambda x: F.array(x.p, x.p + 1, x.p + 2)))))
    # the sorted array is bound once, as the only element of an array
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(F.element_at(F.transform(F.array(numbered), covered), 1))


def text_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` (with column ``text``, non-null) and words, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, keys."""
    text = F.col("text")
    out = docs.withColumn("words", words_of(text)).withColumn("n_words", F.size("words").cast("long"))
    starts = F.when(F.col("n_words") < 3, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), (F.col("n_words") - 3).cast("int")))
    out = out.withColumn("hashes", F.transform(starts, lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))))
    with_word = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(_BLANK)) != "")
    out = out.withColumn("lines", with_word)
    normal = F.array_distinct(F.transform("lines", _normal))
    return out.select(
        *docs.columns,
        "n_words",
        F.length(F.translate(text, _BLANK, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeats(F.col("words"), F.col("hashes"), F.col("n_words")).cast("long").alias("n_repeat_words"),
        F.transform(normal, lambda x: F.struct(F.xxhash64(x).alias("h"), F.length(x).alias("c"))).alias("keys"),
    )


def quality_rules(docs: DataFrame, host: str = "source", min_docs: int = 20, share: float = 0.005) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, line_chars, frequent_chars, kept, text) of every row, ``text`` without the frequent lines."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("h"), F.col(f"`{host}`").cast("string")), F.lit("")).alias("host"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    table = written(text_statistics(slim).withColumn("row", F.monotonically_increasing_id()), "statistics")
    lines = table.select("row", "host", F.explode("keys").alias("k")).select("row", "host", "k.h", "k.c")
    # a document's keys are distinct, so rows are documents
    counts = lines.groupBy("host", "h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > min_docs)
    counts = written(counts, "line-counts")
    hosts = written(table.groupBy("host").agg(F.count(F.lit(1)).alias("docs")), "hosts")
    frequent = written(counts.join(small_enough(hosts), "host").where(F.col("n") > F.lit(share) * F.col("docs")).select("host", "h", "n"), "frequent")
    discard(counts)
    discard(hosts)
    lost = join_keys(lines, frequent, ["host", "h"], "n").groupBy("row").agg(F.sum("c").alias("frequent_chars"), F.collect_list("h").alias("gone"))
    all_chars = F.aggregate("keys", F.lit(0).cast("long"), lambda s, x: s + x.c)
    out = table.withColumn("line_chars", all_chars).drop("keys").join(lost, "row", "left").withColumn("frequent_chars", F.coalesce("frequent_chars", F.lit(0)))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = out.withColumn("base_failed", failed).withColumn("kept", ~failed & (2 * F.col("frequent_chars") <= F.col("line_chars")))
    stays = F.filter(F.split("text", "\n"), lambda x: ~F.array_contains("gone", F.xxhash64(_normal(x))))
    out = out.withColumn("text", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(stays, "\n")))
    return out.select(*COLUMNS, "text")


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")).select(*COLUMNS)


OP3_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
l AS (SELECT doc_id, source, unnest(string_split(t, chr(10))) AS line FROM d),
f AS (SELECT *, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS s FROM l),
g AS (SELECT doc_id, source, line, regexp_replace(lower(s), '[\x20\x09-\x0D]+', ' ', 'g') AS k FROM f WHERE s <> ''),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM g GROUP BY doc_id),
u AS (SELECT DISTINCT doc_id, source, k FROM g),
h AS (SELECT source, count(*) AS docs FROM d GROUP BY source),
q AS (SELECT source, k FROM (SELECT source, k, count(*) AS n FROM u GROUP BY source, k) x JOIN h USING (source) WHERE n > 20 AND n > 0.005 * docs),
c AS (SELECT u.doc_id, sum(length(u.k))::BIGINT AS line_chars, coalesce(sum(length(u.k)) FILTER (q.k IS NOT NULL), 0)::BIGINT AS frequent_chars
      FROM u LEFT JOIN q ON u.source = q.source AND u.k = q.k GROUP BY u.doc_id),
x AS (SELECT doc_id, pos, w[pos] || ' ' || w[pos + 1] || ' ' || w[pos + 2] AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS pos FROM d WHERE len(w) >= 3)),
y AS (SELECT doc_id, g FROM x GROUP BY doc_id, g HAVING count(*) > 1),
z AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT x.doc_id, unnest([pos, pos + 1, pos + 2]) AS p FROM x JOIN y USING (doc_id, g)) GROUP BY doc_id),
b AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(line_chars, 0) AS line_chars, coalesce(frequent_chars, 0) AS frequent_chars
      FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN z USING (doc_id) LEFT JOIN c USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 2 * frequent_chars <= line_chars AS kept FROM b
"""
