"""Queries of the stages' smaller operators over the driver's tables, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docmill.functions import text as tx
from docmill.functions.html import extract_chain, html_text
from docmill.functions.urls import netloc, published
from docmill.operators import collect, enrich, script
from docmill.operators.vector import check_dimension
from docmill.plans.enrich import worklist
from docmill.queries import _WORDS, AS_OF, articles, query_set, table
from docmill.queries import ORACLE_SQL as _OWN

def _pick(values, at):
    return F.element_at(F.array(*values), (at + 1).cast("int"))


def _dates(spark, sf_dir):
    """Events with their time as one of six spellings in the first date, some of them broken with a good one in a later date."""
    e, n = table(spark, sf_dir, "events"), F.col("event_id") % 6
    zoned = F.date_format(F.col("ts") + F.expr("INTERVAL 2 HOURS"), "EEE, d MMM yyyy HH:mm:ss")
    spelt = _pick([F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.concat(F.date_format("ts", "EEE, d MMM yyyy HH:mm:ss"), F.lit(" GMT")), F.concat(zoned, F.lit(" +0200")), F.lit("last Tuesday"), F.lit(None).cast("string")], n)
    second = F.when(n == 4, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(n == 5, F.lit("soon"))
    third = F.when((n == 5) & (F.col("user_id") % 2 == 0), F.date_format("ts", "d MMM yyyy HH:mm:ss"))
    return e.select("event_id", "user_id", "event_type", F.col("ts"), spelt.alias("published"), second.alias("updated"), third.alias("created"))


def published_dates(spark, sf_dir):
    """The first date that parses, else the time of the run."""
    at = published(F.col("published"), F.col("updated"), F.col("created"), F.lit(AS_OF).cast("timestamp"))
    return _dates(spark, sf_dir).select("event_id", F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("published_at"))


def entry_items(spark, sf_dir):
    """Feed entries made of the events, with missing links, titles and summaries dealt to them, as raw items of the last three days."""
    e, n = _dates(spark, sf_dir), F.col("event_id")
    link = F.when(n % 7 != 3, F.concat(F.lit("https://e.com/"), n)).when(n % 2 == 0, F.lit(""))
    entries = e.select(
        n.alias("ord"), F.col("event_type").alias("source"), F.array("event_type").alias("topics"), link.alias("link"), F.when(n % 11 != 5, F.concat(F.lit("id"), n)).alias("id"),
        _pick([F.lit("  A title "), F.lit("B"), F.lit(" "), F.lit(None).cast("string"), F.lit("C")], n % 5).alias("title"), _pick([F.lit("<p>Sum<b>mary</b></p>"), F.lit(""), F.lit(None).cast("string"), F.lit("<br>")], n % 4).alias("summary"),
        F.when(n % 3 == 0, F.lit("de scription")).alias("description"), "published", "updated", "created",
    )
    out = collect.items_from_entries(entries, F.lit(AS_OF).cast("timestamp"))
    return out.select("ord", "item_id", "source", "title", "content")


def feeds_usable(spark, sf_dir):
    """Hosts of the pages as feeds, some without an address or a label."""
    p, n = table(spark, sf_dir, "pages"), F.col("page_id")
    return collect.usable_feeds(p.select("page_id", F.when(n % 5 != 2, netloc(F.col("url"))).alias("url"), _pick([F.lit(""), F.lit(None).cast("string"), F.lit("name")], n % 3).alias("label"))).select("page_id", "url", "label")


def _robots(spark, sf_dir):
    """A robots file for each host: one of five, by the length of its name, some missing or not found."""
    hosts = table(spark, sf_dir, "pages").select(netloc(F.col("url")).alias("domain")).distinct()
    kind = F.length("domain") % 5
    bodies = [F.lit("User-agent: *\nDisallow: /en"), F.lit("User-agent: other\nDisallow: /\n\nUser-agent: *\nAllow: /fr\nDisallow: /f"), F.lit("User-agent: *\nDisallow: /"), F.lit("User-agent: *\nDisallow:"), F.lit(None).cast("string")]
    return hosts.select("domain", F.when(F.length("domain") % 7 == 0, 404).otherwise(200).alias("status"), _pick(bodies, kind).alias("body"))


def robots_gate(spark, sf_dir):
    return enrich.with_robots(table(spark, sf_dir, "pages").select("page_id", "url"), _robots(spark, sf_dir)).select("page_id", "allowed")


def robots_counts(spark, sf_dir):
    return enrich.robots_statistics(_robots(spark, sf_dir))


def extraction_chain(spark, sf_dir):
    """The first extractor that gives 60 words or more, of texts cut to 5000 characters: an extractor that isn't there is passed over, then the main text; else none."""
    x = extract_chain(F.col("html"), ("unknown", "main"), 60, 5000)
    return table(spark, sf_dir, "pages").select("page_id", x.getField("extraction_method").alias("method"), F.coalesce(x.getField("word_count"), F.lit(0)).alias("n_words"), F.md5(x.getField("clean_text")).alias("md5"))


def html_decoded(spark, sf_dir):
    """The text of pages that come as bytes, with a byte that is no UTF-8 in front."""
    raw = F.concat(F.unhex(F.lit("FF")), F.encode("html", "UTF-8"))
    return table(spark, sf_dir, "pages").select("page_id", html_text(raw).alias("text"))


def enrich_worklist(spark, sf_dir):
    """What is still to be enriched, and what is skipped as done."""
    items = articles(spark, sf_dir).withColumn("item_index", F.col("ord"))
    return worklist(items).select("item_index", "source_domain", "skipped")


def enrich_merged(spark, sf_dir):
    """Items with the results of every third one, which come by index; the others keep what they had."""
    a = articles(spark, sf_dir).select(F.col("ord").alias("item_index"), "has_fulltext", F.when(F.col("has_fulltext"), F.col("title")).alias("full_text"), F.lit("old").alias("extraction_method"), "full_text_words")
    new = a.where("item_index % 3 = 0").select("item_index", F.concat(F.lit("new "), F.col("item_index")).alias("full_text"), F.lit("main").alias("extraction_method"), F.lit(2).alias("full_text_words"))
    return enrich.merged_result(a, new).select("item_index", "has_fulltext", F.md5("full_text").alias("md5"), "extraction_method", "full_text_words")


def bullet_items(spark, sf_dir):
    """Documents whose lines are bullets where the line's place is even; those without a bullet go."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.when(i % 2 == 1, F.concat(F.lit("  • "), x)).otherwise(x))
    rows = script.with_bullets(table(spark, sf_dir, "documents").select("doc_id", F.array_join(lines, "\n").alias("headlines")))
    return rows.select("doc_id", F.size("bullets").alias("n"), F.md5(F.array_join("bullets", "|")).alias("md5"))


def titles_previewed(spark, sf_dir):
    """The first five titles of each source by id."""
    a = articles(spark, sf_dir)
    titles = F.transform(F.array_sort(F.collect_list(F.when(F.col("place") <= 5, F.struct("ord", "title")))), lambda x: x["title"])
    placed = a.select("source", "ord", "title", F.row_number().over(Window.partitionBy("source").orderBy("ord")).alias("place"))
    return placed.groupBy("source").agg(tx.titles_preview(titles).alias("preview"))


def query_expansion(spark, sf_dir):
    """Benchmark items as queries, with no, one or two expansions."""
    words = tx.tokens(F.col("query"))
    q = query_set(spark, sf_dir).withColumn("expansions", F.slice(words, 1, (F.col("query_idx") % 3).cast("int")))
    return q.select("query_idx", tx.expanded_query(F.col("query"), F.when(F.col("query_idx") % 4 > 0, F.col("expansions"))).alias("query"))


def vectors_checked(spark, sf_dir):
    return check_dimension(table(spark, sf_dir, "embeddings"), "embedding", 64).select("vec_id", F.size("embedding").alias("n"))


def _script_lines(spark, sf_dir):
    """Conversations as lines that refer to the bullet of their turn."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").cast("string").alias("segment_id"), F.col("turn").cast("int").alias("line_id"), F.col("role").alias("speaker"), "text", F.array((F.col("turn") % 3).cast("int")).alias("refs"), F.lit(None).cast("double").alias("secs_estimate"))


def polish_checked(spark, sf_dir):
    """Polished segments: none for every seventh, one without its references for every fourth, one with a long line for every fifth; the others are taken."""
    lines, n = _script_lines(spark, sf_dir), F.col("segment_id").cast("long")
    longer = F.when(n % 5 == 1, F.repeat(F.lit("word "), 101)).otherwise(F.concat(F.lit("polished "), F.element_at(F.split("text", " "), 1)))
    polished = lines.where(n % 7 != 3).withColumn("refs", F.when(n % 4 == 2, F.array().cast("array<int>")).otherwise(F.col("refs"))).withColumn("text", longer)
    return script.polished_segments(lines, polished).select("segment_id", "line_id", F.md5("text").alias("md5"))


def default_fields(spark, sf_dir):
    """Lines without a segment, or an empty one, get it from their title; lines without seconds from their words."""
    lines = _script_lines(spark, sf_dir).withColumn("title", F.concat("speaker", F.lit(" No. "), "segment_id")).withColumn("was", F.col("segment_id"))
    lines = lines.withColumn("segment_id", F.when(F.col("line_id") % 3 == 0, F.col("segment_id")).when(F.col("line_id") % 3 == 1, F.lit(""))).withColumn("secs_estimate", F.when(F.col("line_id") % 4 == 0, F.lit(1.5)))
    return script.with_defaults(lines).select("was", "line_id", "segment_id", F.round("secs_estimate", 6).alias("secs"))


def stamped_lines(spark, sf_dir):
    """Lines as those of an intro."""
    lines = script.stamped(_script_lines(spark, sf_dir).withColumn("refs", F.when(F.col("line_id") % 2 == 0, F.col("refs"))).withColumn("was", F.col("segment_id")), "SEG_INTRO", "intro")
    return lines.select("was", "line_id", "segment_id", "item_id", F.size("refs").alias("n_refs"), F.round("secs_estimate", 6).alias("secs"))


def speaker_parity(spark, sf_dir):
    return _script_lines(spark, sf_dir).select("segment_id", "line_id", script.first_speaker(F.col("line_id"), ("Adam", "Sara")).alias("first"))


def processed_items(spark, sf_dir):
    """Documents with a text and without, every ninth one's blanked."""
    d = table(spark, sf_dir, "documents")
    return script.processed_counts(d.select(F.when(F.col("doc_id") % 9 == 4, F.lit(" \n")).when(F.col("doc_id") % 9 != 7, F.col("text")).alias("full_text")))


QUERIES = {f.__name__: f for f in (
    published_dates, entry_items, feeds_usable, robots_gate, robots_counts, extraction_chain, html_decoded, enrich_worklist, enrich_merged, bullet_items, titles_previewed, query_expansion, vectors_checked, polish_checked, default_fields, stamped_lines, speaker_parity, processed_items,
)}

_AT = f"CASE WHEN event_id % 6 = 5 AND user_id % 2 <> 0 THEN TIMESTAMP '{AS_OF}' ELSE date_trunc('second', ts) END"
_HOST = "regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)"
_PATH = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
_SECS = f"round(len({_WORDS}) / 150.0::DOUBLE * 60.0::DOUBLE, 6)"
_LINE = "SELECT conv_id, turn::INT AS line_id, conv_id::VARCHAR AS segment_id, role AS speaker, text FROM conversations"

ORACLE_SQL = {
    "published_dates": f"SELECT event_id, strftime({_AT}, '%Y-%m-%d %H:%M:%S') AS published_at FROM events",
    "entry_items": f"""
WITH e AS (SELECT event_id AS n, event_type, {_AT} AS moment, CASE WHEN event_id % 7 <> 3 THEN 'https://e.com/' || event_id WHEN event_id % 2 = 0 THEN '' END AS link, CASE WHEN event_id % 11 <> 5 THEN 'id' || event_id END AS id FROM events),
u AS (SELECT *, CASE WHEN coalesce(link, '') <> '' THEN link ELSE coalesce(id, '') END AS url, CASE n % 5 WHEN 0 THEN 'A title' WHEN 1 THEN 'B' WHEN 4 THEN 'C' ELSE '' END AS title,
             CASE WHEN n % 4 = 0 THEN 'Sum' || chr(10) || 'mary' WHEN n % 4 = 3 THEN '' WHEN n % 3 = 0 THEN 'de scription' END AS content FROM e)
SELECT n AS ord, md5(url) AS item_id, event_type AS source, title, content FROM u WHERE url <> '' AND title <> '' AND content IS NOT NULL AND moment >= TIMESTAMP '{AS_OF}' - INTERVAL 3 DAYS""",
    "feeds_usable": f"SELECT page_id, {_HOST} AS url, CASE WHEN page_id % 3 = 2 THEN 'name' ELSE {_HOST} END AS label FROM pages WHERE page_id % 5 <> 2 AND {_HOST} <> ''",
    "robots_gate": f"""
WITH p AS (SELECT page_id, {_HOST} AS h, {_PATH} AS path FROM pages)
SELECT page_id, CASE WHEN length(h) % 7 = 0 THEN TRUE WHEN length(h) % 5 = 0 THEN NOT starts_with(path, '/en') WHEN length(h) % 5 = 1 THEN starts_with(path, '/fr') OR NOT starts_with(path, '/f') WHEN length(h) % 5 = 2 THEN FALSE ELSE TRUE END AS allowed FROM p""",
    "robots_counts": f"WITH h AS (SELECT DISTINCT {_HOST} AS h FROM pages) SELECT count(*) FILTER (length(h) % 7 <> 0 AND length(h) % 5 <> 4) AS cached_domains, count(*) FILTER (length(h) % 7 = 0 OR length(h) % 5 = 4) AS failed_domains FROM h",
    "extraction_chain": rf"""
WITH m AS ({_OWN["extract_main"]}), c AS (SELECT page_id, left(text, 5000) AS text FROM m), n AS (SELECT page_id, text, len({_WORDS})::INT AS n FROM c)
SELECT page_id, CASE WHEN n >= 60 THEN 'main' END AS method, CASE WHEN n >= 60 THEN n ELSE 0 END AS n_words, CASE WHEN n >= 60 THEN md5(text) END AS md5 FROM n""",
    "html_decoded": _OWN["html_clean"],
    "enrich_worklist": "SELECT doc_id AS item_index, 'example.com' AS source_domain, n_chars >= 1000 AS skipped FROM documents",
    "enrich_merged": rf"""
SELECT doc_id AS item_index, doc_id % 3 = 0 OR n_chars >= 1000 AS has_fulltext, md5(CASE WHEN doc_id % 3 = 0 THEN 'new ' || doc_id WHEN n_chars >= 1000 THEN split_part(text, chr(10), 1) END) AS md5,
       CASE WHEN doc_id % 3 = 0 THEN 'main' ELSE 'old' END AS extraction_method, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE len({_WORDS}) END::INT AS full_text_words FROM documents""",
    "bullet_items": r"""
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
b AS (SELECT doc_id, list_transform(list_filter(range(1, len(l) + 1), lambda i: i % 2 = 0 OR starts_with(regexp_replace(l[i], '^\s+', ''), '•')), lambda i: regexp_replace(CASE WHEN i % 2 = 0 THEN l[i] ELSE substring(regexp_replace(l[i], '^\s+', ''), 2) END, '^\s+|\s+$', '', 'g')) AS b FROM l)
SELECT doc_id, len(b)::INT AS n, md5(array_to_string(b, '|')) AS md5 FROM b WHERE len(b) > 0""",
    "titles_previewed": """
WITH t AS (SELECT source, doc_id, left(split_part(text, chr(10), 1), 80) AS t FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 5)
SELECT source, coalesce(string_agg('- ' || t, chr(10) ORDER BY doc_id) FILTER (t <> ''), '') AS preview FROM t GROUP BY source""",
    "query_expansion": rf"SELECT item_id AS query_idx, array_to_string([text] || CASE WHEN item_id % 4 > 0 THEN ({_WORDS})[1:item_id % 3] ELSE [] END, '; ') AS query FROM benchmark",
    "vectors_checked": "SELECT vec_id, len(embedding)::INT AS n FROM embeddings",
    "polish_checked": f"""
WITH l AS ({_LINE}), s AS (SELECT conv_id, conv_id % 7 <> 3 AND conv_id % 4 <> 2 AND conv_id % 5 <> 1 AS taken FROM l GROUP BY conv_id)
SELECT segment_id, line_id, md5(CASE WHEN taken THEN 'polished ' || string_split(text, ' ')[1] ELSE text END) AS md5 FROM l JOIN s USING (conv_id)""",
    "default_fields": f"""
WITH l AS ({_LINE})
SELECT segment_id AS was, line_id, CASE WHEN line_id % 3 = 0 THEN segment_id ELSE 'SEG_' || speaker || '-no-' || segment_id END AS segment_id, CASE WHEN line_id % 4 = 0 THEN 1.5::DOUBLE ELSE {_SECS} END AS secs FROM l""",
    "stamped_lines": f"WITH l AS ({_LINE}) SELECT segment_id AS was, line_id, 'SEG_INTRO' AS segment_id, 'intro' AS item_id, CASE WHEN line_id % 2 = 0 THEN 1 ELSE 0 END AS n_refs, {_SECS} AS secs FROM l",
    "speaker_parity": f"WITH l AS ({_LINE}) SELECT segment_id, line_id, CASE WHEN line_id % 2 = 0 THEN 'Adam' ELSE 'Sara' END AS first FROM l",
    "processed_items": r"""
WITH t AS (SELECT CASE WHEN doc_id % 9 = 4 THEN '' WHEN doc_id % 9 <> 7 THEN regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') ELSE '' END AS t FROM documents)
SELECT count(*) FILTER (t <> '') AS processed, count(*) FILTER (t = '') AS skipped FROM t""",
}
