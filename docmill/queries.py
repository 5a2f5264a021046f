"""The queries of the engine's own operators over the driver's tables, and the SQL that checks them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.config import RetrieveConfig
from docmill.functions import text as tx
from docmill.functions.content import HOLDER_COST, LEAF_COST, main_text
from docmill.functions.html import html_text, html_variants
from docmill.functions.language import PROFILES, detect
from docmill.functions.urls import is_recent, item_key, netloc, registered_domain
from docmill.operators import bm25, dedup, enrich, hybrid, index, language, script
from docmill.operators.collect import collection_counts, new_items
from docmill.operators.vector import vector_top_k
from docmill.plans import retrieve as plan
from docmill.runtime import shared_dir, written

AS_OF = "2024-01-31 00:00:00"
CONFIG = RetrieveConfig()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` in the shape of enriched items: exact copies share an address."""
    d = table(spark, sf_dir, "documents")
    url = F.concat(F.lit("https://example.com/"), F.md5("text"))
    return d.select(
        F.col("doc_id").alias("ord"),
        item_key(url).alias("item_id"),
        "source",
        url.alias("url"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_interval(mins=F.col("doc_id").cast("int"))).alias("published_at"),
        F.array("lang").alias("topics"),
        F.col("text").alias("content"),
        (F.col("n_chars") >= 1000).alias("has_fulltext"),
        F.col("text").alias("full_text"),
        tx.word_count(F.col("text")).alias("full_text_words"),
        "lang",
        "n_chars",
    )


def query_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``benchmark`` as queries."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_idx"), F.col("text").alias("query"), F.array().cast("array<string>").alias("expansions"))


def recent_items(spark, sf_dir):
    return table(spark, sf_dir, "events").where(is_recent(F.col("ts"), F.lit(AS_OF).cast("timestamp"))).select("event_id", "event_type")


def dedup_url_latest(spark, sf_dir):
    return dedup.latest_by_url(articles(spark, sf_dir)).select(F.col("ord").alias("doc_id"), "item_id")


def dedup_title_longest(spark, sf_dir):
    return dedup.longest_by_title(articles(spark, sf_dir)).select(F.col("ord").alias("doc_id"), "item_id")


def dedup_union(spark, sf_dir):
    return dedup.deduplicated(articles(spark, sf_dir)).select(F.col("ord").alias("doc_id"), "item_id", F.col("position.src").alias("src"), F.col("position.ord").alias("at"))


def new_items_anti(spark, sf_dir):
    a = articles(spark, sf_dir)
    return new_items(a, a.where(F.col("n_chars") >= 1000)).select(F.col("ord").alias("doc_id"), "item_id")


def collection_summary(spark, sf_dir):
    return collection_counts(articles(spark, sf_dir))


def retrieval_text(spark, sf_dir):
    a = articles(spark, sf_dir)
    text = tx.retrieval_text(F.col("full_text"), F.col("has_fulltext"), F.col("full_text_words"), F.col("content"), F.col("title"))
    return a.select(F.col("ord").alias("doc_id"), F.length(text).alias("n"), F.md5(text).alias("md5"))


def segment_ids(spark, sf_dir):
    return articles(spark, sf_dir).select(F.col("ord").alias("doc_id"), tx.segment_id(F.col("title")).alias("segment_id"))


def snippets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.snippet(F.col("text")).alias("snippet"), tx.preview(F.col("text")).alias("preview"))


def word_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.word_count(F.col("text")).alias("n_words"), F.round(tx.duration(F.col("text")), 6).alias("secs"))


def chunk_documents(spark, sf_dir):
    c = plan.article_chunks(articles(spark, sf_dir))
    return c.select("item_id", "chunk_index", "chunk_count", "char_start", "char_end", F.md5("text").alias("md5"))


def chunk_stats(spark, sf_dir):
    c = plan.article_chunks(articles(spark, sf_dir))
    return c.agg(F.count(F.lit(1)).alias("n_chunks"), F.count_if(F.col("chunk_index") == 0).alias("n_articles"), F.max("chunk_count").alias("most"), F.sum(F.length("text")).alias("chars"))


def vector_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    q = e.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_idx"), "embedding")
    return vector_top_k(e, q, "vec_id", 30)


def vector_topk_by_label(spark, sf_dir):
    """For each query vector its best rows among those of its label."""
    e = table(spark, sf_dir, "embeddings")
    q = e.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_idx"), "embedding", "label")
    return vector_top_k(e, q, "vec_id", 10, within="label")


def bm25_corpus_stats(spark, sf_dir):
    stats, n, mean = bm25.corpus_statistics(table(spark, sf_dir, "documents"))
    terms = stats.agg(F.count(F.lit(1)).alias("n_terms"), F.sum("df").alias("n_postings"), F.round(F.avg("raw_idf"), 6).alias("mean_idf"), F.count_if(F.col("raw_idf") < 0).alias("n_negative"))
    return terms.select(F.lit(n).cast("long").alias("n_docs"), F.lit(round(mean, 6)).alias("mean_length"), "*")


def bm25_topk(spark, sf_dir):
    return bm25.bm25_top_k(table(spark, sf_dir, "documents").select("doc_id", "text"), query_set(spark, sf_dir), "doc_id", CONFIG.k_bm25)


def bm25_index_topk(spark, sf_dir):
    """The ten best documents of each query from an index that two runs have written, with small blocks so that some can be skipped."""
    docs, path = table(spark, sf_dir, "documents").select("doc_id", "text"), f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    for run in (0, 1):
        index.append(docs.where(F.col("doc_id") % 2 == run), "doc_id", path, str(run), block=8)
    return index.search(spark, path, query_set(spark, sf_dir), "doc_id", "long", 10).rows.select("query_idx", "doc_id", "bm25", "rank")


def bm25_normalised(spark, sf_dir):
    scores = bm25.bm25_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), query_set(spark, sf_dir), "doc_id")
    return bm25.normalised(written(scores, "scores"), "bm25").select("query_idx", "doc_id", F.round("bm25", 6).alias("bm25"))


def _scored(spark, sf_dir):
    chunks = written(plan.article_chunks(articles(spark, sf_dir)), "chunks")
    return plan.scored_chunks(chunks, query_set(spark, sf_dir)), chunks


def hybrid_fusion(spark, sf_dir):
    return _scored(spark, sf_dir)[0].select("query_idx", "chunk_key", "dense", "bm25", "hybrid")


def article_rollup(spark, sf_dir):
    scored, chunks = _scored(spark, sf_dir)
    return hybrid.rolled_up(scored, chunks, plan.KEY).select("query_idx", "item_id", "chunk_index", "hybrid")


def multi_query_merge(spark, sf_dir):
    out = plan.merged_articles(*_scored(spark, sf_dir))
    return out.select("item_id", "chunk_index", "hybrid", "primary_query", F.array_join(F.col("matched").cast("array<string>"), ",").alias("matched"))


def per_query_cap(spark, sf_dir):
    return hybrid.capped(plan.merged_articles(*_scored(spark, sf_dir)), CONFIG.per_query_cap).select("primary_query", "query_rank", "item_id", "hybrid")


def mmr_select(spark, sf_dir):
    chunks = written(plan.article_chunks(articles(spark, sf_dir)), "chunks")
    return plan.diversified(plan.candidates(chunks, query_set(spark, sf_dir)), chunks)


def retrieve_end_to_end(spark, sf_dir):
    out = plan.retrieve(articles(spark, sf_dir), query_set(spark, sf_dir))
    return out.select("rank", "item_id", "title", "source", F.col("score.hybrid").alias("hybrid"), F.col("best_chunk.chunk_index").alias("chunk_index"), F.size("matched_queries").alias("n_queries"))


def html_clean(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html_text(F.col("html")).alias("text"))


def html_variants_found(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(html_variants(F.col("html"), F.col("url")), " ").alias("variants"))


def url_domain(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", netloc(F.col("url")).alias("netloc"), registered_domain(F.col("url")).alias("domain"), item_key(F.col("url")).alias("item_id"))


def paywall_flag(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", enrich.has_paywall(F.col("html")).alias("paywall"))


def language_guess(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", detect(F.col("text")).alias("guess"))


def extract_main(spark, sf_dir):
    """The main text of every page."""
    return table(spark, sf_dir, "pages").select("page_id", main_text(F.col("html")).alias("text"))


def language_fit(spark, sf_dir):
    """Every document's language by profiles of the documents whose id isn't a multiple of five."""
    docs = table(spark, sf_dir, "documents")
    model = language.fit_languages(docs.where("doc_id % 5 <> 0"))
    found = language.detected(docs, model)
    return found.select("doc_id", (F.col("doc_id") % 5 == 0).alias("held_out"), "language", "score")


def language_accuracy(spark, sf_dir):
    """How many documents that weren't learnt from get their language, by language and in all."""
    docs = table(spark, sf_dir, "documents")
    model = language.fit_languages(docs.where("doc_id % 5 <> 0"))
    rest = docs.where("doc_id % 5 = 0")
    return language.accuracy(rest.select("doc_id", "lang").join(language.detected(rest, model), "doc_id")).select("lang", "n", "n_right")


def _gated(spark, sf_dir):
    a = articles(spark, sf_dir)
    rows = a.select(F.col("ord").alias("doc_id"), F.lit(True).alias("allowed"), F.lit(False).alias("paywall_detected"), F.lit(200).alias("status_code"), F.length("full_text").alias("html_size"), F.when(F.col("full_text_words") >= 200, F.col("full_text")).alias("clean_text"), F.col("lang").alias("language_detected"), F.col("content").alias("abstract"))
    return enrich.failure_reason(rows)


def quality_gate(spark, sf_dir):
    return _gated(spark, sf_dir).select("doc_id", "failure_reason")


def fetch_gates(spark, sf_dir):
    """Every gate before extraction, with robots, paywalls and statuses dealt to the documents by their ids."""
    a, at = articles(spark, sf_dir), F.col("ord")
    status = F.element_at(F.array(*(F.lit(x) for x in (200, 404, 503, 0, 408, 200, 499, 500, 302, None))), (at % 10 + 1).cast("int"))
    rows = a.select(at.alias("doc_id"), F.when(at % 9 > 0, at % 13 != 1).alias("allowed"), F.when(at % 8 > 0, at % 11 == 3).alias("paywall_detected"), status.alias("status_code"), F.when(at % 17 != 5, F.length("full_text")).alias("html_size"), F.when(at % 19 != 7, F.col("full_text")).alias("clean_text"), F.col("lang").alias("language_detected"), F.col("title").alias("abstract"))
    return enrich.failure_reason(rows, ("en", "fr")).select("doc_id", "failure_reason")


def failure_histogram(spark, sf_dir):
    return enrich.failure_histogram(_gated(spark, sf_dir))


def enrichment_summary(spark, sf_dir):
    rows = _gated(spark, sf_dir).withColumn("skipped", F.lit(False))
    return enrich.enrichment_statistics(rows).select("attempted", "succeeded", "failed", "skipped", "dropped", F.map_keys("failed_by_reason").getItem(0).alias("first_reason"))


def _lines(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").cast("string").alias("segment_id"), F.col("turn").alias("pos"), F.col("role").alias("speaker"), "text", F.lit(120).alias("pause_ms_after"), tx.duration(F.col("text")).alias("secs_estimate"), F.array(F.lit(0)).alias("refs"), F.lit("i").alias("item_id"), F.col("conv_id"))


def jsonl_parse_validate(spark, sf_dir):
    """Conversations written as fenced JSON lines with a broken line at the end, parsed and judged again."""
    raw = _lines(spark, sf_dir).select("conv_id", "pos", F.to_json(F.struct("speaker", "text", "refs", "item_id", "pause_ms_after", "segment_id")).alias("j"))
    whole = raw.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "j"))), lambda x: x.j), "\n").alias("j"))
    parsed = script.parsed_lines(whole.select("conv_id", F.concat(F.lit("```jsonl\n"), "j", F.lit("\n{broken\n[1]\n```")).alias("response")))
    rows = script.numbered(parsed.select("conv_id", "pos", "line.*").drop("line_id"), "pos", by=["conv_id"]).withColumn("n_bullets", F.lit(1))
    return rows.withColumn("error", script.line_error(["user", "assistant"], 40)).select("conv_id", "line_id", "error")


def line_checks(spark, sf_dir):
    """Every check of a line, with missing fields and references dealt to the lines by their turns."""
    c, turn = table(spark, sf_dir, "conversations"), F.col("turn")
    refs = F.element_at(F.array(F.array(F.lit(0)), F.array().cast("array<int>"), F.array(F.lit(0), F.lit(2)), F.array(F.lit(-1)), F.array(F.lit(1), F.lit(None).cast("int")), F.lit(None).cast("array<int>")), ((turn + F.col("conv_id")) % 6 + 1).cast("int"))
    rows = c.select("conv_id", "turn", F.when(turn % 23 != 11, turn.cast("int")).alias("line_id"), F.col("conv_id").cast("string").alias("segment_id"), F.col("role").alias("speaker"), F.element_at(F.array(F.lit("i"), F.lit("null"), F.lit("")), (F.col("conv_id") % 3 + 1).cast("int")).alias("item_id"), "text", refs.alias("refs"), F.when(turn % 7 != 6, F.lit(120)).alias("pause_ms_after"), F.lit(2).alias("n_bullets"))
    return rows.withColumn("error", script.line_error(["user", "assistant"], 40)).select("conv_id", "turn", "error")


def apply_order(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("ord"), F.md5("n_name").alias("item_id"), "n_name")
    answer = n.where("ord = 7").select(F.concat(F.lit('```json\n[5, "3", "'), "item_id", F.lit('", 5, 99999, "nobody", 3, 0]\n```')).alias("response"))
    return script.applied_order(n, answer).select("n_name", "position")


def speaker_balance(spark, sf_dir):
    return script.speaker_shares(_lines(spark, sf_dir)).select("speaker", "n", F.round("pct", 6).alias("pct"), F.round("expected", 6).alias("expected"), "balanced")


def total_duration(spark, sf_dir):
    return script.total_duration(_lines(spark, sf_dir), "conv_id").select("conv_id", F.round("total_secs", 6).alias("total_secs"), "n_lines")


def line_numbering(spark, sf_dir):
    return script.numbered(_lines(spark, sf_dir), "pos", by=["conv_id"]).select("conv_id", "pos", "line_id")


def ssml(spark, sf_dir):
    return script.with_ssml(_lines(spark, sf_dir).withColumn("ssml", F.lit(None).cast("string"))).select("conv_id", "pos", "ssml")


def tts_normalise(spark, sf_dir):
    spoken = tx.speakable(F.col("text"), tx.spoken_spellings("the"), "THE-NAME")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", spoken.alias("text"))


QUERIES = {f.__name__: f for f in (
    retrieve_end_to_end, recent_items, dedup_url_latest, dedup_title_longest, dedup_union, new_items_anti, collection_summary, retrieval_text, segment_ids, snippets, word_counts,
    chunk_documents, chunk_stats, vector_topk, vector_topk_by_label, bm25_corpus_stats, bm25_topk, bm25_index_topk, bm25_normalised, hybrid_fusion, article_rollup, multi_query_merge, per_query_cap, mmr_select, html_clean, html_variants_found, url_domain,
    paywall_flag, language_guess, extract_main, language_fit, language_accuracy, quality_gate, fetch_gates, failure_histogram, enrichment_summary, jsonl_parse_validate, line_checks, apply_order, speaker_balance, total_duration, line_numbering, ssml, tts_normalise,
)}

_ARTICLES = r"""
a AS (SELECT doc_id AS ord, md5('https://example.com/' || md5(text)) AS item_id, source, 'https://example.com/' || md5(text) AS url, split_part(text, chr(10), 1) AS title,
             TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS published_at, text AS content, n_chars >= 1000 AS has_fulltext, text AS full_text,
             len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''))::INT AS full_text_words, lang, n_chars FROM documents)"""
_DEDUP = r"""
u AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY url ORDER BY published_at DESC, ord) = 1),
t AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY regexp_replace(lower(title), '^\s+|\s+$', '', 'g') ORDER BY full_text_words DESC, ord) = 1),
b AS (SELECT *, 0 AS src FROM u UNION ALL SELECT *, 1 AS src FROM t),
m AS (SELECT *, min((src, ord)) OVER (PARTITION BY item_id) AS first FROM b QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY src DESC, ord DESC) = 1)"""
_RETRIEVAL = "CASE WHEN has_fulltext AND full_text_words > 50 AND full_text <> '' THEN full_text WHEN content <> '' THEN content ELSE title END"
_CHUNKS = rf"""
x AS (SELECT item_id, first[1]::BIGINT * 1099511627776 + first[2]::BIGINT AS base, {_RETRIEVAL} AS text FROM m),
w AS (SELECT item_id, base, text, 0 AS i, 0 AS s, 0 AS e, 0 AS nxt FROM x WHERE length(text) > 1600
      UNION ALL
      SELECT item_id, base, text, i + 1, nxt, z, z - 240 FROM (
        SELECT *, nxt + CASE WHEN nxt + 1600 < length(text) AND cut > 1120 THEN cut + 1 ELSE 1600 END AS z FROM (
          SELECT *, greatest(CASE WHEN instr(reverse(v), ' .') = 0 THEN -1 ELSE length(v) - instr(reverse(v), ' .') - 1 END,
                             CASE WHEN instr(reverse(v), chr(10)) = 0 THEN -1 ELSE length(v) - instr(reverse(v), chr(10)) END) AS cut
          FROM (SELECT *, substring(text, nxt + 1, 1600) AS v FROM w WHERE nxt < length(text))))),
c0 AS (SELECT item_id, base, i - 1 AS chunk_index, regexp_replace(substring(text, s + 1, e - s), '^\s+|\s+$', '', 'g') AS text FROM w WHERE i > 0
       UNION ALL SELECT item_id, base, 0, text FROM x WHERE length(text) <= 1600 AND text <> ''),
c AS (SELECT item_id, chunk_index, (count(*) OVER (PARTITION BY item_id))::INT AS chunk_count, text, base * 1048576 + chunk_index AS chunk_key,
             (sum(length(text)) OVER (PARTITION BY item_id ORDER BY chunk_index))::INT AS char_end FROM c0)"""
_Q = "q AS (SELECT item_id AS query_idx, text AS query FROM benchmark)"


def _bm25(passages: str, key: str) -> str:
    return rf"""
tok AS (SELECT {key}, unnest(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')) AS term FROM {passages}),
dl AS (SELECT {key}, len(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')) AS dl FROM {passages}),
tf AS (SELECT {key}, term, count(*) AS tf FROM tok GROUP BY ALL),
nn AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS mean FROM dl),
df AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf, nn GROUP BY term),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM df) ELSE raw END AS idf FROM df),
qt AS (SELECT query_idx, term, count(*) AS qtf FROM (SELECT query_idx, unnest(list_filter(string_split_regex(lower(query), '\s+'), lambda x: x <> '')) AS term FROM q) GROUP BY ALL),
bm AS (SELECT query_idx, {key}, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))), 6) AS bm25 FROM qt JOIN idf USING (term) JOIN tf USING (term) JOIN dl USING ({key}), nn GROUP BY ALL)"""


def _vector(rows: str, key: str, text: str, name: str) -> str:
    return rf"""
{name}_t AS (SELECT {key}, md5(term) AS h FROM (SELECT {key}, unnest(list_filter(string_split_regex(lower({text}), '\s+'), lambda x: x <> '')) AS term FROM {rows})),
{name}_b AS (SELECT {key}, ('0x' || substr(h, 1, 8))::BIGINT % 64 AS bucket, sum(1 - 2 * (('0x' || substr(h, 9, 1))::BIGINT % 2))::DOUBLE AS v FROM {name}_t GROUP BY ALL),
{name} AS (SELECT {key}, bucket, v / sqrt(sum(v * v) OVER (PARTITION BY {key})) AS v FROM {name}_b)"""


_FUSION = rf"""
WITH RECURSIVE {_ARTICLES.strip()}, {_DEDUP.strip()}, {_CHUNKS.strip()}, {_Q}, {_bm25("c", "chunk_key").strip()}, {_vector("c", "chunk_key", "text", "cv").strip()}, {_vector("q", "query_idx", "query", "qv").strip()},
dn0 AS (SELECT query_idx, chunk_key, round(coalesce(sum(cv.v * qv.v), 0), 6) AS dense FROM (SELECT query_idx, chunk_key FROM q, c) p LEFT JOIN qv USING (query_idx) LEFT JOIN cv USING (chunk_key, bucket) GROUP BY ALL),
dn AS (SELECT * FROM dn0 QUALIFY row_number() OVER (PARTITION BY query_idx ORDER BY dense DESC, chunk_key) <= 300),
lx0 AS (SELECT * FROM bm QUALIFY row_number() OVER (PARTITION BY query_idx ORDER BY bm25 DESC, chunk_key) <= 200),
lx AS (SELECT query_idx, chunk_key, round(CASE WHEN max(bm25) OVER (PARTITION BY query_idx) <= 0 THEN bm25 ELSE bm25 / max(bm25) OVER (PARTITION BY query_idx) END, 6) AS bm25 FROM lx0),
fu AS (SELECT query_idx, chunk_key, coalesce(dense, 0) AS dense, coalesce(bm25, 0) AS bm25, round(0.25::DOUBLE * coalesce(bm25, 0) + 0.75::DOUBLE * coalesce(dense, 0), 8) AS hybrid FROM dn FULL JOIN lx USING (query_idx, chunk_key)),
hy AS (SELECT * FROM fu QUALIFY row_number() OVER (PARTITION BY query_idx ORDER BY hybrid DESC, chunk_key) <= 500),
ru AS (SELECT query_idx, item_id, chunk_index, hybrid FROM hy JOIN c USING (chunk_key) WHERE hybrid > 0 QUALIFY row_number() OVER (PARTITION BY query_idx, item_id ORDER BY hybrid DESC, chunk_key) = 1),
mq AS (SELECT item_id, list_sort(list(DISTINCT query_idx)) AS matched FROM ru GROUP BY item_id),
me AS (SELECT item_id, chunk_index, hybrid, matched[1] AS primary_query, array_to_string(matched, ',') AS matched FROM ru JOIN mq USING (item_id) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY hybrid DESC, query_idx) = 1)"""

#: Then the cap, and the choice of at most 30 by a row for each candidate and step.
_CHOSEN = (
    _FUSION
    + """,
cp AS (SELECT me.*, c.chunk_key FROM me JOIN c USING (item_id, chunk_index) QUALIFY row_number() OVER (PARTITION BY primary_query ORDER BY hybrid DESC, item_id) <= 8),
po AS (SELECT *, row_number() OVER (ORDER BY hybrid DESC, item_id) AS pos, count(*) OVER () AS n FROM cp),
sm AS (SELECT a.pos AS x, b.pos AS y, coalesce(sum(av.v * bv.v), 0) AS sim FROM (SELECT a.pos, a.chunk_key FROM po a) a CROSS JOIN (SELECT b.pos, b.chunk_key FROM po b) b
       LEFT JOIN cv av ON av.chunk_key = a.chunk_key LEFT JOIN cv bv ON bv.chunk_key = b.chunk_key AND bv.bucket = av.bucket GROUP BY a.pos, b.pos),
mm AS (SELECT 1 AS step, po.pos, hybrid, sim AS nearest, po.pos = 1 AS chosen, po.pos = 1 AS now FROM po JOIN sm ON sm.x = 1 AND sm.y = po.pos
       UNION ALL
       SELECT step + 1, t.pos, hybrid, greatest(nearest, sim), chosen OR t.pos = best, t.pos = best
       FROM (SELECT *, first_value(pos) OVER (ORDER BY chosen, round(0.3::DOUBLE * hybrid - 0.7::DOUBLE * nearest, 9) DESC, pos) AS best FROM mm WHERE step < 30) t JOIN sm ON sm.x = best AND sm.y = t.pos),
ra AS (SELECT po.*, (CASE WHEN n <= 30 THEN po.pos ELSE step END)::INT AS rank FROM po LEFT JOIN (SELECT pos, step FROM mm WHERE now) s USING (pos) WHERE n <= 30 OR step IS NOT NULL)"""
)

_GATED = rf"""
WITH {_ARTICLES.strip()}, g AS (SELECT ord AS doc_id, CASE WHEN length(full_text) = 0 THEN 'empty_response' WHEN full_text_words < 200 THEN 'empty_extract' WHEN lang <> 'en' THEN 'lang_mismatch'
  WHEN length(full_text) < 1000 AND length(full_text) < 2 * length(content) THEN 'too_short' END AS failure_reason FROM a)"""
_SECS = r"len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) / 150.0::DOUBLE * 60.0::DOUBLE"
_WORDS = r"list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')"

def language_sql(table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    names = sorted(PROFILES)
    counts = ", ".join(f"len(list_filter(w, lambda x: x IN {PROFILES[n]!r})) AS n_{n}" for n in names)
    most = f"greatest({', '.join(f'n_{n}' for n in names)})"
    first = " ".join(f"WHEN n_{n} = {most} THEN '{n}'" for n in names)
    words = rf"list_filter(string_split_regex(lower(left({text}, 1000)), '\s+'), lambda x: x <> '')"
    return f"""
WITH t AS (SELECT {key}, list_transform({words}, lambda x: trim(x, '.,;:!?()"''')) AS w FROM {table}), c AS (SELECT {key}, {counts} FROM t)
SELECT {key}, CASE WHEN {most} = 0 THEN 'unknown' {first} END AS guess FROM c"""


#: Trigrams of all texts, their counts by language, the 65536 most frequent with their smoothed logarithms, and each text's sums.
_TRIGRAMS = """
t AS (SELECT doc_id, lang, string_split(' ' || lower(text) || ' ', '') AS c FROM documents WHERE text <> ''),
g AS (SELECT doc_id, lang, unnest(list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2])) AS gram FROM t),
l AS (SELECT lang, ln(count(*) / sum(count(*)) OVER ()) AS prior FROM documents WHERE doc_id % 5 <> 0 AND lang IS NOT NULL GROUP BY lang),
k AS (SELECT gram, lang, count(*) AS n FROM g WHERE doc_id % 5 <> 0 AND lang IS NOT NULL GROUP BY gram, lang),
v AS (SELECT count(DISTINCT gram) AS v FROM k), z AS (SELECT lang, sum(n) AS z FROM k GROUP BY lang),
b AS (SELECT gram FROM k GROUP BY gram ORDER BY sum(n) DESC, gram LIMIT 65536),
w AS (SELECT b.gram, l.lang, ln((coalesce(k.n, 0) + 1) / (coalesce(z.z, 0) + v.v)::DOUBLE) AS w FROM b CROSS JOIN l CROSS JOIN v LEFT JOIN z ON z.lang = l.lang LEFT JOIN k ON k.gram = b.gram AND k.lang = l.lang),
h AS (SELECT doc_id, gram, count(*) AS n FROM g GROUP BY doc_id, gram),
s AS (SELECT doc_id, w.lang, sum(h.n * w) AS s FROM h JOIN w USING (gram) GROUP BY doc_id, w.lang),
r AS (SELECT d.doc_id, d.lang AS truth, l.lang, round(coalesce(s, 0) + prior, 3) AS score FROM documents d CROSS JOIN l LEFT JOIN s ON s.doc_id = d.doc_id AND s.lang = l.lang),
y AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang) = 1)"""

ORACLE_SQL = {
    "language_fit": f"WITH {_TRIGRAMS} SELECT doc_id, doc_id % 5 = 0 AS held_out, lang AS language, score FROM y",
    "language_accuracy": f"WITH {_TRIGRAMS} SELECT truth AS lang, count(*) AS n, count(*) FILTER (lang = truth) AS n_right FROM y WHERE doc_id % 5 = 0 AND truth IS NOT NULL GROUP BY ROLLUP (truth)",
    # these pages have one article of a heading and paragraphs; what surrounds it is named or full of links
    "extract_main": rf"""
WITH a AS (SELECT page_id, string_split_regex(regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1), '</?(?:h1|p)[^>]*>') AS runs, contains(html, '<h1') AS headed FROM pages),
b AS (SELECT page_id, unnest(runs) AS run, generate_subscripts(runs, 1) AS place FROM a),
c AS (SELECT page_id, place, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(run, '<[^>]*>', ' ', 'g'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '\s+', ' ', 'g')) AS run FROM b),
d AS (SELECT *, CASE WHEN place = 2 THEN greatest(length(run) - {LEAF_COST}, 1) ELSE length(run) - {LEAF_COST} END AS weight FROM c WHERE run <> ''),
e AS (SELECT page_id, sum(weight) AS worth, max(weight) AS most, string_agg(run, chr(10) ORDER BY place) AS text, first(run ORDER BY weight DESC, place) AS single FROM d WHERE weight > 0 GROUP BY page_id)
SELECT p.page_id, CASE WHEN worth - {HOLDER_COST} > most THEN text ELSE single END AS text FROM pages p LEFT JOIN e USING (page_id)""",
    "recent_items": f"SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 3 DAYS",
    "dedup_url_latest": f"WITH {_ARTICLES}, {_DEDUP} SELECT ord AS doc_id, item_id FROM u",
    "dedup_title_longest": f"WITH {_ARTICLES}, {_DEDUP} SELECT ord AS doc_id, item_id FROM t",
    "dedup_union": f"WITH {_ARTICLES}, {_DEDUP} SELECT ord AS doc_id, item_id, first[1] AS src, first[2] AS at FROM m",
    "new_items_anti": f"WITH {_ARTICLES} SELECT min(ord) AS doc_id, item_id FROM a WHERE item_id NOT IN (SELECT item_id FROM a WHERE n_chars >= 1000) GROUP BY item_id",
    "collection_summary": f"WITH {_ARTICLES} SELECT count(DISTINCT source) AS n_feeds, count(*) AS n_items, count(*) FILTER (title <> '' AND url <> '' AND content <> '') AS n_non_empty FROM a",
    "retrieval_text": f"WITH {_ARTICLES} SELECT ord AS doc_id, length({_RETRIEVAL})::INT AS n, md5({_RETRIEVAL}) AS md5 FROM a",
    "segment_ids": f"WITH {_ARTICLES} SELECT ord AS doc_id, 'SEG_' || trim(left(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), 40), '-') AS segment_id FROM a",
    "snippets": f"SELECT doc_id, array_to_string({_WORDS}[1:40], ' ') || '...' AS snippet, left(text, 150) || '...' AS preview FROM documents",
    "word_counts": f"SELECT doc_id, len({_WORDS})::INT AS n_words, round({_SECS}, 6) AS secs FROM documents",
    "chunk_documents": f"WITH RECURSIVE {_ARTICLES}, {_DEDUP}, {_CHUNKS} SELECT item_id, chunk_index, chunk_count, (char_end - length(text))::INT AS char_start, char_end, md5(text) AS md5 FROM c",
    "chunk_stats": f"WITH RECURSIVE {_ARTICLES}, {_DEDUP}, {_CHUNKS} SELECT count(*) AS n_chunks, count(*) FILTER (chunk_index = 0) AS n_articles, max(chunk_count) AS most, sum(length(text))::BIGINT AS chars FROM c",
    "vector_topk": """
WITH p AS (SELECT q.vec_id AS query_idx, e.vec_id, round(list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS dense FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0)
SELECT query_idx, vec_id, dense, (row_number() OVER (PARTITION BY query_idx ORDER BY dense DESC, vec_id))::INT AS rank FROM p QUALIFY rank <= 30""",
    "vector_topk_by_label": """
WITH p AS (SELECT q.vec_id AS query_idx, e.vec_id, round(list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS dense FROM embeddings e JOIN embeddings q ON e.label = q.label WHERE q.vec_id % 50 = 0)
SELECT query_idx, vec_id, dense, (row_number() OVER (PARTITION BY query_idx ORDER BY dense DESC, vec_id))::INT AS rank FROM p QUALIFY rank <= 10""",
    "bm25_corpus_stats": f"WITH {_Q}, {_bm25('documents', 'doc_id')} SELECT (SELECT n::BIGINT FROM nn) AS n_docs, (SELECT round(mean, 6) FROM nn) AS mean_length, count(*) AS n_terms, sum(df)::BIGINT AS n_postings, round(avg(raw), 6) AS mean_idf, count(*) FILTER (raw < 0) AS n_negative FROM df",
    "bm25_topk": f"WITH {_Q}, {_bm25('documents', 'doc_id')} SELECT query_idx, doc_id, bm25, (row_number() OVER (PARTITION BY query_idx ORDER BY bm25 DESC, doc_id))::INT AS rank FROM bm QUALIFY rank <= 200",
    "bm25_index_topk": f"WITH {_Q}, {_bm25('documents', 'doc_id')} SELECT query_idx, doc_id, bm25, (row_number() OVER (PARTITION BY query_idx ORDER BY bm25 DESC, doc_id))::INT AS rank FROM bm QUALIFY rank <= 10",
    "bm25_normalised": f"WITH {_Q}, {_bm25('documents', 'doc_id')} SELECT query_idx, doc_id, round(bm25 / max(bm25) OVER (PARTITION BY query_idx), 6) AS bm25 FROM bm",
    "hybrid_fusion": f"{_FUSION} SELECT query_idx, chunk_key, dense, bm25, hybrid FROM hy",
    "article_rollup": f"{_FUSION} SELECT query_idx, item_id, chunk_index, hybrid FROM ru",
    "multi_query_merge": f"{_FUSION} SELECT item_id, chunk_index, hybrid, primary_query, matched FROM me",
    "per_query_cap": f"{_FUSION} SELECT primary_query, (row_number() OVER (PARTITION BY primary_query ORDER BY hybrid DESC, item_id))::INT AS query_rank, item_id, hybrid FROM me QUALIFY query_rank <= 8",
    "mmr_select": f"{_CHOSEN} SELECT item_id, rank FROM ra",
    "retrieve_end_to_end": f"{_CHOSEN} SELECT rank, item_id, m.title, m.source, hybrid, chunk_index, len(string_split(matched, ','))::INT AS n_queries FROM ra JOIN m USING (item_id)",
    "html_clean": r"""
WITH a AS (SELECT page_id, string_split_regex(CASE WHEN contains(html, '<article') THEN regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1) ELSE regexp_replace(html, '(?s)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>', '', 'g') END, '(?s)<[^>]*>') AS nodes FROM pages),
d AS (SELECT page_id, list_transform(nodes, lambda x: regexp_replace(replace(replace(replace(replace(x, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '^\s+|\s+$', '', 'g')) AS nodes FROM a),
j AS (SELECT page_id, array_to_string(list_filter(nodes, lambda x: x <> ''), chr(10)) AS t FROM d)
SELECT page_id, array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), chr(10)) AS text FROM j""",
    "html_variants_found": """
SELECT page_id, concat_ws(' ', nullif(regexp_extract(html, '<link[^>]*rel="amphtml"[^>]*href="([^"]+)"', 1), ''), CASE WHEN NOT contains(url, '/print') AND NOT contains(url, '?print') THEN url || CASE WHEN url LIKE '%/' THEN 'print' ELSE '/print' END END) AS variants FROM pages""",
    "fetch_gates": r"""
WITH d AS (SELECT *, [200, 404, 503, 0, 408, 200, 499, 500, 302, NULL][doc_id % 10 + 1] AS s, CASE WHEN doc_id % 17 <> 5 THEN length(text) END AS size, CASE WHEN doc_id % 19 <> 7 THEN text ELSE '' END AS t FROM documents)
SELECT doc_id, CASE WHEN doc_id % 9 > 0 AND doc_id % 13 = 1 THEN 'robots_disallow' WHEN doc_id % 8 > 0 AND doc_id % 11 = 3 THEN 'paywall' WHEN s BETWEEN 400 AND 499 THEN 'http_4xx' WHEN s >= 500 THEN 'http_5xx' WHEN coalesce(s, 0) = 0 THEN 'timeout'
  WHEN coalesce(size, 0) = 0 THEN 'empty_response' WHEN t = '' THEN 'empty_extract' WHEN lang NOT IN ('en', 'fr') THEN 'lang_mismatch'
  WHEN length(t) < 1000 AND length(t) < 2 * length(split_part(text, chr(10), 1)) THEN 'too_short' END AS failure_reason FROM d""",
    "line_checks": f"""
WITH l AS (SELECT *, (turn + conv_id) % 6 AS r, {_WORDS} AS w FROM conversations)
SELECT conv_id, turn, CASE WHEN turn % 23 = 11 THEN 'missing line_id' WHEN r = 5 THEN 'missing refs' WHEN turn % 7 = 6 THEN 'missing pause_ms_after' WHEN role NOT IN ('user', 'assistant') THEN 'speaker' WHEN len(w) > 40 THEN 'too long'
  WHEN conv_id % 3 = 0 AND r = 1 THEN 'no refs' WHEN conv_id % 3 = 0 AND r IN (2, 3, 4) THEN 'refs out of range' END AS error FROM l""",
    "url_domain": r"""SELECT page_id, regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1) AS netloc,
  array_to_string(string_split(lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)), '.')[-2:], '.') AS domain, md5(url) AS item_id FROM pages""",
    "paywall_flag": "SELECT page_id, " + " OR ".join(f"contains(lower(html), '{m}')" for m in enrich.PAYWALL_MARKS) + " AS paywall FROM pages",
    "language_guess": language_sql(),
    "quality_gate": f"{_GATED} SELECT doc_id, failure_reason FROM g",
    "failure_histogram": f"{_GATED} SELECT failure_reason, count(*) AS n FROM g WHERE failure_reason IS NOT NULL GROUP BY failure_reason",
    "enrichment_summary": f"{_GATED} SELECT count(*) AS attempted, count(*) FILTER (failure_reason IS NULL) AS succeeded, count(failure_reason) AS failed, 0::BIGINT AS skipped, count(failure_reason) AS dropped, min(failure_reason) AS first_reason FROM g",
    "jsonl_parse_validate": f"SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn))::INT AS line_id, CASE WHEN role NOT IN ('user', 'assistant') THEN 'speaker' WHEN len({_WORDS}) > 40 THEN 'too long' END AS error FROM conversations",
    "apply_order": """SELECT n_name, (row_number() OVER (ORDER BY CASE n_nationkey WHEN 5 THEN 0 WHEN 3 THEN 1 WHEN 7 THEN 2 WHEN 0 THEN 7 ELSE 100 + n_nationkey END))::INT AS position FROM nation""",
    "speaker_balance": """WITH s AS (SELECT role AS speaker, count(*) AS n FROM conversations GROUP BY role), w AS (SELECT sum(n) AS t, count(*) AS k FROM s)
SELECT speaker, n, round(n / t * 100, 6) AS pct, round(100 / k, 6) AS expected, k < 2 OR abs(n / t * 100 - 100 / k) <= 10 AS balanced FROM s, w""",
    "total_duration": f"SELECT conv_id, round(sum({_SECS} + 120 / 1000.0::DOUBLE), 6) AS total_secs, count(*) AS n_lines FROM conversations GROUP BY conv_id",
    "line_numbering": "SELECT conv_id, turn AS pos, (row_number() OVER (PARTITION BY conv_id ORDER BY turn))::INT AS line_id FROM conversations",
    "ssml": "SELECT conv_id, turn AS pos, '<speak>' || text || '<break time=''120ms''/></speak>' AS ssml FROM conversations",
    "tts_normalise": r"SELECT conv_id, turn, regexp_replace(text, '\b(?:THE|The|ThE)\b', 'THE-NAME', 'g') AS text FROM conversations",
}
