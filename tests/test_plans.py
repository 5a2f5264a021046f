import hashlib
import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from docmill import schemas
from docmill.config import CollectConfig, EnrichConfig, PolishConfig, RetrieveConfig, ScriptConfig
from docmill.models import ScriptedModel, TableFetcher
from docmill.plans import collect, enrich, retrieve, script
from docmill.sources import readers, writers
from docmill.streaming.ingest import run_ingest

DAY = datetime(2024, 1, 31)
RSS = """<?xml version="1.0"?><rss><channel><title>Feed</title>
<item><title>T1</title><link>http://e/1</link><pubDate>Tue, 30 Jan 2024 00:00:00 GMT</pubDate><description>&lt;p&gt;Hello&lt;/p&gt;</description></item>
<item><title>T2</title><guid>http://e/2</guid><description>x</description></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>A1</title><link rel="self" href="no"/><link href="http://e/3"/><updated>2024-01-30T00:00:00Z</updated><summary>s</summary></entry></feed>"""


def test_collect(spark, tmp_path):
    feeds = spark.createDataFrame([("http://f/1", "One", ["t"]), ("http://f/2", None, []), ("http://f/3", "Gone", []), ("http://f/4", "Broken", [])], schemas.FEEDS)
    client = TableFetcher({"http://f/1": (200, RSS.encode()), "http://f/2": (200, ATOM.encode()), "http://f/4": (200, b"<rss><item>")})
    entries = collect.entries_table(collect.fetched_feeds(feeds, client, sleep=lambda s: None))
    path, cache = str(tmp_path / "raw"), str(tmp_path / "cache")
    first = collect.collect_items(spark, entries, path, DAY, CollectConfig(), cache_path=cache).first()
    again = collect.collect_items(spark, entries, path, DAY).first()
    assert tuple(first) == tuple(again) == (2, 3, 3)
    rows = {r.url: (r.title, r.content, r.source) for r in spark.read.parquet(path).collect()}
    assert rows == {"http://e/1": ("T1", "Hello", "One"), "http://e/2": ("T2", "x", "One"), "http://e/3": ("A1", "s", "http://f/2")}
    assert spark.read.parquet(cache).where("run_date = '2024-01-31'").count() == 3
    ran = []
    assert collect.within_budget([lambda: ran.append(1)] * 5, 2, iter(range(9)).__next__) == 2 and len(ran) == 2


def test_readers_and_writers(spark, tmp_path):
    p = lambda n: str(tmp_path / n)
    (tmp_path / "rss.xml").write_text(RSS)
    assert [(r.title, r.id) for r in readers.read_rss(spark, p("rss.xml")).orderBy("title").collect()] == [("T1", None), ("T2", "http://e/2")]
    (tmp_path / "feeds.json").write_text(json.dumps({"defaults": {"user_agent": "ua"}, "feeds": [{"url": "u", "topics": ["x"]}, {"label": "l"}]}))
    assert [(r.url, r.label, r.user_agent) for r in readers.read_feeds(spark, p("feeds.json")).collect()] == [("u", None, "ua"), (None, "l", "ua")]
    (tmp_path / "q.json").write_text(json.dumps({"queries": [{"query": "a", "expansions": ["b"]}, {"query": "c"}]}))
    assert [tuple(r) for r in readers.read_queries(spark, p("q.json")).orderBy("query_idx").collect()] == [(0, "a", ["b"]), (1, "c", None)]
    (tmp_path / "bare.json").write_text(json.dumps([{"item_id": "1", "full_text_words": 3}]))
    (tmp_path / "broken.json").write_text("{")
    assert [(r.ord, r.item_id, r.full_text_words) for r in readers.read_items(spark, p("bare.json")).collect()] == [(0, "1", 3)]
    assert readers.read_items(spark, p("broken.json")).count() == readers.read_items(spark, p("missing.json")).count() == 0
    rows = spark.createDataFrame([(2, "b"), (1, "a")], "line_id int, text string")
    writers.write_envelope(rows, p("env"), "lines", "line_id", run_date="d")
    writers.write_envelope(rows, p("env"), "lines", "line_id", run_date="d")
    assert json.loads(spark.read.text(p("env")).first()[0]) == {"run_date": "d", "count": 2, "lines": [{"text": "a"}, {"text": "b"}]}
    writers.write_lines(rows, p("lines"))
    assert [json.loads(r[0])["line_id"] for r in spark.read.text(p("lines")).collect()] == [1, 2]
    assert readers.read_script_lines(spark, p("lines")).where("text = 'a'").count() == 1
    vectors = spark.createDataFrame([("a", [1.0])], "id string, embedding array<double>")
    writers.write_vectors(vectors, p("vec"))
    assert readers.n_vectors(readers.read_vectors(spark, p("vec"))) == 1


def test_enrich(spark):
    page = ("<article>" + "the cat and the dog is in the house of this man " * 60 + "</article>").encode()
    items = [(0, "http://a.com/ok"), (1, "http://a.com/no"), (2, "http://b.com/wall"), (3, "http://b.com/404"), (4, "http://b.com/short"), (5, "http://b.com/done"), (6, "http://b.com/unfetched")]
    rows = [(k, f"i{k}", u, "t", "c", k == 5, "kept" if k == 5 else None, None, 9 if k == 5 else None) for k, u in items]
    table = spark.createDataFrame(rows, "item_index int, item_id string, url string, title string, content string, has_fulltext boolean, full_text string, extraction_method string, full_text_words int")
    robots = spark.createDataFrame([("a.com", 200, "User-agent: *\nDisallow: /no")], schemas.ROBOTS)
    pages = [("http://a.com/ok", 200, page, False), ("http://a.com/no", 200, page, False), ("http://b.com/wall", 200, page, True), ("http://b.com/404", 404, page, False), ("http://b.com/short", 200, b"<p>few words</p>", False)]
    fetches = spark.createDataFrame([(u, s, u, h, w) for u, s, h, w in pages], schemas.FETCHES)
    out, stats = enrich.enriched(table, robots, fetches)
    got = {r.item_id: (r.has_fulltext, r.extraction_method, r.full_text_words) for r in out.collect()}
    assert got == {"i0": (True, "article", 720), "i5": (True, None, 9)}
    s = stats.first()
    assert (s.attempted, s.succeeded, s.failed, s.skipped) == (6, 1, 5, 1)
    assert s.failed_by_reason == {"robots_disallow": 1, "paywall": 1, "http_4xx": 1, "empty_extract": 1, "timeout": 1}
    forced, _ = enrich.enriched(table, robots, fetches, EnrichConfig(force=True, respect_paywalls=False))
    assert {r.item_id for r in forced.collect()} == {"i0", "i2"}


def article_table(spark, n=40):
    words = ["robot", "chip", "model", "cloud", "car", "law"]
    rows = []
    for k in range(n):
        text = " ".join(f"{words[k % 6]} {words[(k + j) % 6]} w{k}x{j}." for j in range(60))
        rows.append((k, f"i{k:02d}", f"s{k % 3}", f"http://e/{k}", f"Title {k}", DAY + timedelta(minutes=k), ["t"], text[:50], None, k % 4 != 0, text, "article", 180))
    return spark.createDataFrame(rows, "ord int, item_id string, source string, url string, title string, published_at timestamp, topics array<string>, content string, cached_path string, has_fulltext boolean, full_text string, extraction_method string, full_text_words int")


def test_retrieve(spark):
    a = article_table(spark)
    queries = spark.createDataFrame([(0, "robot", ["chip"]), (1, "law", []), (2, "nothing here", None)], "query_idx int, query string, expansions array<string>")
    config = RetrieveConfig(final_limit=7, per_query_cap=5)
    out = retrieve.retrieve(a, queries, config).orderBy("rank").collect()
    assert [r["rank"] for r in out] == list(range(1, 8)) and len({r.item_id for r in out}) == 7
    for r in out:
        assert r.score.hybrid == pytest.approx(0.25 * r.score.lexical + 0.75 * r.score.dense, abs=1e-6) and r.score.hybrid > 0
        assert r.matched_queries and r.best_chunk.snippet.endswith("...") and r.best_chunk.char_range[0] <= r.best_chunk.char_range[1]
    assert out[0].score.hybrid == max(r.score.hybrid for r in out)
    assert [tuple(r) for r in out] == [tuple(r) for r in retrieve.retrieve(a.repartition(7), queries, config).orderBy("rank").collect()]
    chunks = retrieve.article_chunks(a)
    scored = retrieve.scored_chunks(chunks, queries)
    merged = retrieve.merged_articles(scored, chunks)
    counts = retrieve.retrieval_statistics(chunks, merged, merged, merged).first()
    assert counts.n_chunks >= 40 and counts.n_candidates <= 40
    assert retrieve.retrieve(a.where("1 = 0"), queries).count() == 0


def test_script(spark, tmp_path):
    def answer(system, prompt):
        if system.startswith("Condense"):
            return "• fact one\n• fact two" if "Title 3" not in prompt else "no bullets"
        if system.startswith("Order"):
            return "```json\n[2, 0]\n```"
        if system.startswith("Write at most"):
            first, own, *_ = prompt.split("\n")
            name = first.split()[0]
            rows = [{"speaker": name, "item_id": own, "text": "hello there", "refs": [0], "pause_ms_after": 100, "segment_id": ""}, {"speaker": "Nobody", "item_id": own, "text": "x", "refs": [0], "pause_ms_after": 0, "segment_id": "z"}, {"speaker": name, "item_id": own, "text": "NOVA again", "refs": [1], "pause_ms_after": 50, "segment_id": ""}]
            return "\n".join(map(json.dumps, rows))
        if system.startswith("Polish"):
            if "title-2" in prompt:
                raise OSError("down")
            return "\n".join(json.dumps({**json.loads(x), "text": "polished " + json.loads(x)["text"]}) for x in prompt.split("\n"))
        if "introduction" in system:
            return json.dumps({"speaker": "Adam", "text": "Welcome to NOVA", "pause_ms_after": 10})
        raise OSError("down")

    import docmill.models

    model, a = ScriptedModel(answer), article_table(spark, 4)
    a = a.withColumn("full_text", F.when(F.col("ord") == 1, " ").otherwise(F.col("full_text")))
    quick = pytest.MonkeyPatch()
    quick.setattr(docmill.models.time, "sleep", lambda s: None)
    items, counts = script.headlined(a, model)
    assert tuple(counts.first()) == (3, 1)
    ordered = script.sequenced(items, model)
    assert [r.item_id for r in ordered.orderBy("position").collect()] == ["i03", "i00", "i02"]
    lines = script.dialogue(ordered, model)
    got = [(r.line_id, r.segment_id, r.speaker, r.item_id) for r in lines.orderBy("line_id").collect()]
    assert got == [(1, "SEG_title-0", "Sara", "i00"), (3, "SEG_title-0", "Sara", "i00"), (4, "SEG_title-2", "Adam", "i02"), (6, "SEG_title-2", "Adam", "i02")]
    smooth = script.polished(lines, model, polish=PolishConfig(enable_ssml=True))
    assert sorted(r.text.split()[0] for r in smooth.collect()) == ["NOVA", "hello", "polished", "polished"]
    final = script.framed_script(spark, ordered, smooth, model, ScriptConfig(show_name="nova")).orderBy("line_id").collect()
    assert [r.line_id for r in final] == [1, 2, 3, 4, 5] and final[0].text == "Welcome to nova" and final[0].segment_id == "SEG_0"
    quick.undo()
    path, made = str(tmp_path / "x"), []
    assert script.unless_there(spark, path, lambda: (made.append(1), writers.replace_table(lines, path)))
    assert not script.unless_there(spark, path, lambda: made.append(2)) and made == [1]


def test_streaming_takes_each_item_once(spark, tmp_path):
    p = lambda n: str(tmp_path / n)
    rows = [(None, "s", f"http://e/{k % 5}", "t", DAY + timedelta(minutes=k), [], "c", None) for k in range(10)]
    spark.createDataFrame(rows, schemas.RAW_ITEMS).write.parquet(p("in"))
    for _ in range(2):
        run_ingest(spark, p("in"), p("out"), p("check")).awaitTermination(120)
    assert spark.read.parquet(p("out")).count() == 5
    spark.createDataFrame([(None, "s", "http://e/9", "t", DAY, [], "c", None), *rows[:2]], schemas.RAW_ITEMS).write.mode("append").parquet(p("in"))
    run_ingest(spark, p("in"), p("out"), p("check")).awaitTermination(120)
    assert spark.read.parquet(p("out")).count() == 6


def test_entry_names():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and "retrieve_end_to_end" in q


def test_whole_texts_are_read(spark, tmp_path):
    """A text of 401 to 999 characters, and first lines that differ only after 60: against plain Python and the SQL."""
    import duckdb

    from docmill import queries

    text = lambda n: ("a" * 70 + str(n) + "\n" + "word " * 120 + f"end{n}").ljust(700, "z")
    rows = [(n, text(n), "en", "s", 700) for n in range(3)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    run = lambda name: {tuple(r) for r in queries.QUERIES[name](spark, str(tmp_path)).collect()}
    assert run("retrieval_text") == {(n, 700, hashlib.md5(t.encode()).hexdigest()) for n, t, *_ in rows}
    assert len(run("dedup_title_longest")) == 3
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    for name in ("retrieval_text", "dedup_union", "chunk_documents", "segment_ids", "quality_gate"):
        assert run(name) == set(db.execute(queries.ORACLE_SQL[name]).fetchall()), name


def test_entry_runs(spark):
    out = entry.entry(spark)
    assert out.count() == 30 and out.columns[0] == "rank"


def test_command_line(spark, tmp_path):
    from docmill.__main__ import main

    p = lambda n: str(tmp_path / n)
    (tmp_path / "feed.xml").write_text(RSS)
    main(["collect", "--rss", p("feed.xml"), "--source", "s", "--as-of", "2024-01-31T00:00:00", "--out", p("raw")], spark)
    assert spark.read.parquet(p("raw")).count() == 2
    rows = [json.loads(r[0]) for r in article_table(spark, 12).drop("ord").select(F.to_json(F.struct("*"))).collect()]
    (tmp_path / "items.json").write_text(json.dumps({"articles": rows}))
    (tmp_path / "queries.json").write_text(json.dumps({"queries": [{"query": "robot chip", "expansions": ["law"]}]}))
    main(["retrieve", "--items", p("items.json"), "--queries", p("queries.json"), "--out", p("ranked")], spark)
    made = json.loads(spark.read.text(p("ranked")).first()[0])
    assert made["count"] == len(made["articles"]) == 8 and made["articles"][0]["matched_queries"] == ["robot chip"]
    spark.createDataFrame([], schemas.ROBOTS).write.parquet(p("robots"))
    spark.createDataFrame([(r["url"], 404, r["url"], b"", False) for r in rows], schemas.FETCHES).write.parquet(p("fetches"))
    main(["enrich", "--items", p("items.json"), "--robots", p("robots"), "--fetches", p("fetches"), "--out", p("enriched")], spark)
    # nine of twelve were enriched before and are kept; the others' pages are gone
    assert spark.read.parquet(p("enriched")).count() == 9
