import json
import math
import re
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docmill import schemas
from docmill.operators import bm25, dedup, enrich, hybrid, script
from docmill.operators.chunk import chunked, chunks_of
from docmill.operators.collect import collection_counts, items_from_entries, new_items, short_of, usable_feeds
from docmill.operators.mmr import mmr_order, mmr_select
from docmill.operators.vector import check_dimension, embedded, vector_top_k

DAY = datetime(2024, 1, 31)


def chunk_brute(text):
    """The chunk rule in plain Python: 1600 characters, 240 of them again, a break counts from 1121 on."""

    def pieces(at):
        if at >= len(text):
            return
        inner = at + 1600 < len(text)
        breaks = [m.start() for m in re.finditer(r"\.(?= )|\n", text[at : at + 1600]) if m.start() > 1120 and (m[0] != "." or m.start() < 1599)]
        size = breaks[-1] + 1 if inner and breaks else 1600
        yield text[at : at + size].strip()
        yield from pieces(at + size - 240)

    return list(pieces(0)) if len(text) > 1600 else [text]


@pytest.mark.parametrize(("n", "sizes"), [(1600, [1600]), (1601, [1600, 241]), (2959, [1600, 1599, 239]), (2960, [1600, 1600, 240]), (2961, [1600, 1600, 241]), (3000, [1600, 1600, 280])])
def test_known_chunk_sizes(spark, n, sizes):
    rows = spark.createDataFrame([("x" * n,)], "t string")
    assert [len(c) for c in rows.select(chunks_of(F.col("t"))).first()[0]] == sizes


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["word ", "end. ", "\n", "é" * 30, " ", ". "]), max_size=900), min_size=1, max_size=5))
def test_chunks_property(spark, parts):
    texts = ["".join(p) for p in parts]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert [r[1] for r in rows.select("i", chunks_of(F.col("t"))).orderBy("i").collect()] == [chunk_brute(t) for t in texts]


def test_break_only_past_seventy_percent(spark):
    texts = ["a" * 1120 + ". " + "b" * 900, "a" * 1121 + ". " + "b" * 900, "a" * 1300 + "\n" + "b" * 900]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert [r[1] for r in rows.select("i", chunks_of(F.col("t"))).orderBy("i").collect()] == [chunk_brute(t) for t in texts]


def test_chunk_offsets_and_counts(spark):
    rows = spark.createDataFrame([(1, "x" * 2000), (2, ""), (3, None), (4, " short ")], "i int, text string")
    got = [(r.i, r.chunk_index, r.chunk_count, r.char_start, r.char_end) for r in chunked(rows).orderBy("i", "chunk_index").collect()]
    assert got == [(1, 0, 2, 0, 1600), (1, 1, 2, 1600, 2240), (4, 0, 1, 0, 7)]


def articles(spark, rows):
    full = [(k, f"id{u}", u, t, DAY + timedelta(days=d), w) for k, (u, t, d, w) in enumerate(rows)]
    return spark.createDataFrame(full, "ord int, item_id string, url string, title string, published_at timestamp, full_text_words int")


def test_deduplication(spark):
    a = articles(spark, [("u1", "A", 0, 5), ("u1", "B", 1, 1), ("u2", " a ", 0, 9), ("u3", "C", 0, None), ("u3", "c", 0, 0)])
    assert sorted(r.ord for r in dedup.latest_by_url(a).collect()) == [1, 2, 3]
    assert sorted(r.ord for r in dedup.longest_by_title(a).collect()) == [1, 2, 3]
    b = articles(spark, [("u1", "A", 0, 5), ("u2", "a", 0, 9), ("u1", "Z", 3, 1), ("u1", "Q", 1, 8)])
    got = {(r.ord, r.position.src, r.position.ord) for r in dedup.deduplicated(b).collect()}
    # u1 wins by url with row 2; titles keep rows 1, 2, 3; of u1's title winners the later one's values stand at row 2's place
    assert got == {(3, 0, 2), (1, 0, 1)}
    assert sorted(r.ord for r in dedup.deduplicated(b, strict=True).collect()) == [1, 2]


def test_collection(spark):
    entry = lambda **x: tuple(x.get(f) for f in schemas.ENTRIES.names)
    rows = [
        entry(link="http://e/1", title=" One ", summary="<p>Hi</p>", published="bad", updated="2024-01-30T00:00:00Z"),
        entry(id="http://e/2", title="Two", description="<script>x</script>", published="2024-01-28T00:00:00Z"),
        entry(link="http://e/3", title="Old", summary="s", published="2024-01-27T23:59:59Z"),
        entry(title="No address", summary="s"),
        entry(link="http://e/4", title="  ", summary="s"),
        entry(link="http://e/5", title="Fetched", published="2024-01-30T00:00:00Z"),
        entry(link="http://e/6", title="Not fetched"),
        entry(link="http://e/1", title="Again", summary="later"),
    ]
    e = spark.createDataFrame(rows, schemas.ENTRIES).coalesce(1).withColumn("ord", F.monotonically_increasing_id()).withColumn("source", F.lit("s")).withColumn("topics", F.array(F.lit("t")))
    bodies = spark.createDataFrame([("http://e/5", "<article>Body</article>")], "url string, html string")
    items = items_from_entries(e, F.lit(DAY), bodies=bodies)
    got = {r.url: (r.title, r.content, r.published_at) for r in new_items(items, spark.createDataFrame([], "item_id string")).collect()}
    assert got == {"http://e/1": ("One", "Hi", datetime(2024, 1, 30)), "http://e/2": ("Two", "", datetime(2024, 1, 28)), "http://e/5": ("Fetched", "Body", datetime(2024, 1, 30))}
    known = items.where("url = 'http://e/1'").select("item_id")
    assert {r.url for r in new_items(items, known).collect()} == {"http://e/2", "http://e/5"}
    assert tuple(collection_counts(items).first()) == (1, 4, 3) and short_of(items)
    feeds = spark.createDataFrame([("u", None, []), (None, "l", []), ("", "m", [])], schemas.FEEDS)
    assert [r.label for r in usable_feeds(feeds).collect()] == ["u"]


def bm25_brute(docs, query):
    tokens = [d.lower().split() for d in docs]
    df = Counter(w for t in tokens for w in set(t))
    n, mean = len(docs), sum(map(len, tokens)) / len(docs)
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    idf = {w: v if v >= 0 else floor for w, v in raw.items()}
    return [sum(idf.get(w, 0) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / mean)) for w in query.lower().split()) for t in tokens]


def test_bm25(spark):
    docs = ["the cat; sat", "The the dog sat", "the bird", "a cat the cat cat", "the"]
    queries = ["the cat cat", "cat; unknown", "DOG sat the"]
    d = spark.createDataFrame(list(enumerate(docs)), "i int, text string")
    q = spark.createDataFrame(list(enumerate(queries)), "query_idx int, query string")
    got = {(r.query_idx, r.i): r.bm25 for r in bm25.bm25_scores(d, q, "i").collect()}
    for k, text in enumerate(queries):
        for i, want in enumerate(bm25_brute(docs, text)):
            assert got.get((k, i), 0.0) == pytest.approx(want, abs=1e-6)
    top = bm25.top_k(bm25.normalised(bm25.bm25_scores(d, q, "i"), "bm25"), "bm25", "i", 1).collect()
    assert len(top) == 3 and all(r.bm25 == pytest.approx(1.0) for r in top if r.bm25 > 0)


@pytest.mark.parametrize("block", [3, 100])
def test_vector_top_k(spark, block):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(200, 8)).round(2)
    v[50] = v[51]
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(999, None)], "i int, embedding array<double>").repartition(5)
    q = spark.createDataFrame([(k, v[k * 7].tolist()) for k in range(10)], "query_idx int, embedding array<double>")
    got = {(r.query_idx, r["rank"]): (r.i, r.dense) for r in vector_top_k(rows, q, "i", 12, block=block).collect()}
    for k in range(10):
        s = np.round(v @ v[k * 7], 6)
        for rank, i in enumerate(sorted(range(200), key=lambda i: (-s[i], i))[:12], 1):
            assert got[k, rank] == (i, pytest.approx(s[i]))
    assert vector_top_k(rows, q.where("1 = 0"), "i", 3).count() == 0 and vector_top_k(rows.where("1 = 0"), q, "i", 3).count() == 0


def test_embeddings_have_one_length(spark):
    rows = embedded(spark.createDataFrame([("a b",), (None,)], "text string"))
    assert check_dimension(rows, "embedding", 64).select(F.size("embedding")).distinct().collect()[0][0] == 64
    with pytest.raises(Exception, match="expected 3"):
        check_dimension(rows, "embedding", 3).collect()


def test_fusion_rollup_merge_cap(spark):
    dense = spark.createDataFrame([(0, 1, 0.9), (0, 2, -0.5), (1, 1, 0.4), (1, 3, 0.4)], "query_idx int, k int, dense double")
    lex = spark.createDataFrame([(0, 2, 1.0), (0, 3, 0.2), (1, 3, 0.0)], "query_idx int, k int, bm25 double")
    f = {(r.query_idx, r.k): r.hybrid for r in hybrid.fused(dense, lex, "k").collect()}
    assert f == {(0, 1): 0.675, (0, 2): -0.125, (0, 3): 0.05, (1, 1): 0.3, (1, 3): 0.3}
    assert hybrid.fused(dense, lex, "k", k_merge=1).count() == 2
    chunks = spark.createDataFrame([(1, "a", 0), (2, "b", 0), (3, "a", 1)], "k int, item_id string, chunk_index int")
    up = hybrid.rolled_up(hybrid.fused(dense, lex, "k"), chunks, "k")
    assert {(r.query_idx, r.item_id, r.chunk_index) for r in up.collect()} == {(0, "a", 0), (1, "a", 0)}
    m = hybrid.merged(up, "k").first()
    assert (m.item_id, m.hybrid, m.matched, m.primary_query) == ("a", 0.675, [0, 1], 0)
    many = spark.createDataFrame([(f"i{k}", 1.0 - k / 100, [k % 2, 5], k % 2) for k in range(40)] + [("none", 9.0, [], None)], "item_id string, hybrid double, matched array<int>, primary_query int")
    kept = hybrid.capped(many, 8).collect()
    assert len(kept) == 16 and {r.item_id for r in kept} == {f"i{k}" for k in range(16)}


def mmr_brute(rel, vec, k, balance):
    if len(rel) <= k:
        return list(range(len(rel)))
    cos = lambda a, b: 0.0 if not a.any() or not b.any() else float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    out = [int(np.argmax(rel))]
    while len(out) < k:
        rest = [i for i in range(len(rel)) if i not in out]
        out.append(max(rest, key=lambda i: (round(balance * rel[i] - (1 - balance) * max(cos(vec[i], vec[j]) for j in out), 9), -i)))
    return out


def test_mmr(spark):
    rng = np.random.default_rng(1)
    for n, k in ((3, 5), (30, 5), (60, 30)):
        rel, vec = rng.random(n).round(3), rng.normal(size=(n, 6))
        vec[n // 2] = 0
        assert mmr_order(rel, vec, k, 0.3) == mmr_brute(rel, vec, k, 0.3)
    with pytest.raises(ValueError):
        mmr_order(np.ones(2), np.ones((3, 2)), 1, 0.3)
    rows = spark.createDataFrame([(f"i{k:02d}", float(100 - k), [1.0, float(k % 3)]) for k in range(20)] + [("zero", 0.5, None)], "item_id string, hybrid double, embedding array<double>")
    got = mmr_select(rows, 7).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 8)) and got[0].item_id == "i00" and len({r.item_id for r in got}) == 7
    assert mmr_select(rows.where("1 = 0"), 7).count() == 0


@pytest.mark.parametrize("pool", [1, 4, 50, 5000])
def test_mmr_in_rounds(spark, pool):
    """Whatever the pool, the order of the sequential rule, with ties in scores and vectors, near copies, null vectors and null scores."""
    rng = np.random.default_rng(pool)
    rel, vec = rng.integers(0, 12, 300) / 8, rng.normal(size=(40, 5))[rng.integers(0, 40, 300)]
    vec[::17] = 0
    rel[5] = -1e200
    rows = [(f"i{k:03d}", None if k == 5 else float(r), None if not v.any() else v.tolist()) for k, (r, v) in enumerate(zip(rel, vec, strict=True))]
    table = spark.createDataFrame(rows, "item_id string, hybrid double, embedding array<double>").repartition(7)
    by = sorted(range(300), key=lambda i: (-rel[i], i))
    want = [f"i{by[i]:03d}" for i in mmr_order(rel[by], vec[by], 12, 0.3)]
    assert [r.item_id for r in mmr_select(table, 12, pool=pool).orderBy("rank").collect()] == want


GATE = "i int, allowed boolean, paywall_detected boolean, status_code int, html_size int, clean_text string, language_detected string, abstract string"


def test_failure_precedence(spark):
    long, short = "x" * 1000, "y" * 999
    rows = [
        (0, True, False, 200, 9, long, "en", ""), (1, False, True, 404, 0, None, "de", ""), (2, True, True, 404, 0, None, "de", ""), (3, True, False, 404, 0, None, "de", ""), (4, True, False, 408, 0, None, "en", ""),
        (5, True, False, 503, 0, None, "en", ""), (6, True, False, 0, 0, None, "en", ""), (7, True, False, 200, 0, None, "en", ""), (8, True, False, 200, 9, None, "en", ""), (9, True, False, 200, 9, short, "de", "z" * 600),
        (10, True, False, 200, 9, short, "en", "z" * 500), (11, True, False, 200, 9, short, "en", "z" * 499), (12, True, False, 200, 9, short, "en", None),
    ]
    out = enrich.failure_reason(spark.createDataFrame(rows, GATE))
    got = {r.i: r.failure_reason for r in out.collect()}
    assert got == {0: None, 1: "robots_disallow", 2: "paywall", 3: "http_4xx", 4: "http_4xx", 5: "http_5xx", 6: "timeout", 7: "empty_response", 8: "empty_extract", 9: "lang_mismatch", 10: "too_short", 11: None, 12: None}
    assert {r.i for r in enrich.survivors(out).collect()} == {0, 11, 12}
    assert enrich.failure_reason(spark.createDataFrame(rows[9:10], GATE), languages=[]).first().failure_reason == "too_short"
    stats = enrich.enrichment_statistics(out.withColumn("skipped", F.col("i") == 1)).first()
    assert (stats.attempted, stats.succeeded, stats.failed, stats.skipped, stats.dropped) == (12, 3, 9, 1, 9) and stats.failed_by_reason["http_4xx"] == 2


def test_paywalls(spark):
    rows = spark.createDataFrame([(m.upper(), 200) for m in enrich.PAYWALL_MARKS] + [("pianoXio meter-md", 200), ("paywall", 404), (None, 200)], "h string, s int")
    assert [r[0] for r in rows.select(enrich.has_paywall(F.col("h"), F.col("s"))).collect()] == [True] * 13 + [False] * 3


def test_robots(spark):
    robots = spark.createDataFrame([("a.com", 200, "User-agent: *\nDisallow: /no"), ("b.com", 404, "User-agent: *\nDisallow: /"), ("c.com", None, None)], "domain string, status int, body string")
    items = spark.createDataFrame([("http://a.com/no/1",), ("http://a.com/yes",), ("http://b.com/x",), ("http://c.com/x",), ("http://d.com/x",), (None,)], "url string")
    got = {r.url: r.allowed for r in enrich.with_robots(items, robots, "bot").collect()}
    assert got == {"http://a.com/no/1": False, "http://a.com/yes": True, "http://b.com/x": True, "http://c.com/x": True, "http://d.com/x": True, None: True}
    assert tuple(enrich.robots_statistics(robots).first()) == (1, 2)


def line(**x):
    return {"line_id": 1, "segment_id": "s", "speaker": "A", "item_id": "i", "text": "hi", "refs": [0], "pause_ms_after": 1} | x


def test_parse_and_validate_lines(spark):
    good = [line(), line(refs=[], item_id=""), line(refs=[], item_id="null"), line(text="w " * 100)]
    bad = [line(speaker="C"), line(text="w " * 101), line(refs=[]), line(refs=[3]), line(refs=[-1]), {k: v for k, v in line().items() if k != "refs"}, line(refs=["x"])]
    text = "```jsonl\n" + "\n".join(map(json.dumps, good + bad)) + "\n\nnot json\n[1, 2]\n{broken\n```"
    parsed = script.parsed_lines(spark.createDataFrame([("r", text)], "k string, response string"))
    assert parsed.count() == len(good + bad)
    lines = parsed.select("pos", "line.*").withColumn("n_bullets", F.lit(3))
    errors = [r.error for r in lines.withColumn("error", script.line_error(["A", "B"])).orderBy("pos").collect()]
    assert errors == [None] * 4 + ["speaker", "too long", "no refs", "refs out of range", "refs out of range", "missing refs", errors[-1]] and errors[-1]
    assert script.valid_lines(lines, ["A", "B"]).count() == 4
    numbered = script.numbered(lines.drop("line_id"), "pos")
    kept = script.valid_lines(numbered.where("pos != 1"), ["A", "B"])
    assert sorted(r.line_id for r in kept.collect()) == [1, 3, 4]
    d = script.with_defaults(spark.createDataFrame([("", None, "The Title", "a b"), ("x", 2.0, "T", "")], "segment_id string, secs_estimate double, title string, text string")).collect()
    assert [(r.segment_id, r.secs_estimate) for r in d] == [("SEG_the-title", 0.8), ("x", 2.0)]


@pytest.mark.parametrize(("answer", "want"), [
    ('[2, "0", 2, 9, "c", "zz"]', "cabd"), ("```json\n[3,1]\n```", "dbac"), ("no json", "abcd"), ('["d", 0, true]', "dabc"), (None, "abcd"), ("[99999999999999999999999, 1]", "bacd"),
])
def test_applied_order(spark, answer, want):
    items = spark.createDataFrame([(k, c) for k, c in enumerate("abcd")], "ord int, item_id string")
    got = script.applied_order(items, spark.createDataFrame([(answer,)], "response string")).orderBy("position").collect()
    assert "".join(r.item_id for r in got) == want and [r.position for r in got] == [1, 2, 3, 4]


def test_polish_framing_balance_duration(spark):
    make = lambda rows: spark.createDataFrame(rows, "line_id int, segment_id string, speaker string, text string, refs array<int>, pause_ms_after int, secs_estimate double, ssml string, item_id string")
    old = make([(1, "s", "A", "one", [0, 1], 100, 1.0, None, "i"), (2, "s", "B", "two", [2], None, None, None, "i"), (3, "t", "A", "three", [0], 0, 1.0, None, "i"), (4, "u", "A", "four", None, 0, 0.0, None, "i")])
    new = make([(1, "s", "A", "merged", [2, 1, 0, 7], 0, 1.0, None, "i"), (3, "t", "A", "lost", [], 0, 1.0, None, "i"), (4, "u", "A", "w " * 101, [], 0, 0.0, None, "i")])
    out = script.polished_segments(old, new)
    assert sorted(r.text for r in out.collect()) == ["four", "merged", "three"]
    framed = script.framed(script.stamped(new.limit(1), "SEG_0", "intro"), old, script.stamped(new.limit(1), "SEG_END", "outro")).orderBy("line_id").collect()
    assert [r.line_id for r in framed] == [1, 2, 3, 4, 5, 6] and framed[0].segment_id == "SEG_0" and framed[-1].item_id == "outro"
    total = script.total_duration(old).first()
    assert total.total_secs == pytest.approx(2.1) and total.n_lines == 4
    assert not script.is_balanced(old).first()[0] and script.is_balanced(old.where("speaker = 'A'")).first()[0] and script.is_balanced(old.where("line_id < 3")).first()[0]
    assert [r.ssml for r in script.with_ssml(old).orderBy("line_id").collect()][:2] == ["<speak>one<break time='100ms'/></speak>", "<speak>two</speak>"]
    assert script.with_bullets(spark.createDataFrame([("• a",), ("none",)], "headlines string")).count() == 1
    assert [r[0] for r in spark.range(3).select(script.first_speaker(F.col("id"), ["A", "B"])).collect()] == ["A", "B", "A"]
    assert tuple(script.processed_counts(spark.createDataFrame([("x",), (" ",), (None,)], "full_text string")).first()) == (1, 2)
