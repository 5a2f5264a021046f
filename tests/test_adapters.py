"""What stands between the engine and other libraries or the network."""

import http.server
import sys
import threading
import time
import types

import numpy as np
import pytest
from pyspark.sql import functions as F

from docmill import schemas
from docmill.config import EnrichConfig, PolishConfig, RetrieveConfig, ScriptConfig
from docmill.functions import html
from docmill.models import HashedEmbedder, HttpFetcher, LibraryEmbedder, ScriptedModel, TableFetcher, named_embedder
from docmill.operators import bm25
from docmill.operators.chunk import chunked, spans
from docmill.plans import script
from docmill.plans.enrich import variant_urls
from docmill.sources.fetch import fetched, fetched_by
from tests.test_operators import bm25_brute


@pytest.fixture
def server():
    class Pages(http.server.BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            if self.path == "/moved":
                self.send_response(302)
                self.send_header("Location", "/there")
            else:
                self.send_response(200 if self.path == "/there" else 404)
            self.end_headers()
            self.wfile.write((self.path + " " + self.headers["User-Agent"]).encode())

        def log_message(self, *args):
            pass

    running = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=running.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{running.server_address[1]}"
    running.shutdown()


def test_http_client(server):
    follow, stay = HttpFetcher("me"), HttpFetcher("me", follow_redirects=False)
    assert follow.get(server + "/moved", 5) == (200, server + "/there", b"/there me")
    assert stay.get(server + "/moved", 5)[:2] == (302, server + "/moved")
    assert follow.get(server + "/gone", 5)[0] == 404
    with pytest.raises(OSError):
        follow.get("http://127.0.0.1:1/", 5)


def test_fetching_as_the_settings_say(spark, server):
    urls = spark.createDataFrame([(server + x,) for x in ("/moved", "/there", "/gone")], "url string")
    for follow in (True, False):
        got = {r.url[len(server) :]: r.status_code for r in fetched_by(urls, EnrichConfig(per_domain_qps=0, follow_redirects=follow, http_max_retries=1)).collect()}
        assert got == {"/moved": 200 if follow else 302, "/there": 200, "/gone": 404}


def test_lanes_share_the_rate_of_a_host(spark):
    urls = spark.createDataFrame([(f"http://a.com/{k}",) for k in range(12)], "url string")
    waits = []
    client = TableFetcher({})
    rows = fetched(urls, client, qps=200.0, retries=0, lanes=3).collect()
    began = time.monotonic()
    rows2 = fetched(urls, client, qps=200.0, retries=0, lanes=1).collect()
    assert len(rows) == len(rows2) == 12 and time.monotonic() - began >= 11 / 200 and not waits


def test_variants_only_if_allowed(spark):
    page = b'<html><link rel="amphtml" href="/amp"><article>x</article></html>'
    rows = spark.createDataFrame([("http://a.com/x", 200, "http://a.com/x", bytearray(page), False)], schemas.FETCHES)
    assert [r.variant for r in variant_urls(rows).collect()] == ["http://a.com/amp", "http://a.com/x/print"]
    assert variant_urls(rows, EnrichConfig(allow_amp_print_variants=False)).count() == 0


def test_extractors_of_other_libraries(monkeypatch):
    class Article:
        def __init__(self, url):
            self.text = ""

        def set_html(self, page):
            self.page = page

        def parse(self):
            self.text = "newspaper of " + self.page

    class Document:
        def __init__(self, page):
            self.page = page

        def summary(self):
            return f"<div><p>readability</p> <b>of {self.page}</b></div>"

    class Goose:
        def extract(self, raw_html):
            return types.SimpleNamespace(cleaned_text="goose of " + raw_html)

    fakes = {"trafilatura": {"extract": lambda page: "trafilatura of " + page}, "readability": {"Document": Document}, "newspaper": {"Article": Article}, "goose3": {"Goose": Goose}}
    for name in ("trafilatura", "readability", "newspaper3k", "goose3"):
        html._module.cache_clear()
        assert not html.EXTRACTORS[name]("page")
    for name, parts in fakes.items():
        module = types.ModuleType(name)
        module.__dict__.update(parts)
        module.__spec__ = types.SimpleNamespace(name=name)
        monkeypatch.setitem(sys.modules, name, module)
    html._module.cache_clear()
    assert [html.EXTRACTORS[n]("page") for n in ("trafilatura", "readability", "newspaper3k", "goose3")] == ["trafilatura of page", "readability of page", "newspaper of page", "goose of page"]
    html._module.cache_clear()


def test_a_named_encoder_is_loaded_or_refused(monkeypatch):
    assert isinstance(named_embedder(RetrieveConfig().embedding_model), HashedEmbedder)
    with pytest.raises(ValueError, match="some/encoder"):
        named_embedder("some/encoder")

    class SentenceTransformer:
        def __init__(self, name):
            self.name = name

        def encode(self, texts, normalize_embeddings, show_progress_bar):
            return np.array([[len(t), len(self.name)] for t in texts], np.float32)

    module = types.ModuleType("sentence_transformers")
    module.SentenceTransformer = SentenceTransformer
    module.__spec__ = types.SimpleNamespace(name="sentence_transformers")
    monkeypatch.setitem(sys.modules, "sentence_transformers", module)
    model = named_embedder(RetrieveConfig.load({"RAG_EMBEDDING_MODEL": "some/encoder"}).embedding_model)
    assert isinstance(model, LibraryEmbedder) and model.embed(["abc", None]).tolist() == [[3, 12], [0, 12]] and model.embed([]).shape[0] == 0


def test_settings_reach_the_prompts(spark):
    asked = []

    def answer(system, prompt):
        asked.append(system)
        return ""

    config = ScriptConfig(allow_consecutive_speaker=False, target_total_secs=99, default_pause_ms=77)
    model = ScriptedModel(lambda system, prompt: '{"line_id":1,"segment_id":"s","speaker":"Adam","item_id":"null","refs":[],"pause_ms_after":1,"text":"%s"}' % system.replace('"', ""))
    items = spark.createDataFrame([(1, "i", "t", "• a fact")], "position int, item_id string, title string, headlines string")
    line = script.dialogue(items, model, config).first()
    assert "No speaker has two lines in a row." in line.text and "about 99 seconds" in line.text and "about 77" in line.text and "Spell acronyms" in line.text
    lines = script.dialogue(items, model, config)
    polished = script.polished(lines, model, ScriptConfig(), PolishConfig(allow_merge_lines=False, balance_tolerance_pct=5)).first()
    assert "within 5 points" in polished.text and "Don't merge lines." in polished.text and "Don't split" not in polished.text and not asked


def test_bm25_top_k_in_blocks(spark):
    docs = ["the cat; sat", "The the dog sat", "the bird", "a cat the cat cat", "the", "", None]
    queries = ["the cat cat", "cat; unknown", "DOG sat the", "nothing here"]
    d = spark.createDataFrame(list(enumerate(docs)), "i int, text string").repartition(3)
    q = spark.createDataFrame(list(enumerate(queries)), "query_idx int, query string")
    for block in (1, 3, 100):
        got = bm25.bm25_top_k(d, q, "i", 2, block=block).collect()
        for k, text in enumerate(queries):
            words = set(text.lower().split())
            want = [(-round(s, 6), i) for i, s in enumerate(bm25_brute([x or "" for x in docs], text)) if words & set((docs[i] or "").lower().split())]
            assert [(r.bm25, r.i) for r in sorted(got, key=lambda r: r["rank"]) if r.query_idx == k] == [(pytest.approx(-s, abs=2e-6), i) for s, i in sorted(want)[:2]]
    assert bm25.bm25_top_k(d.where("1 = 0"), q, "i", 2).count() == 0 and bm25.bm25_top_k(d, q.where("1 = 0"), "i", 2).count() == 0


def test_chunks_of_a_very_long_text(spark):
    text = "Abc def gh. " * 430_000
    began = time.time()
    found = spans(text)
    assert time.time() - began < 5 and found[0] == (0, 1595) and all(b[0] == a[1] - 240 for a, b in zip(found, found[1:], strict=False))
    out = chunked(spark.createDataFrame([(1, text, "x")], "i int, text string, chunk_index string").drop("chunk_index")).agg(F.count("*").alias("n"), F.max("char_end").alias("end"), F.sum(F.length("text")).alias("chars")).first()
    assert out.n == len(found) and out.end == out.chars


def test_hosts_are_dealt_to_tasks_of_their_own(spark):
    urls = spark.createDataFrame([(f"http://h{k % 50}.com/{k}",) for k in range(400)], "url string")
    rows = fetched(urls, TableFetcher({}), qps=0, retries=0, tasks=6).select("url", F.spark_partition_id().alias("task")).collect()
    tasks = {}
    for r in rows:
        tasks.setdefault(r.url.split("/")[2], set()).add(r.task)
    assert len(rows) == 400 and all(len(t) == 1 for t in tasks.values()) and len(set().union(*tasks.values())) == 6
