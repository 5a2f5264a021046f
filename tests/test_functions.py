from datetime import UTC, datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docmill.config import EnrichConfig, RetrieveConfig, ScriptConfig
from docmill.functions import text as tx
from docmill.functions import urls
from docmill.functions.html import EXTRACTORS, decoded, extract_chain, html_text, register_extractor, text_of, variants_of
from docmill.functions.language import detect
from docmill.models import HashedEmbedder, TableFetcher, with_retries
from docmill.sources.fetch import fetch_one, fetched, get_simple


def over(spark, values, *make, kind="string"):
    """What expressions of column x give for each value, in order."""
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
    return [tuple(r)[1:] if len(make) > 1 else r[1] for r in rows.select("i", *(m(F.col("x")) for m in make)).orderBy("i").collect()]


ODD = ["  a b\tc\n\nd e\x1cf\u0085g ", "", None, "One  TWO", "\x1f x \x0b"]


def test_split_and_strip_are_pythons(spark):
    got = over(spark, ODD, tx.tokens, lambda c: tx.tokens(c, lower=True), lambda c: tx.strip(tx.filled(c)), tx.word_count)
    assert got == [((x or "").split(), (x or "").lower().split(), (x or "").strip(), len((x or "").split())) for x in ODD]


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=" a \n\t\x1c éB.", max_size=12), min_size=1, max_size=8))
def test_split_property(spark, texts):
    assert over(spark, texts, tx.tokens) == [x.split() for x in texts]


def test_ids_snippets_and_durations(spark):
    title = "Level 4: Autonomous — NVIDIA!!"
    assert over(spark, [title, None, "--"], tx.segment_id) == ["SEG_level-4-autonomous-nvidia", "SEG_", "SEG_"]
    assert over(spark, ["a " * 50, ""], tx.snippet) == [" ".join(["a"] * 40) + "...", "..."]
    assert over(spark, ["w " * 10], tx.duration) == [4.0]
    assert over(spark, ["x" * 200, None], tx.preview) == ["x" * 150 + "...", "..."]


def test_bullets_and_previews(spark):
    assert over(spark, ["• a\n  •  b \nno\n\n•", "none", None], tx.bullets) == [["a", "b", ""], [], []]
    rows = spark.createDataFrame([(["t" * 90, "", "c", None, "e", "f"],)], "x array<string>")
    assert rows.select(tx.titles_preview(F.col("x"))).first()[0] == f"- {'t' * 80}\n- c\n- e"


def test_ssml_and_speakable(spark):
    rows = spark.createDataFrame([("a<b", 120), ("c", 0), ("d", None)], "t string, p int")
    assert [r[0] for r in rows.select(tx.ssml(F.col("t"), F.col("p"))).collect()] == ["<speak>a<b<break time='120ms'/></speak>", "<speak>c</speak>", "<speak>d</speak>"]
    assert tx.spoken_spellings("nova") == ["NOVA", "Nova", "NoVa"]
    assert over(spark, ["NOVA Nova NoVa nova NOVAs nOVA"], lambda c: tx.speakable(c, tx.spoken_spellings("nova"), "nova")) == ["nova nova nova nova NOVAs nOVA"]


def test_fences_and_queries(spark):
    assert over(spark, ['```json\n[1]\n```', "```\nx\n```", " plain ", None, "```jsonl\n{}"], tx.unfenced) == ["[1]", "x", "plain", "", "{}"]
    rows = spark.createDataFrame([("q", ["a", "b c"]), ("r", [])], "q string, e array<string>")
    assert [r[0] for r in rows.select(tx.expanded_query(F.col("q"), F.col("e"))).collect()] == ["q; a; b c", "r"]


def test_retrieval_text_edges(spark):
    rows = spark.createDataFrame([(1, "full", True, 51, "c", "t"), (2, "full", True, 50, "c", "t"), (3, None, True, 99, "", "t"), (4, "full", None, 99, None, None), (5, "", True, 60, "c", "t")], "i int, f string, h boolean, w int, c string, t string")
    got = rows.select("i", tx.retrieval_text(*(F.col(x) for x in "fhwct"))).orderBy("i").collect()
    assert [r[1] for r in got] == ["full", "c", "t", "", "c"]


def test_urls(spark):
    given_urls = ["https://user@News.Example.co.uk:8080/a?b#c", "http://a.b.example.com", "nothing", None, "http://10.0.0.1/x"]
    assert over(spark, given_urls, urls.netloc) == ["user@News.Example.co.uk:8080", "a.b.example.com", "", "", "10.0.0.1"]
    assert over(spark, given_urls, urls.registered_domain) == ["example.co.uk", "example.com", "unknown", "unknown", "10.0.0.1"]


def test_dates(spark):
    at = lambda *x: datetime(*x)
    texts = ["Tue, 02 Jan 2024 03:04:05 GMT", "2 Jan 2024 03:04:05 +0200", "2024-01-02T03:04:05Z", "2024-01-02 03:04:05", "rubbish", None, "Tue, 02 Jan 2024 03:04:05 -0500"]
    assert over(spark, texts, urls.parsed_time) == [at(2024, 1, 2, 3, 4, 5), at(2024, 1, 2, 1, 4, 5), at(2024, 1, 2, 3, 4, 5), at(2024, 1, 2, 3, 4, 5), None, None, at(2024, 1, 2, 8, 4, 5)]
    as_of = F.lit("2024-01-31 00:00:00").cast("timestamp")
    rows = spark.createDataFrame([("x", "2024-01-28T00:00:00Z", None), ("x", "y", "z")], "a string, b string, c string")
    got = rows.select(urls.published(F.col("a"), F.col("b"), F.col("c"), as_of).alias("p")).select("p", urls.is_recent(F.col("p"), as_of)).collect()
    assert [tuple(r) for r in got] == [(at(2024, 1, 28), True), (at(2024, 1, 31), True)]


PAGE = """<html><head><title>T</title><link rel="amphtml" href="/amp/x"><script>var a="</p><article>no";</script><style>p{}</style></head>
<body><p>before<article><h1> Head </h1><p>one <b>two<p>three &amp; four<br>five</article><p>after</body>"""


def test_html_to_text(spark):
    assert text_of(PAGE) == "Head\none\ntwo\nthree & four\nfive"
    assert text_of("<p>a<noscript>b</noscript> c </p>\n<p>d") == "a\nc\nd"
    assert text_of(None) == "" and text_of("") == ""
    assert over(spark, [PAGE, None, "plain"], html_text) == [text_of(PAGE), "", "plain"]
    assert variants_of(PAGE, "https://e.com/a/b") == ["https://e.com/amp/x", "https://e.com/a/b/print"]
    assert variants_of("", "https://e.com/a/") == ["https://e.com/a/print"] and variants_of("", "https://e.com/?print=1") == []
    assert decoded(b"a\xffb") == "ab"


def test_extraction_chain(spark):
    def raises(html):
        raise ValueError(html)

    register_extractor("broken", raises)
    register_extractor("short", lambda html: "two words")
    long = "<article>" + "w " * 200 + "</article>"
    rows = spark.createDataFrame([(1, long), (2, "<p>" + "v " * 199 + "</p>"), (3, None), (4, "<p>" + "v " * 201 + "</p>")], "i int, h string")
    got = rows.select("i", extract_chain(F.col("h"), ("broken", "unknown", "short", "article", "page")).alias("x")).orderBy("i").collect()
    assert [None if r.x is None else (r.x.word_count, r.x.extraction_method) for r in got] == [(200, "article"), None, None, (201, "page")]
    cut = rows.select("i", extract_chain(F.col("h"), least_words=10, most_chars=30).alias("x")).where("i = 1").first().x
    assert len(cut.clean_text) == 30 and cut.word_count == 15
    del EXTRACTORS["broken"], EXTRACTORS["short"]


def test_language(spark):
    assert over(spark, ["The cat is on the mat", "Der Hund und die Katze sind nicht im Haus", "xyzzy", None, "le chat est dans la maison pour une nuit"], detect) == ["en", "de", "unknown", "unknown", "fr"]


def test_config_from_environment():
    c = EnrichConfig.load({"ENRICHER_LANG_ALLOWLIST": "en,de", "ENRICHER_FORCE": "1", "ENRICHER_PER_DOMAIN_QPS": "2.5"})
    assert c.lang_allowlist == ("en", "de") and c.force and c.per_domain_qps == 2.5 and c.min_accept_words == 200
    assert RetrieveConfig.load({}).k_ann == 300 and ScriptConfig.load({"SCRIPT_SPEAKER_NAMES": "A,B"}).speaker_names == ("A", "B")
    assert EnrichConfig.load({"ENRICHER_LANG_ALLOWLIST": ""}).lang_allowlist == ("",)


def test_embedder():
    e = HashedEmbedder(16)
    v = e.embed(["a b a", "", "A B a"])
    assert v.shape == (3, 16) and (v[1] == 0).all() and (v[0] == v[2]).all() and abs((v[0] ** 2).sum() - 1) < 1e-12
    assert e.embed([]).shape == (0, 16)


class Flaky:
    """Fails so often, then answers."""

    def __init__(self, fails, error=None, status=503):
        self.fails, self.error, self.status, self.calls = fails, error, status, 0

    def get(self, url, timeout):
        self.calls += 1
        if self.calls <= self.fails:
            if self.error:
                raise self.error
            return self.status, url, b"e"
        return 200, url + "/final", b"ok"


def test_retries():
    waits = []
    assert fetch_one(Flaky(2), "u", sleep=waits.append) == (200, "u/final", b"ok") and waits == [1.0, 1.5]
    assert fetch_one(Flaky(9, TimeoutError()), "u", sleep=waits.append)[0] == 408
    assert fetch_one(slow := Flaky(9, TimeoutError()), "u", retries=3, sleep=waits.append)[0] == 408 and slow.calls == 4
    assert fetch_one(broken := Flaky(9, OSError()), "u", sleep=waits.append)[0] == 0 and broken.calls == 1
    assert fetch_one(Flaky(9, status=404), "u", sleep=waits.append)[0] == 404
    assert get_simple(Flaky(2, status=500), "u", sleep=waits.append) == b"ok" and get_simple(Flaky(1, status=404), "u", sleep=waits.append) is None
    assert with_retries(lambda: 3) == 3
    with pytest.raises(ValueError):
        with_retries(lambda: int("x"), sleep=lambda s: waits.append(s))
    assert waits[-2:] == pytest.approx([2.0, 2.0], abs=0.2)


def test_fetch_table(spark):
    pages = TableFetcher({"http://a.com/1": (200, b"Subscribe to read this"), "http://a.com/2": (200, b"fine"), "http://b.com/": (404, b"paywall")})
    given_urls = spark.createDataFrame([("http://a.com/1",), ("http://a.com/2",), ("http://a.com/2",), ("http://b.com/",), (None,)], "url string")
    got = {r.url: (r.status_code, r.paywall_detected) for r in fetched(given_urls, pages, qps=1000).collect()}
    assert got == {"http://a.com/1": (200, True), "http://a.com/2": (200, False), "http://b.com/": (404, False)}


def test_now_is_never_called():
    assert datetime.now(UTC)  # the engine itself takes times from its callers
    import pathlib

    for path in pathlib.Path(urls.__file__).parent.parent.rglob("*.py"):
        assert "current_timestamp" not in path.read_text() and "datetime.now" not in path.read_text(), path
