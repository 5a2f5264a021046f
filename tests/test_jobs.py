import json
import os
import subprocess
import sys
import uuid

import pytest
from pyspark.sql import functions as F

from jobs import enrich, intake

DATA = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}"


def stored(spark, folder):
    return spark.read.schema(intake.ITEMS).parquet(f"{folder}/out/items")


def take(spark, folder, **settings):
    return intake.run(spark, f"{folder}/in", f"{folder}/out", f"{folder}/checkpoint", **settings)


def add(rows, folder):
    rows.coalesce(1).write.mode("append").parquet(f"{folder}/in")


def expected(rows):
    """The smallest id of each text, over texts with a word."""
    best = {}
    for i, text, _ in rows:
        if text and text.split():
            best[text] = min(best.get(text, (True, 0)), (i is None, i or 0))
    return {t: None if none else i for t, (none, i) in best.items()}


def test_two_runs_over_growing_input(spark, folder):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "source")
    copies = docs.where("doc_id < 20").withColumn("doc_id", F.col("doc_id") + 100_000)
    add(docs.where("doc_id % 2 = 0"), folder)
    first = take(spark, folder)
    before = {r.item_id: (r.doc_id, r.batch) for r in stored(spark, folder).collect()}
    add(docs.where("doc_id % 2 = 1").union(copies), folder)
    second = take(spark, folder)
    after = {r.item_id: (r.doc_id, r.batch) for r in stored(spark, folder).collect()}
    assert before.items() <= after.items() and first["batches"] == second["batches"] == 1
    assert first["n_read"] + second["n_read"] == docs.count() + copies.count()
    assert len(after) == docs.select("text").distinct().where("trim(text) <> ''").count() == first["n_stored"] + second["n_stored"]
    assert take(spark, folder) == {"batches": 0, "n_read": 0, "n_unfit": 0, "n_stored": 0, "n_repeated": 0}
    assert {r.item_id: (r.doc_id, r.batch) for r in stored(spark, folder).collect()} == after


def test_edge_rows_and_repeats_within_a_batch(spark, folder):
    rows = [(5, "one two\nthree", "a"), (3, "one two\nthree", None), (None, "one two\nthree", "a"), (1, None, "a"), (2, "", "b"), (4, " \n\t", "b"), (None, "no id", None), (7, "word " * 100_000, "long"), (7, "word " * 100_000, "long")]
    add(spark.createDataFrame(rows, intake.SOURCE), folder)
    counts = take(spark, folder)
    got = {r.text: r.doc_id for r in stored(spark, folder).collect()}
    assert got == expected(rows) and counts == {"batches": 1, "n_read": 9, "n_unfit": 3, "n_stored": 3, "n_repeated": 3}
    kept = stored(spark, folder).where("doc_id = 3").first()
    assert (kept.source, kept.title, kept.segment_id, kept.n_words) == (None, "one two", "SEG_one-two", 3)


def test_a_batch_that_fails_is_taken_again(spark, folder, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "source")
    for k in range(3):
        add(docs.where(f"doc_id % 3 = {k}"), folder)
    ledger = intake.LEDGER
    take_one = {"files_per_batch": 1}
    # the ledger of the first batch can't be written: its items are there, its batch is not done
    monkeypatch.setattr(intake, "LEDGER", "wrong int")
    with pytest.raises(Exception, match="STREAM_FAILED"):
        take(spark, folder, **take_one)
    assert stored(spark, folder).count() > 0
    monkeypatch.setattr(intake, "LEDGER", ledger)
    counts = take(spark, folder, **take_one)
    assert counts["batches"] == 3 and counts["n_read"] == docs.count()
    items = stored(spark, folder)
    assert items.count() == items.select("item_id").distinct().count() == docs.where("trim(text) <> ''").select("text").distinct().count()
    written = spark.read.schema(intake.LEDGER).parquet(f"{folder}/out/ledger").agg(F.sum("n_stored"), F.count("batch")).first()
    assert tuple(written) == (items.count(), 3)


def test_settings_restrict(spark, folder):
    add(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "source"), folder)
    take(spark, folder, least_words=100, languages=["de"])
    assert {(r.language, r.n_words >= 100) for r in stored(spark, folder).select("language", "n_words").collect()} == {("de", True)}


def test_enrich_outcomes_and_rerun(spark, folder):
    body = "<article>" + "".join(f"<p>The cat and the dog of line {i} is in that house.</p>" for i in range(60)) + "</article>"
    pages = [(1, "http://a.b.co.uk/x", body), (2, "http://c.com/", None), (3, "http://c.com/w", body + "<i class='regwall'>"), (4, "http://c.com/s", "<p>the end</p>"), (5, None, body), (5, None, body), (6, "http://c.com/z", "<p>" + "zzz " * 40 + "</p>"), (7, "http://c.com/t", "<p>" + "the cat " * 30 + "</p>")]
    spark.createDataFrame(pages, enrich.PAGES).write.parquet(f"{folder}/pages")
    settings = {"languages": ["en"], "least_words": 20, "least_chars": 1000}

    def rows():
        return sorted((r.page_id, r.outcome, r.domain, r.n_words) for r in spark.read.schema(f"{enrich.ENRICHED}, day string").parquet(f"{folder}/out").where("day = '2024-01-02'").collect())

    counts = enrich.run(spark, f"{folder}/pages", f"{folder}/out", "2024-01-02", **settings)
    first = rows()
    assert {i: o for i, o, _, _ in first} == {1: "kept", 2: "empty_response", 3: "paywall", 4: "empty_extract", 5: "kept", 6: "lang_mismatch", 7: "too_short"}
    assert counts["kept"] == 3 and first[0][2:] == ("b.co.uk", 720)
    enrich.run(spark, f"{folder}/pages", f"{folder}/out", "2024-01-03", **settings)
    assert enrich.run(spark, f"{folder}/pages", f"{folder}/out", "2024-01-02", **settings) == counts and rows() == first
    with pytest.raises(ValueError, match="YYYY"):
        enrich.run(spark, f"{folder}/pages", f"{folder}/out", "yesterday")


def test_command_lines(spark, tmp_path):
    config = tmp_path / "settings.json"
    config.write_text(json.dumps({"files_per_batch": 5, "least_words": 3, "languages": []}))
    env = os.environ | {"PYTHONPATH": ROOT}
    target = f"file://{tmp_path}/{uuid.uuid4().hex}"
    for argv in (["jobs.intake", f"file://{DATA}/documents.parquet*", target, f"{target}-checkpoint", "--config", str(config)], ["jobs.enrich", f"file://{DATA}/pages.parquet", f"{target}-pages", "2024-01-31"]):
        done = subprocess.run([sys.executable, "-m", *argv], cwd=ROOT, env=env, capture_output=True, text=True, timeout=300)
        assert done.returncode == 0, done.stderr[-2000:]
        assert "read" in done.stderr
    assert spark.read.schema(intake.ITEMS).parquet(f"{target}/items").count() > 100
    assert spark.read.schema(enrich.ENRICHED).parquet(f"{target}-pages/day=2024-01-31").count() == spark.read.parquet(f"{DATA}/pages.parquet").count()
