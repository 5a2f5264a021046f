"""The jobs as queries: each runs twice into one new folder and returns the whole output as it stands then."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.operators.enrich import PAYWALL_MARKS
from docmill.queries import ORACLE_SQL as OWN_SQL
from docmill.queries import language_sql
from docmill.runtime import shared_dir
from jobs import enrich, intake

DAY = "2024-01-31"


def settings(path: str) -> dict:
    with open(path) as f:
        return json.load(f)


def job1_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of ``documents``, each text once; the second run finds nothing new. A pattern takes a file as well as a folder of files."""
    folder = f"{shared_dir(spark)}/job1-{uuid.uuid4().hex}"
    for _ in range(2):
        intake.run(spark, f"{sf_dir}/documents.parquet*", f"{folder}/out", f"{folder}/checkpoint", **settings(intake.CONFIG))
    return spark.read.schema(intake.ITEMS).parquet(f"{folder}/out/items").select("item_id", "doc_id", "source", "language", "segment_id", "n_words", "secs", F.md5("title").alias("title_md5"))


def job2_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page of ``pages`` with its outcome; the second run replaces the day by the same rows."""
    folder = f"{shared_dir(spark)}/job2-{uuid.uuid4().hex}"
    for _ in range(2):
        enrich.run(spark, f"{sf_dir}/pages.parquet", folder, DAY, **settings(enrich.CONFIG))
    out = spark.read.schema(f"{enrich.ENRICHED}, day string").parquet(folder)
    return out.select("page_id", "item_id", "domain", "language", "n_words", F.md5("full_text").alias("text_md5"), "outcome", "day")


QUERIES = {"job1_intake": job1_intake, "job2_enrich": job2_enrich}

_WORDS = r"list_filter(string_split_regex({}, '\s+'), lambda x: x <> '')"
_E = settings(enrich.CONFIG)
_WALL = "(" + " OR ".join(f"contains(lower(html), '{m}')" for m in PAYWALL_MARKS) + ")"

ORACLE_SQL = {
    "job1_intake": rf"""
WITH a AS (SELECT *, md5(text) AS item_id, len({_WORDS.format("text")})::INT AS n_words, split_part(text, chr(10), 1) AS title FROM documents),
f AS (SELECT * FROM a WHERE n_words >= {settings(intake.CONFIG)["least_words"]} QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY doc_id) = 1),
g AS ({language_sql("f", "doc_id", "text")})
SELECT item_id, doc_id, source, guess AS language, 'SEG_' || trim(left(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), 40), '-') AS segment_id, n_words,
       round(n_words / 150.0::DOUBLE * 60.0::DOUBLE, 6) AS secs, md5(title) AS title_md5 FROM f JOIN g USING (doc_id)""",
    "job2_enrich": rf"""
WITH h AS ({OWN_SQL["html_clean"]}), u AS ({OWN_SQL["url_domain"]}), f AS (SELECT page_id, coalesce(length(html), 0) AS size, {_WALL} AS wall, CASE WHEN coalesce(length(html), 0) > 0 AND NOT {_WALL} THEN h.text END AS text FROM pages JOIN h USING (page_id)),
w AS (SELECT *, len({_WORDS.format("coalesce(text, '')")})::INT AS n_words FROM f), g AS ({language_sql("w", "page_id", "coalesce(text, '')")})
SELECT page_id, item_id, domain, guess AS language, n_words, md5(text) AS text_md5,
       CASE WHEN coalesce(wall, FALSE) THEN 'paywall' WHEN size = 0 THEN 'empty_response' WHEN n_words < {_E["least_words"]} OR text = '' THEN 'empty_extract' WHEN guess NOT IN ({", ".join(map(repr, _E["languages"]))}) THEN 'lang_mismatch'
            WHEN length(text) < {_E["least_chars"]} AND length(text) < 2 * length(split_part(text, chr(10), 1)) THEN 'too_short' ELSE 'kept' END AS outcome, '{DAY}' AS day
FROM w JOIN g USING (page_id) JOIN u USING (page_id)""",
}
