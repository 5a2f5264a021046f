"""From ranked articles to validated script lines. Models are injected; a failure of one falls back as each stage says."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill import schemas
from docmill.config import PolishConfig, ScriptConfig
from docmill.functions.text import filled, preview, speakable, spoken_spellings, strip, titles_preview
from docmill.models import TextModel, with_retries
from docmill.operators import script as ops
from docmill.sources.readers import exists


def _asked(rows: DataFrame, model: TextModel, system: str, prompt: Callable[[pd.Series], str], temperature: float, most_tokens: int, keep: str, column: str) -> DataFrame:
    """``rows`` with the model's answer to each row's prompt; null where it failed for good."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    spec = ", ".join(f"{c} {kinds[c]}" for c in keep.split(", "))

    def ask(batches):
        for pdf in batches:
            answers = []
            for _, row in pdf.iterrows():
                try:
                    answers.append(with_retries(lambda row=row: model.complete(system, prompt(row), temperature, most_tokens)))
                except Exception:  # noqa: BLE001  counted as skipped
                    answers.append(None)
            yield pdf[keep.split(", ")].assign(**{column: answers})

    return rows.mapInPandas(ask, f"{spec}, {column} string")


def headlined(articles: DataFrame, model: TextModel) -> tuple[DataFrame, DataFrame]:
    """(articles with ``headlines``, counts of processed and skipped): blank texts aren't asked about."""
    full = articles.where(strip(filled(F.col("full_text"))) != "").select("ord", "item_id", "title", "source", "url", "full_text")
    out = _asked(full, model, "Condense the article into verifiable facts, one bullet (•) a line.", lambda r: f"{r['title']}\n\n{r['full_text']}", 0.2, 128, "ord, item_id, title, source, url", "headlines")
    done = out.where("headlines is not null")
    counts = articles.agg(F.count(F.lit(1)).alias("total")).crossJoin(done.agg(F.count(F.lit(1)).alias("processed"))).select("processed", (F.col("total") - F.col("processed")).alias("skipped"))
    return done, counts


def sequenced(items: DataFrame, model: TextModel) -> DataFrame:
    """``items`` with ``position`` in the order that the model proposes for all of them at once; their own order if it fails."""
    rows = items.select("ord", "item_id", "title", preview(F.col("headlines")).alias("headlines_preview")).orderBy("ord").collect()
    listed = json.dumps([{"index": k, **{c: r[c] for c in ("item_id", "title", "headlines_preview")}} for k, r in enumerate(rows)], ensure_ascii=False)
    try:
        answer = with_retries(lambda: model.complete("Order the items so that related topics stand together. Answer with a JSON array of indices.", listed, 0.3, 16384))
    except Exception:  # noqa: BLE001
        answer = None
    spark = items.sparkSession
    index = spark.createDataFrame([(r["item_id"], k) for k, r in enumerate(rows)], "item_id string, __index int")
    return ops.applied_order(items.join(F.broadcast(index), "item_id"), spark.createDataFrame([(answer,)], "response string"), "__index").drop("__index")


def dialogue(items: DataFrame, model: TextModel, config: ScriptConfig = ScriptConfig()) -> DataFrame:
    """Valid lines of all items (with ``position``), numbered before validation."""
    ready = ops.with_bullets(items).withColumn("first", ops.first_speaker(F.col("position") - 1, config.speaker_names)).withColumn("n_bullets", F.size("bullets"))
    asked = ready.select("position", "title", "first", "n_bullets", F.col("item_id").alias("own_id"), F.to_json("bullets").alias("facts"))
    rule = f"Write at most {config.max_lines_per_item} lines of dialogue for {' and '.join(config.speaker_names)} as JSON lines, at most {config.max_words_per_line} words each, with refs to the facts and a pause_ms_after of about {config.default_pause_ms}. All items together take about {config.target_total_secs} seconds."
    rule += "".join(f" {text}" for off, text in ((config.allow_consecutive_speaker, "No speaker has two lines in a row."), (not config.digits_to_speech, "Write numbers as they are spoken."), (not config.spell_acronyms, "Spell acronyms out.")) if not off)
    answers = _asked(asked, model, rule, lambda r: f"{r['first']} begins.\n{r['own_id']}\n{r['title']}\n{r['facts']}", 0.4, 2048, "position, title, n_bullets", "response")
    parsed = ops.parsed_lines(answers).select("position", "title", "n_bullets", "pos", "line.*").drop("line_id")
    lines = ops.with_defaults(ops.numbered(parsed, "position", "pos"), "title", config.wpm_estimate)
    return ops.valid_lines(lines, config.speaker_names, config.max_words_per_line).select(*schemas.SCRIPT_LINES.names)


def polished(lines: DataFrame, model: TextModel, config: ScriptConfig = ScriptConfig(), polish: PolishConfig = PolishConfig()) -> DataFrame:
    """Lines polished segment by segment; a segment whose answer fails or isn't valid stays as it was."""
    whole = lines.groupBy("segment_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_id", F.to_json(F.struct(*lines.columns)).alias("j")))), lambda x: x.j), "\n").alias("jsonl"))
    wishes = (
        (polish.enable_micro_transitions, "Add short transitions."), (polish.lock_segment_boundaries, "Keep segments as they are."), (not polish.allow_merge_lines, "Don't merge lines."),
        (not polish.allow_split_lines, "Don't split lines."), (polish.enforce_balance, f"Keep each speaker's share within {polish.balance_tolerance_pct:g} points of an equal one."),
    )
    rule = f"Polish the lines; pace {polish.pace}, tone {polish.tone}. Keep all refs. Answer in JSON lines." + "".join(f" {text}" for on, text in wishes if on)
    answers = _asked(whole.withColumnRenamed("segment_id", "own_segment"), model, rule, lambda r: r["jsonl"], 0.4, 4096, "own_segment", "response")
    new = ops.parsed_lines(answers).select("own_segment", "line.*")
    new = new.withColumn("segment_id", F.coalesce("segment_id", "own_segment")).where(F.col("segment_id") == F.col("own_segment")).select(*lines.columns)
    if polish.enable_ssml:
        new = ops.with_ssml(new)
    return ops.polished_segments(lines, new, config.max_words_per_line)


def framed_script(spark: SparkSession, items: DataFrame, body: DataFrame, model: TextModel, config: ScriptConfig = ScriptConfig()) -> DataFrame:
    """Intro, body and outro, numbered anew; a part whose answer fails is left out."""
    titles = items.orderBy("position").limit(5).agg(F.array_sort(F.collect_list(F.struct("position", "title"))).alias("t"))
    topics = titles.select(titles_preview(F.transform("t", lambda x: x.title))).first()[0]

    def part(system: str, segment: str, item: str) -> DataFrame:
        try:
            answer = model.complete(system, topics, 0.6, 2048)
        except Exception:  # noqa: BLE001
            answer = ""
        rows = ops.parsed_lines(spark.createDataFrame([(answer,)], "response string")).select("line.*")
        return ops.stamped(rows, segment, item, config.wpm_estimate)

    intro = part("Write 4-6 lines of introduction in JSON lines.", f"{config.segment_prefix}0", "intro")
    outro = part("Write 3-4 lines of farewell in JSON lines.", f"{config.segment_prefix}END", "outro")
    out = ops.framed(intro.select(*schemas.SCRIPT_LINES.names), body, outro.select(*schemas.SCRIPT_LINES.names))
    if config.show_name:
        out = out.withColumn("text", speakable(F.col("text"), spoken_spellings(config.show_name), config.show_name.lower()))
    return out


def unless_there(spark: SparkSession, path: str, make: Callable[[], None]) -> bool:
    """Runs ``make``, which writes ``path``, unless that exists; whether it ran."""
    if exists(spark, path):
        return False
    make()
    return True
