"""Sentence-aware overlapping chunks, cut batch by batch through Arrow in time linear in the text."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.runtime import bounded_batches, lean


def spans(text: str, chunk_size: int = 400, overlap: float = 0.15) -> list[tuple[int, int]]:
    """(start, end) of each window, offsets from 0, of a text longer than one window.

    A window of 4 x ``chunk_size`` characters that doesn't reach the end is cut after its last ``". "`` or newline if that lies past
    70 % of it. The next begins ``overlap`` before the (unclamped) end, so a text that ends within the overlap gets one more short chunk.
    """
    size = 4 * chunk_size
    back, least, out, at = int(size * overlap), size * 0.7, [], 0
    while at < len(text):
        end = at + size
        if end < len(text):
            cut = max(text.rfind(". ", at, end), text.rfind("\n", at, end)) - at
            if cut > least:
                end = at + cut + 1
        out.append((at, end))
        at = end - back
    return out


def placed_chunks(text: Column, chunk_size: int = 400, overlap: float = 0.15) -> Column:
    """The chunks (text, end) of a text: itself, not stripped, if it fits one window; else the stripped pieces. ``end`` adds up their lengths. Null for null.

    Spark's own ``substring`` counts characters from the beginning of a text each time, so a fold over it is quadratic; texts of one window, most of them, don't
    leave the JVM.
    """

    def pieces(t: str | None) -> list[dict] | None:
        if t is None:
            return None
        texts = [t[a:b].strip() for a, b in spans(t, chunk_size, overlap)]
        return [{"text": x, "end": n} for x, n in zip(texts, itertools.accumulate(map(len, texts)), strict=True)]

    @F.pandas_udf("array<struct<text: string, end: int>>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return lean(lambda some: (texts.map(pieces) for texts in some))(batches)

    long_one = F.length(text) > 4 * chunk_size
    return F.when(long_one, cut(F.when(long_one, text))).otherwise(F.when(text.isNotNull(), F.array(F.struct(text.alias("text"), F.length(text).alias("end")))))


def chunks_of(text: Column, chunk_size: int = 400, overlap: float = 0.15) -> Column:
    """The texts of :func:`placed_chunks`."""
    return F.transform(placed_chunks(text, chunk_size, overlap), lambda c: c["text"])


def chunked(articles: DataFrame, text: str = "text", chunk_size: int = 400, overlap: float = 0.15) -> DataFrame:
    """A row for each chunk of every row with a text: chunk_index, chunk_count, text, and offsets that add up the chunks' lengths."""
    bounded_batches(articles.sparkSession)
    rest = [c for c in articles.columns if c != text]
    out = articles.where(F.coalesce(F.col(text), F.lit("")) != "").withColumn("__chunks", placed_chunks(F.col(text), chunk_size, overlap))
    out = out.select(*rest, F.size("__chunks").alias("chunk_count"), F.posexplode("__chunks").alias("chunk_index", "__chunk"))
    end = F.col("__chunk")["end"]
    return out.select(*rest, "chunk_index", "chunk_count", F.col("__chunk")["text"].alias("text"), (end - F.length(F.col("__chunk")["text"])).alias("char_start"), end.alias("char_end"))
