"""The logical tables."""

from __future__ import annotations

from pyspark.sql import types as T

_PLAIN = {"string": T.StringType, "int": T.IntegerType, "double": T.DoubleType, "boolean": T.BooleanType, "timestamp": T.TimestampType, "binary": T.BinaryType}


def _parts(text: str) -> list[str]:
    """``text`` cut at commas outside angle brackets."""
    out, depth = [""], 0
    for c in text:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out if x.strip()]


def _kind(text: str) -> T.DataType:
    if text.startswith("array<"):
        return T.ArrayType(_kind(text[6:-1]))
    if text.startswith("struct<"):
        return _fields(text[7:-1], ":")
    return _PLAIN[text]()


def _fields(text: str, between: str) -> T.StructType:
    return T.StructType([T.StructField(name.strip(), _kind(kind.strip())) for name, _, kind in (x.partition(between) for x in _parts(text))])


def _ROW(text: str) -> T.StructType:
    """A schema from ``name type, ...``, without a session."""
    return _fields(text, " ")


FEEDS = _ROW("url string, label string, topics array<string>")
FEED_FILE = _ROW("defaults struct<user_agent: string>, feeds array<struct<url: string, label: string, topics: array<string>>>")
ENTRIES = _ROW("link string, id string, title string, summary string, description string, published string, updated string, created string")
RAW_ITEMS = _ROW("item_id string, source string, url string, title string, published_at timestamp, topics array<string>, content string, cached_path string")
ENRICHED_ITEMS = T.StructType([*RAW_ITEMS.fields, *_ROW("has_fulltext boolean, full_text string, extraction_method string, full_text_words int").fields])
QUERIES = _ROW("query string, expansions array<string>")
ROBOTS = _ROW("domain string, status int, body string")
FETCHES = _ROW("url string, status_code int, final_url string, html binary, paywall_detected boolean")
CHUNKS = _ROW("item_id string, source string, url string, title string, published_at timestamp, topics array<string>, chunk_index int, chunk_count int, text string, char_start int, char_end int")
HEADLINERS = _ROW("item_id string, title string, source string, url string, headlines string")
SCRIPT_LINES = _ROW("line_id int, segment_id string, speaker string, voice string, item_id string, text string, refs array<int>, pause_ms_after int, secs_estimate double, ssml string, notes string")
