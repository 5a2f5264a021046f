"""HTML to text over the standard library's parser, batch by batch through Arrow."""

from __future__ import annotations

import functools
import importlib
import importlib.util
from collections.abc import Callable
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions.content import extract_main

_SILENT = frozenset({"script", "style", "noscript"})
_VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"})


class _Collector(HTMLParser):
    """Text nodes in order, each with whether it lies in the first article; links to variants."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.nodes: list[tuple[str, bool]] = []
        self.article_at: int | None = None
        self.article_done = False
        self.amp: str | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "link" and self.amp is None:
            named = dict(attrs)
            if "amphtml" in (named.get("rel") or "").lower().split() and named.get("href"):
                self.amp = named["href"]
        if tag in _VOID:
            return
        if tag == "article" and self.article_at is None:
            self.article_at = len(self.open)
        self.open.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag not in self.open:
            return
        at = len(self.open) - 1 - self.open[::-1].index(tag)
        del self.open[at:]
        if self.article_at is not None and at <= self.article_at:
            self.article_done = True

    def handle_data(self, data):
        if not _SILENT.intersection(self.open):
            self.nodes.append((data, self.article_at is not None and not self.article_done))


def _parsed(html: str) -> _Collector:
    found = _Collector()
    found.feed(html)
    found.close()
    return found


def text_of(html: str | None, separator: str = "\n") -> str:
    """The text of the first article, else of the whole page, without scripts and styles: nodes stripped and joined, blank lines left out."""
    if not html:
        return ""
    found = _parsed(html)
    nodes = [t for t, inside in found.nodes if inside] if found.article_at is not None else [t for t, _ in found.nodes]
    text = separator.join(s for t in nodes if (s := t.strip()))
    return "\n".join(s for line in text.splitlines() if (s := line.strip()))


def variants_of(html: str | None, url: str) -> list[str]:
    """Addresses of an AMP page, if the page names one, and of a print page, unless this is one."""
    out = []
    if (found := _parsed(html or "")).amp:
        out.append(urljoin(url, found.amp))
    if "/print" not in url and "?print" not in url:
        out.append(url + ("print" if url.endswith("/") else "/print"))
    return out


def decoded(html: bytes | str | None) -> str:
    """UTF-8 with bytes that aren't left out."""
    if html is None:
        return ""
    return bytes(html).decode("utf-8", "ignore") if isinstance(html, (bytes, bytearray, memoryview)) else html


@F.pandas_udf(T.StringType())
def html_text(html: pd.Series) -> pd.Series:
    return html.map(lambda x: text_of(decoded(x)))


@F.pandas_udf(T.ArrayType(T.StringType()))
def html_variants(html: pd.Series, url: pd.Series) -> pd.Series:
    return pd.Series([variants_of(decoded(h), u or "") for h, u in zip(html, url, strict=True)])


#: Extractors by name: HTML text to article text, null if it has none. Those of other libraries can be registered under their names.
EXTRACTORS: dict[str, Callable[[str], str | None]] = {}


def register_extractor(name: str, extract: Callable[[str], str | None]) -> None:
    EXTRACTORS[name] = extract


def _article_only(html: str) -> str | None:
    found = _parsed(html)
    if found.article_at is None:
        return None
    return " ".join(s for t, inside in found.nodes if inside and (s := t.strip())) or None


@functools.cache
def _module(name: str):
    """A library that may not be installed; None then."""
    return importlib.import_module(name) if importlib.util.find_spec(name) else None


def _trafilatura(html: str) -> str | None:
    lib = _module("trafilatura")
    return lib and lib.extract(html)


def _readability(html: str) -> str | None:
    lib = _module("readability")
    return lib and text_of(lib.Document(html).summary(), " ")


def _newspaper(html: str) -> str | None:
    if (lib := _module("newspaper")) is None:
        return None
    page = lib.Article("")
    page.set_html(html)
    page.parse()
    return page.text


def _goose(html: str) -> str | None:
    lib = _module("goose3")
    return lib and lib.Goose().extract(raw_html=html).cleaned_text


# libraries where they are installed, then our own
register_extractor("trafilatura", _trafilatura)
register_extractor("readability", _readability)
register_extractor("newspaper3k", _newspaper)
register_extractor("goose3", _goose)
register_extractor("article", _article_only)
register_extractor("main", extract_main)
register_extractor("page", lambda html: text_of(html, " ") or None)


def extract_chain(html: Column, names: tuple[str, ...] = ("trafilatura", "readability", "newspaper3k", "goose3", "article", "main", "page"), least_words: int = 200, most_chars: int = 50_000) -> Column:
    """A struct (clean_text, word_count, extraction_method): the first extractor with enough words, null if none has.

    Texts are cut before words are counted; an extractor that is unknown or raises is passed over. One UDF runs the
    whole chain, so that later extractors only run if earlier ones fail.
    """
    chosen = [(n, EXTRACTORS[n]) for n in names if n in EXTRACTORS]

    @F.pandas_udf("clean_text string, word_count int, extraction_method string")
    def chain(pages: pd.Series) -> pd.DataFrame:
        rows = []
        for page in pages:
            html, row = decoded(page), (None, None, None)
            for name, extract in chosen:
                try:
                    text = extract(html)
                except Exception:  # noqa: BLE001  one extractor's failure isn't the page's
                    continue
                text = (text or "")[:most_chars]
                n = len(text.split())
                if text and n >= least_words:
                    row = (text, n, name)
                    break
            rows.append(row)
        return pd.DataFrame(rows, columns=["clean_text", "word_count", "extraction_method"])

    out = chain(html)
    return F.when(out.extraction_method.isNotNull(), out)
