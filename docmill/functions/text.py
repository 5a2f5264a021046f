"""Text expressions with the white-space rules of Python's ``str``, on Spark's own functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as ``str.split`` and ``str.strip`` take it; Java's own class misses the last four controls.
BLANK = "(?U)[\\s\\x1c-\\x1f]"
BULLET = "•"


def filled(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def tokens(text: Column, lower: bool = False) -> Column:
    """``text.split()``, of the lower-cased text if ``lower``."""
    body = F.lower(filled(text)) if lower else filled(text)
    return F.filter(F.split(body, f"{BLANK}+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(tokens(text))


def non_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def snippet(text: Column, words: int = 40) -> Column:
    """The first words, and dots in any case."""
    return F.concat(F.array_join(F.slice(tokens(text), 1, words), " "), F.lit("..."))


def preview(text: Column, chars: int = 150) -> Column:
    return F.concat(F.left(filled(text), F.lit(chars)), F.lit("..."))


def segment_id(title: Column, prefix: str = "SEG_", most: int = 40) -> Column:
    """``prefix`` and the title in kebab case."""
    kebab = F.left(F.regexp_replace(F.lower(filled(title)), "[^a-z0-9]+", "-"), F.lit(most))
    return F.concat(F.lit(prefix), F.btrim(kebab, F.lit("-")))


def duration(text: Column, words_per_minute: int = 150) -> Column:
    """Seconds to speak the text."""
    return word_count(text) / F.lit(float(words_per_minute)) * F.lit(60.0)


def bullets(text: Column) -> Column:
    """Lines that begin with a bullet, without it."""
    lines = F.transform(F.split(filled(text), "\n"), strip)
    return F.transform(F.filter(lines, lambda x: F.startswith(x, F.lit(BULLET))), lambda x: strip(F.substring(x, 2, 1 << 30)))


def titles_preview(titles: Column, most: int = 5, chars: int = 80) -> Column:
    """The first titles of an array, cut, each on a line with a dash; empty ones left out."""
    cut = F.transform(F.slice(titles, 1, most), lambda t: F.left(filled(t), F.lit(chars)))
    return F.array_join(F.transform(F.filter(cut, lambda t: t != ""), lambda t: F.concat(F.lit("- "), t)), "\n")


def ssml(text: Column, pause_ms: Column) -> Column:
    """The text, not escaped, in a speak element, with a break only after a positive pause."""
    pause = F.coalesce(pause_ms, F.lit(0))
    return F.concat(F.lit("<speak>"), filled(text), F.when(pause > 0, F.concat(F.lit("<break time='"), pause.cast("string"), F.lit("ms'/>"))).otherwise(F.lit("")), F.lit("</speak>"))


def spoken_spellings(name: str) -> list[str]:
    """Three spellings of a name that a voice would spell out: capitals, capitalised, alternating."""
    return [name.upper(), name.capitalize(), "".join(c.upper() if k % 2 == 0 else c.lower() for k, c in enumerate(name))]


def speakable(text: Column, spellings: Sequence[str], spoken: str) -> Column:
    """``text`` with whole words that are one of ``spellings`` replaced by ``spoken``; other spellings stay."""
    if not spellings:
        return text
    words = "|".join("".join(c if c.isalnum() else "\\" + c for c in w) for w in spellings)
    return F.regexp_replace(text, f"\\b(?:{words})\\b", spoken)


def unfenced(text: Column) -> Column:
    """The inside of a Markdown code fence without its language tag, if the text begins with one."""
    body = strip(filled(text))
    inside = F.regexp_replace(F.split_part(body, F.lit("```"), F.lit(2)), "^(jsonl|json)", "")
    return F.when(F.startswith(body, F.lit("```")), strip(inside)).otherwise(body)


def expanded_query(query: Column, expansions: Column) -> Column:
    """The query, then its expansions, joined by ``"; "``: the words before a semicolon keep it as tokens."""
    return F.array_join(F.concat(F.array(query), F.coalesce(expansions, F.array().cast("array<string>"))), "; ")


def retrieval_text(full_text: Column, has_fulltext: Column, words: Column, content: Column, title: Column, least: int = 50) -> Column:
    """The full text if it is there, not empty and over ``least`` words long; else the content, else the title."""
    good = F.coalesce(has_fulltext, F.lit(False)) & (F.coalesce(words, F.lit(0)) > least)
    return F.coalesce(F.when(good, non_empty(full_text)), non_empty(content), filled(title))
