"""Language detection from function words, on Spark's own functions. A deterministic stand-in for a trained detector."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docmill.functions.text import filled, tokens

#: Frequent function words by language.
PROFILES = {
    "de": ("der", "die", "das", "und", "den", "dem", "von", "mit", "ist", "nicht", "ein", "eine", "auf", "für", "sich", "zu", "im", "auch"),
    "en": ("the", "of", "and", "to", "in", "is", "that", "for", "it", "with", "was", "on", "as", "are", "this", "by", "from", "at"),
    "es": ("de", "la", "que", "el", "en", "y", "los", "del", "se", "las", "por", "un", "para", "con", "una", "no", "su", "al"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "sur", "pas", "au"),
    "it": ("di", "che", "la", "il", "e", "un", "per", "non", "sono", "una", "del", "con", "della", "gli", "nel", "alla", "come", "anche"),
    "pt": ("de", "que", "o", "e", "da", "em", "um", "para", "com", "não", "uma", "os", "no", "se", "na", "por", "mais", "dos"),
}


def detect(text: Column, sample: int = 1000) -> Column:
    """The language whose words are most frequent in the first ``sample`` characters, the alphabetically first of equals; ``unknown`` without any."""
    words = F.transform(tokens(F.left(filled(text), F.lit(sample)), lower=True), lambda w: F.btrim(w, F.lit(".,;:!?()\"'")))
    scored = F.array(*(F.struct((-F.size(_among(words, p))).alias("n"), F.lit(lang).alias("lang")) for lang, p in sorted(PROFILES.items())))
    best = F.array_min(scored)
    return F.when(best.n < 0, best.lang).otherwise(F.lit("unknown"))


def _among(words: Column, profile: tuple[str, ...]) -> Column:
    return F.filter(words, lambda w: w.isin(*profile))
