"""Language detection from character trigrams: profiles counted from labelled texts, naive Bayes with add-one smoothing. Trigrams are numbers, counted and
looked up a piece of a batch at a time inside tasks; Spark's own functions lower the texts, add the counts up and choose.

The profiles are a table of at most ``most`` trigrams, the most frequent of all languages together; that bounds what is broadcast, whatever the corpus. All texts are counted whole,
and a task combines its counts before they are shuffled.

Edge cases: null and empty texts, and texts without a known trigram, get the language with most training texts; null labels are not learnt from. Of equal scores the alphabetically
first language wins. Without any label there is no profile, and every text is ``unknown``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.functions.text import filled
from docmill.runtime import bounded_batches, lean, written

#: Trigrams that a model holds.
MOST = 1 << 16


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All trigrams of the texts with a space at either end, as numbers in the order of their characters, and the place of the text of each. None of empty texts."""
    padded = [f" {t} " if t else "" for t in texts]
    chars = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in padded])
    if len(chars) < 3:
        return np.zeros(0, np.int64), owner[:0]
    inside = owner[2:] == owner[:-2]
    return (chars[:-2] << 42 | chars[1:-1] << 21 | chars[2:])[inside], owner[2:][inside]


def _pieces(batch: pa.RecordBatch, chars: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch that have about so many characters of ``t`` at most; a longer text is a part."""
    sizes = pc.fill_null(pc.utf8_length(batch.column("t")), 0).to_numpy(zero_copy_only=False)
    at, n = 0, 0
    for i, size in enumerate(sizes):
        if n and n + size > chars:
            yield batch.slice(at, i - at)
            at, n = i, 0
        n += int(size) + 1
    yield batch.slice(at)


@dataclass(frozen=True)
class LanguageModel:
    """``profiles`` has (gram, weights), trigrams as numbers and the logarithms by language in the order of ``languages``; ``priors`` those of the languages."""

    languages: tuple[str, ...]
    priors: tuple[float, ...]
    profiles: DataFrame


def fit_languages(texts: DataFrame, text: str = "text", label: str = "lang", most: int = MOST) -> LanguageModel:
    """Profiles of the languages in ``label``, from whole texts."""
    bounded_batches(texts.sparkSession)
    labelled = texts.where(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("lang"), F.col(text).alias("text"))
    found = sorted((r["lang"], r["n"]) for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect())
    languages, total = tuple(x for x, _ in found), sum(n for _, n in found)

    def counted(batches):
        for batch in batches:
            for piece in _pieces(batch):
                lang = np.array(piece.column("lang").to_pylist(), object)
                texts = np.array(piece.column("t").to_pylist(), object)
                for k, x in enumerate(languages):
                    gram, n = np.unique(_grams(list(texts[lang == x]))[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), k, np.int32)), pa.array(gram), pa.array(n.astype(np.int64))], names=["k", "gram", "n"])

    grams = labelled.select("lang", F.lower(filled(F.col("text"))).alias("t")).mapInArrow(lean(counted), "k int, gram long, n long")
    # a column for each language
    counts = [F.coalesce(F.sum(F.when(F.col("k") == k, F.col("n"))), F.lit(0)).alias(f"n{k}") for k in range(len(languages))]
    each = written(grams.groupBy("gram").agg(F.sum("n").alias("n"), *counts), "trigrams")
    names = [f"n{k}" for k in range(len(languages))]
    sums = each.agg(F.count(F.lit(1)).alias("v"), *(F.sum(n).alias(n) for n in names)).first()
    weights = [F.ln((F.col(n) + 1) / F.lit(float((sums[n] or 0) + sums["v"]))) for n in names]
    best = each.orderBy(F.col("n").desc(), "gram").limit(most)
    profiles = written(best.select("gram", F.array(*weights).cast("array<double>").alias("weights")), "profiles")
    priors = texts.sparkSession.range(1).select(F.array(*(F.ln(F.lit(n / total)) for _, n in found)).cast("array<double>")).first()[0]
    return LanguageModel(languages, tuple(priors), profiles)


def detected(texts: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, language, score) for each row, whose key is its own: the likeliest language and its logarithm, rounded.

    Trigrams meet the broadcast profiles where the texts are; nothing is shuffled.
    """
    if not model.languages:
        return texts.select(key, F.lit("unknown").alias("language"), F.lit(0.0).alias("score"))
    bounded_batches(texts.sparkSession)
    known = sorted((r["gram"], *r["weights"]) for r in model.profiles.collect())
    shared = texts.sparkSession.sparkContext.broadcast((np.array([r[0] for r in known], np.int64), np.array([r[1:] for r in known], np.float64).reshape(-1, len(model.languages))))

    def summed(batches):
        grams, weights = shared.value
        for batch in batches:
            for piece in _pieces(batch):
                gram, owner = _grams(piece.column("t").to_pylist())
                at = np.minimum(np.searchsorted(grams, gram), max(0, len(grams) - 1))
                hit = grams[at] == gram if len(grams) else np.zeros(len(gram), bool)
                sums = np.stack([np.bincount(owner[hit], weights[at[hit], k], piece.num_rows) for k in range(weights.shape[1])], 1)
                yield pa.RecordBatch.from_arrays([piece.column("k"), pa.array(list(sums), pa.list_(pa.float64()))], names=["k", "sums"])

    kind = texts.schema[key].dataType.simpleString()
    found = texts.select(F.col(key).alias("k"), F.lower(filled(F.col(text))).alias("t")).mapInArrow(lean(summed), f"k {kind}, sums array<double>")
    sums = [F.round(F.col("sums")[k] + F.lit(p), 3) for k, p in enumerate(model.priors)]
    best = F.array_min(F.array(*(F.struct((-s).alias("less"), F.lit(x).alias("language")) for s, x in zip(sums, model.languages, strict=True))))
    return found.select(F.col("k").alias(key), best.alias("best")).select(key, F.col("best.language").alias("language"), (-F.col("best.less")).alias("score"))


def accuracy(rows: DataFrame, guess: str = "language", label: str = "lang") -> DataFrame:
    """(label, n, n_right, share) by language, and one row with a null label over all."""
    right = F.count_if(F.col(guess) == F.col(label))
    return rows.where(F.col(label).isNotNull()).rollup(label).agg(F.count(F.lit(1)).alias("n"), right.alias("n_right"), (right / F.count(F.lit(1))).alias("share"))
