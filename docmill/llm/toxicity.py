"""Toxicity by cumulative-link (proportional odds) regression over sparse text features.

Features are hashes of words (A-Z lower-cased, ASCII marks as separators) and of their first 4 to 8 bytes, valued
1 + ln(count), and steps in how many words of a text are markers. The model has one weight a feature, shared by all grades, and ordered thresholds:
P(grade > k) = sigmoid(w.x - threshold_k). It gives the expected severity and the probability that the grade is above 0.

It is fitted on a bounded sample of the labelled documents (``sample`` rows in the order of a hash of the id, copies of
a text and near copies once), and scores every document in one pass without a shuffle. Labels of more than two values are grades as they
are (in their order, 0 or less for clean). Labels of two get grades from the text: a toxic document's grade is 1, 2 or 3 by the tertile of
how many toxic markers it holds a word, markers being features far more frequent in toxic than in other documents of the sample.

Edge cases: null or empty text has no feature and gets the base rate. Labels with null in id or label are left out; if a
document has several labels the largest counts. Without any toxic or any clean label every probability is the base
rate of the sample, 0 for no labels. Repeated rows get equal scores; in the sample equal texts count once, with the largest label. Documents are taken into the
sample by a hash of their ids, ties by id. Very long texts are read in pieces. An empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.words import as_bytes, batches, hashed, lean
from docmill.runtime import bounded_batches

#: Rows of the labelled sample on which the model is fitted. Features are kept as the sample's evidence asks, however many.
SAMPLE = 8192
PREFIXES = (4, 5, 6, 7, 8)
#: Beside the hashed features: whether at least so many words of a text have a marker.
STEPS = (1, 2, 4, 8)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, word) for every occurrence: 32-bit hashes of words and of their beginnings, and which word it was."""
    words, offsets, *begun = hashed(texts, lower=True, alnum=True, prefixes=PREFIXES)
    word = np.arange(len(words))
    at = np.concatenate([word, *(word[b != 0] for b in begun)])
    key = np.concatenate([words, *(b[b != 0] for b in begun)])
    return np.repeat(np.arange(len(texts)), np.diff(offsets))[at], (key >> np.uint64(32)).astype(np.uint32), at


def encoded(texts: list[bytes], keys: np.ndarray, markers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value) of the sparse matrix: kept features as 1 + ln(count), then the steps in how many words have one that is a marker."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    if len(keys):
        known = np.zeros(1 << 16, bool)
        known[keys >> np.uint32(16)] = True
        for lo, hi in batches(texts):
            row, key, word = features(texts[lo:hi])
            maybe = known[key >> np.uint32(16)]
            row, key, word = row[maybe], key[maybe], word[maybe]
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[at] == key
            row, at, word = row[hit], at[hit], word[hit]
            pair, count = np.unique(row * len(keys) + at, return_counts=True)
            out.append((lo + pair // len(keys), pair % len(keys), 1 + np.log(count)))
            strong = markers[at]
            _, first = np.unique(word[strong], return_index=True)
            n_words = np.bincount(row[strong][first], minlength=hi - lo)
            for j, step in enumerate(STEPS):
                r = np.flatnonzero(n_words >= step)
                out.append((lo + r, np.full(len(r), len(keys) + j), np.ones(len(r))))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


@dataclass
class Ordinal:
    """A fitted model: sorted feature hashes, their weights and those of the steps, thresholds, which features are markers."""

    keys: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray
    markers: np.ndarray

    def above(self, eta: np.ndarray) -> np.ndarray:
        """P(grade > k) for each row and threshold."""
        return 1 / (1 + np.exp(-np.clip(eta[:, None] - self.thresholds[None, :], -40, 40)))

    def linear(self, texts: list[bytes]) -> np.ndarray:
        """w.x of each text."""
        row, col, val = encoded(texts, self.keys, self.markers)
        return np.bincount(row, val * self.weights[col], len(texts)) if len(row) else np.zeros(len(texts))


def unlike(sets: list[np.ndarray], bands: int = 12, rows: int = 2, least: float = 0.5) -> np.ndarray:
    """Indices of sets of which none is a near copy (Jaccard ``least``) of an earlier one, by MinHash bands. For the bounded sample:
    else every word of a text of which the corpus holds many near copies would look like a marker."""
    odd = (np.arange(1, bands * rows + 1, dtype=np.uint32) * np.uint32(0x9E3779B1)) | np.uint32(1)
    seen: dict[tuple, list[int]] = {}
    kept = []
    for i, own in enumerate(sets):
        if not len(own):
            kept.append(i)
            continue
        mins = [int((own * m ^ (own * m >> np.uint32(15))).min()) for m in odd]
        keys = [(b, *mins[b * rows : (b + 1) * rows]) for b in range(bands)]
        near = {j for k in keys for j in seen.get(k, ())}
        if any((c := len(np.intersect1d(own, sets[j], assume_unique=True))) >= least * (len(own) + len(sets[j]) - c) for j in near):
            continue
        kept.append(i)
        for k in keys:
            seen.setdefault(k, []).append(i)
    return np.array(kept, np.int64)


def fit_ordinal(row: np.ndarray, col: np.ndarray, val: np.ndarray, grade: np.ndarray, n_features: int, penalty: float = 0.5, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) that maximise the penalised likelihood of ordered grades, by full-batch Adam."""
    n, top = len(grade), int(grade.max())
    share = np.array([np.clip((grade > k).mean(), 1e-4, 1 - 1e-4) for k in range(top)])
    base = -np.log(share / (1 - share))
    # thresholds stay ordered: the first is free, the others add positive steps
    params = np.concatenate([np.zeros(n_features), base[:1], np.log(np.maximum(np.diff(base), 1e-2))])
    m, v = np.zeros_like(params), np.zeros_like(params)
    for t in range(1, steps + 1):
        w, free = params[:n_features], params[n_features:]
        gaps = np.exp(free[1:])
        thresholds = np.cumsum(np.concatenate([free[:1], gaps]))
        eta = np.bincount(row, val * w[col], n)
        above = 1 / (1 + np.exp(-np.clip(eta[:, None] - thresholds, -40, 40)))
        padded = np.hstack([np.ones((n, 1)), above, np.zeros((n, 1))])
        slope = np.hstack([np.zeros((n, 1)), above * (1 - above), np.zeros((n, 1))])
        at = np.arange(n)
        p = np.maximum(padded[at, grade] - padded[at, grade + 1], 1e-12)
        d_eta = (slope[at, grade] - slope[at, grade + 1]) / p
        d_threshold = np.zeros((n, top + 2))
        d_threshold[at, grade] -= slope[at, grade] / p
        d_threshold[at, grade + 1] += slope[at, grade + 1] / p
        g_threshold = d_threshold[:, 1 : top + 1].sum(0)
        later = np.cumsum(g_threshold[::-1])[::-1]
        gradient = np.concatenate([np.bincount(col, val * d_eta[row], n_features) - penalty * w, later[:1], later[1:] * gaps])
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        params = params + 0.1 * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return params[:n_features], np.cumsum(np.concatenate([params[n_features : n_features + 1], np.exp(params[n_features + 1 :])]))


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ordinal:
    """The model from at most ``sample`` labelled rows."""
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .dropna()
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    # at most `sample` rows of 12 bytes: a proven bound
    labelled = slim.join(F.broadcast(chosen), "doc_id")

    def collected(of, kinds):
        """One row for each different text of the sample: (its hash, toxic, *arrays that ``of`` makes of it)."""
        names = [f"a{k}" for k in range(len(kinds))]

        def scan(parts):
            for batch in parts:
                texts = as_bytes(batch.column("text"))
                made = [[np.asarray(x, k).tobytes() for x, k in zip(of(t), kinds, strict=True)] for t in texts]
                columns = [pa.array([m[j] for m in made], pa.binary()) for j in range(len(kinds))]
                yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([hash_of(t) for t in texts], pa.int64()), *columns], names=["toxic", "same", *names])

        rows = labelled.mapInArrow(lean(scan), "toxic int, same long, " + ", ".join(f"{n} binary" for n in names))
        out, seen = [], set()
        for r in rows.orderBy("same", F.col("toxic").desc()).toLocalIterator():
            if r["same"] not in seen:
                seen.add(r["same"])
                out.append((r["same"], r["toxic"], *(np.frombuffer(bytes(r[n]), k) for n, k in zip(names, kinds, strict=True))))
        return out

    texts = collected(lambda t: [np.unique(features([t])[1])], [np.uint32])
    texts = [texts[i] for i in unlike([k for _, _, k in texts])]
    y, keys, chosen_texts = np.array([t > 0 for _, t, _ in texts], np.int64), [k for _, _, k in texts], {s for s, _, _ in texts}
    none = np.zeros(0)
    if not len(y) or y.min() == y.max():
        share = np.clip(y.mean() if len(y) else 1e-6, 1e-6, 1 - 1e-6)
        return Ordinal(np.zeros(0, np.uint32), none, np.array([-np.log(share / (1 - share))]), np.zeros(0, bool))
    in_toxic, n_toxic = np.unique(np.concatenate([k for k, t in zip(keys, y, strict=True) if t]), return_counts=True)
    in_toxic, n_toxic = in_toxic[n_toxic >= 3], n_toxic[n_toxic >= 3]
    n_clean = np.zeros(len(in_toxic), np.int64)
    for k, t in zip(keys, y, strict=True):
        if not t and len(in_toxic):
            at = np.minimum(np.searchsorted(in_toxic, k), len(in_toxic) - 1)
            n_clean[at[in_toxic[at] == k]] += 1
    # features more frequent in toxic documents than chance explains for that many features: the root of the likelihood
    # ratio against sqrt(2 ln m). Others would only add noise that grows with the text's length.
    T, C = int(y.sum()), int((1 - y).sum())
    ratio = np.log((n_toxic + 0.5) / (T - n_toxic + 0.5)) - np.log((n_clean + 0.5) / (C - n_clean + 0.5))
    g = np.zeros(len(in_toxic))
    for seen_here, of in ((n_toxic, T), (n_clean, C)):
        share = (n_toxic + n_clean) / (T + C)
        for observed, expected in ((seen_here, of * share), (of - seen_here, of * (1 - share))):
            g += 2 * observed * np.log(np.maximum(observed, 1) / np.maximum(expected, 1e-9)) * (observed > 0)
    z = np.sqrt(np.maximum(g, 0)) * (ratio > 0)
    best = np.flatnonzero(z >= np.sqrt(2 * np.log(max(2, len(in_toxic)))))
    kept, marker = in_toxic[best], ratio[best] > 3
    if not len(kept):
        share = T / len(y)
        return Ordinal(np.zeros(0, np.uint32), none, np.array([-np.log(share / (1 - share))]), np.zeros(0, bool))
    def sparse(t):
        _, col, val = encoded([t], kept, marker)
        return col, val, [len(t.split())]

    again = [r[1:] for r in collected(sparse, [np.int32, np.float64, np.int64]) if r[0] in chosen_texts]
    given = np.array([r[0] for r in again], np.int64)
    y = (given > 0).astype(np.int64)
    rows = np.repeat(np.arange(len(again)), [len(r[1]) for r in again])
    cols, vals = np.concatenate([r[1] for r in again]).astype(np.int64), np.concatenate([r[2] for r in again])
    marks = cols < len(kept)
    marks[marks] = marker[cols[marks]]
    density = np.bincount(rows[marks], np.exp(vals[marks] - 1), len(again)) / np.maximum(1, np.array([int(r[3][0]) for r in again]))
    if len(np.unique(given)) > 2:
        grade = np.maximum(given, 0)
    else:
        cuts = np.quantile(density[y == 1], [1 / 3, 2 / 3])
        grade = np.where(y == 1, 1 + (density > cuts[0]) + (density > cuts[1]), 0)
    _, grade = np.unique(grade, return_inverse=True)
    weights, thresholds = fit_ordinal(rows, cols, vals, grade, len(kept) + len(STEPS))
    return Ordinal(kept, weights, thresholds, marker)


def hash_of(text: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def score_toxicity(docs: DataFrame, model: Ordinal) -> DataFrame:
    """``docs`` with ``severity`` (expected grade) and ``toxic_probability``; columns so named are replaced."""
    bounded_batches(docs.sparkSession)
    added = ("severity", "toxic_probability")
    own = [f for f in docs.schema if f.name not in added]
    spec = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in own)

    def score(parts):
        for batch in parts:
            above = model.above(model.linear(as_bytes(batch.column(batch.num_columns - 1))))
            columns = [batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(above.sum(1)), pa.array(above[:, 0])], names=[*(f.name for f in own), *added])

    frame = docs.select(*(F.col(f"`{f.name}`") for f in own), F.col("text").cast("string").alias("__text"))
    return frame.mapInArrow(lean(score), f"{spec}, severity double, toxic_probability double")


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    ids = score_toxicity(docs.select("doc_id", "text"), model)
    return ids.select("doc_id", "severity", "toxic_probability", (F.col("toxic_probability") >= 0.5).alias("toxic"))
