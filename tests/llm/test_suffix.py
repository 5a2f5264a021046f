import random

import numpy as np
import pytest

from docmill.llm import suffix_dedup as op
from docmill.llm.suffix_dedup import anchors, multikey_order, suffix_dedup


def brute(rows, length=100):
    """[(doc_id, kept bytes, bytes, removed, spans)]; rows that share id and text are one document."""
    first, data = {}, [(i, (t or "").encode()) for i, t in rows]
    order = sorted({(i, t) for i, t in data if i is not None})
    for i, t in order:
        for p in range(len(t) - length + 1):
            first.setdefault(t[p : p + length], (i, t, p))
    out = []
    for i, t in data:
        gone = np.zeros(len(t) + 1, bool)
        if i is not None:
            for p in range(len(t) - length + 1):
                if first[t[p : p + length]] != (i, t, p):
                    gone[p : p + length] = True
        gone = gone[: len(t)]
        out.append((i, bytes(b for b, g in zip(t, gone, strict=True) if not g), len(t), int(gone.sum()), int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))))
    return sorted(out, key=repr)


def found(docs, **kw):
    return sorted(((r.doc_id, bytes(r.kept), r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup(docs, **kw).collect()), key=repr)


def frame(spark, rows, n=5):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(n)


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def passages(seed=1):
    """Texts that share passages of all lengths about the limit, changed in places, at any offset, within and across texts."""
    rng = random.Random(seed)
    letters = "abcdefghij éß"
    say = lambda n: "".join(rng.choice(letters) for _ in range(n))
    shared = [say(n) for n in (60, 90, 95, 99, 100, 101, 130, 250, 700)]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(rng.randint(0, 6)):
            p = rng.choice(shared)
            if rng.random() < 0.4:
                at = rng.randrange(len(p))
                p = p[:at] + rng.choice(letters) + p[at + rng.randint(0, 2) :]
            a = rng.randrange(20)
            parts += [say(rng.randint(0, 60)), p[a:] if rng.random() < 0.3 else p]
        rows.append((1000 - i, "".join(parts)))
    rows += [(2000 + i, rows[i][1]) for i in range(0, 30, 3)]
    return rows


def test_edge_rows(edge):
    # ids that rows with different texts share are ordered by a hash that the brute version doesn't have
    docs = edge.where("coalesce(doc_id, 0) <> 73").unionByName(edge.where("doc_id = 73"))
    assert found(docs) == brute(rows_of(docs))


@pytest.mark.parametrize("bucket", [1 << 17, 40, 3])
def test_passages_whatever_the_buckets(spark, monkeypatch, bucket):
    monkeypatch.setattr(op, "BUCKET", bucket)
    rows = passages()
    assert found(frame(spark, rows)) == brute(rows)


def test_other_lengths(spark, monkeypatch):
    rows = passages(2)
    for length in (40, 64, 150):
        assert found(frame(spark, rows), length=length) == brute(rows, length)


def test_periods_and_overlaps(spark):
    rows = [(1, "a" * 450), (2, "ab" * 300 + "b"), (3, "xyz" * 33), (4, "xyz" * 34), (5, "q" + "a" * 130 + "r" + "a" * 99), (6, "\x00" * 300), (7, "é" * 120), (8, None), (9, ""), (None, "a" * 300)]
    assert found(frame(spark, rows)) == brute(rows)


def test_pieces_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(op, "PIECE", 300)
    monkeypatch.setattr("docmill.llm.words.BATCH", 300)
    rng = random.Random(5)
    base = "".join(rng.choice("abcdefgh ") for _ in range(4000))
    rows = [(1, base), (2, base[:1500] + "#" + base[1500:]), (3, base[700:2900] + base[100:900]), (4, base[::-1]), (5, "k" * 2000)]
    assert [x[:2] for x in anchors([r[1].encode() for r in rows], 100)]
    assert found(frame(spark, rows, 1)) == brute(rows)


def test_megabytes(spark):
    rng = random.Random(6)
    noise = "".join(rng.choice("abcdefghijklmnop") for _ in range(1_500_000))
    out = {r.doc_id: r for r in suffix_dedup(frame(spark, [(1, "a" * 1_500_000), (2, noise), (3, "!" + noise[:1_000_000] + "?"), (4, "b")])).collect()}
    assert (out[1].n_removed, out[1].n_spans, bytes(out[1].kept)) == (1_499_999, 1, b"a")
    assert (out[2].n_removed, out[3].n_removed, bytes(out[3].kept), out[4].n_removed) == (0, 1_000_000, b"!?", 0)


def test_rows_that_share_an_id(spark):
    rng = random.Random(7)
    text = "".join(rng.choice("abcdef") for _ in range(500))
    rows = [(1, text), (1, text), (1, text + "z"), (2, text)]
    out = sorted((r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup(frame(spark, rows)).collect())
    assert out[0][2] == out[1][2] and out[3] == (2, 500, 500)
    assert {out[0][2], out[2][2]} in ({0, 500}, {500, 0})


def test_hot_passage_and_no_rows(spark, nothing):
    rng = random.Random(8)
    line = "".join(rng.choice("mnopqrstuv") for _ in range(90))
    rows = [(i, f"{rng.random()}{line}{rng.random()}{i % 7}" * 2) for i in range(400)]
    assert found(frame(spark, rows, 9)) == brute(rows)
    assert suffix_dedup(nothing).count() == 0


def test_multikey_order():
    keys = np.random.default_rng(1).integers(0, 3, (500, 5)).astype(np.uint64)
    assert keys[multikey_order(keys)].tolist() == sorted(keys.tolist())
