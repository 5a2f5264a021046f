import corpus_pipeline
from docmill.llm.decontaminate import contamination
from docmill.llm.toxicity import fit_toxicity, score_toxicity
from tests.llm import brute
from tests.llm.conftest import DATA


def texts(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def test_stages_on_their_own_inputs(spark, documents, tmp_path):
    docs = documents
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        path = str(tmp_path / str(k))
        out.write.parquet(path)
        out = spark.read.parquet(path)
        before, after = dict(texts(docs)), {r.doc_id: r for r in out.collect()}
        if k < 4:
            assert out.columns == docs.columns, name
        if k == 0:
            p = {r.doc_id: r.toxic_probability for r in score_toxicity(docs, fit_toxicity(docs, spark.read.parquet(f"{DATA}/labels.parquet"))).collect()}
            assert set(after) == {i for i in before if p[i] < 0.5} and len(after) > 0.9 * len(before)
        elif k == 1:
            assert {(i, r.text) for i, r in after.items()} == {(i, t) for i, _, _, t in brute.line_dedup(list(before.items()))}
            assert all(r.n_chars == len(r.text) for r in after.values())
        elif k == 2:
            assert set(after) == {i for i, _, c in brute.ngram_components(list(before.items())) if i == c}
        elif k == 3:
            found = {r.doc_id for r in contamination(docs, spark.read.parquet(f"{DATA}/benchmark.parquet")).collect()}
            assert set(after) == set(before) - found
        else:
            assert {i: r["size"] for i, r in after.items()} == {i: len(brute.words(t)) for i, t in before.items()}
        docs = out
    assert sorted(map(tuple, corpus_pipeline.run(spark, DATA).collect())) == sorted(map(tuple, docs.collect()))


def test_edges(spark, edge, nothing):
    for rows in (edge, nothing):
        docs = rows
        for name, stage in corpus_pipeline.STAGES:
            columns = docs.columns
            docs = stage(spark, docs, DATA)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert docs.columns == columns
        assert docs.count() >= (10 if rows is edge else 0)
    kept = corpus_pipeline.near_duplicates(spark, edge, DATA)
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(None) == 2 and ids.count(30) == 1 and 73 not in ids


def test_rows_without_an_id_of_their_own(spark):
    """Leaks, near copies and equal rows among rows that share an id or have none are judged row by row."""
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").orderBy("item_id").first().text
    base, own = " ".join(f"w{k}" for k in range(80)), " ".join(f"v{k}" for k in range(40))
    made = [(None, f"{own} {item}", "x"), (None, base, "x"), (None, base + " end", "x"), (7, base, "x"), (7, base, "x"), (7, "quite another text of one id", "x"), (7, f"x y {item}", "x"), (3, None, "x"), (None, "", None)]
    docs = spark.createDataFrame(made, "doc_id long, text string, source string").repartition(4)
    near = corpus_pipeline.near_duplicates(spark, docs, DATA)
    kept = [tuple(r) for r in near.collect()]
    assert near.columns == docs.columns and sorted(kept, key=repr) == sorted([r for k, r in enumerate(made) if k not in (1, 2, 4)], key=repr)
    clean = [tuple(r) for r in corpus_pipeline.decontamination(spark, docs, DATA).collect()]
    assert sorted(clean, key=repr) == sorted([r for k, r in enumerate(made) if k not in (0, 6)], key=repr)
