import zlib
from hashlib import sha256

from pyspark.sql import functions as F

from docmill.llm.merkle import FIELDS, folded, merkle_manifest, op11_merkle_manifest
from tests.llm.conftest import DATA


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(digests):
    """(root, siblings of each leaf, in order)"""
    beside, at = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        runs = [digests[i : i + 3] for i in range(0, len(digests), 3)]
        for k, i in enumerate(at):
            beside[k] += [d for j, d in enumerate(runs[i // 3]) if j != i % 3]
            at[k] = i // 3
        digests = [h(*r) for r in runs]
    return digests[0], beside


def brute(rows):
    """{(doc_id, leaf): (subroot, root, proof)} with the proofs of rows alike as a sorted list."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(((r[0] is not None, r[0] or 0), leaf(r), r[0]))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[1] for x in sorted(groups[s])]) for s in names}
    root, over = tree([trees[s][0] for s in names])
    return sorted((repr(i), d, trees[s][0], root, "".join(p) + "".join(over[k])) for k, s in enumerate(names) for (_, d, i), p in zip(sorted(groups[s]), trees[s][1], strict=True))


def found(docs):
    return sorted((repr(r.doc_id), r.leaf, r.subroot, r.root, r.proof) for r in merkle_manifest(docs).collect())


def given(docs):
    return [tuple(r) for r in docs.select(*FIELDS).collect()]


def test_edge_rows(edge):
    assert found(edge) == brute(given(edge))


def test_one_hot_source_over_several_bands(spark):
    docs = spark.range(7000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") % 10 < 9, F.concat(F.lit("s"), F.col("id") % 400)).alias("source"), F.lit("en").alias("lang"), F.lit(None).cast("long").alias("n_chars"), F.concat(F.lit("t\n"), F.col("id") * 7).alias("text"))
    assert found(docs.repartition(13)) == brute(given(docs))


def test_a_row_each_where_links_wait_for_other_tasks(spark):
    docs = spark.range(12_000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("en").alias("lang"), F.lit(1).cast("long").alias("n_chars"), F.col("id").cast("string").alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found(docs) == brute(given(docs))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_one_row_and_none(edge, nothing):
    one = edge.where("doc_id = 70")
    (row,) = merkle_manifest(one).collect()
    assert row.proof == "" and row.leaf == row.subroot == row.root == row.folded_root == leaf(given(one)[0])
    assert merkle_manifest(nothing).count() == 0


def test_megabytes_of_text(spark):
    docs = spark.createDataFrame([(1, "a", None, 3, "word\n" * 1_000_000), (2, "a", "en", 3, ""), (3, None, "en", None, None)], "doc_id long, source string, lang string, n_chars long, text string")
    assert found(docs) == brute(given(docs))


def test_same_in_any_order_and_partitioning(edge):
    assert found(edge.repartition(1)) == found(edge.orderBy(F.desc("doc_id")).repartition(9))


def test_a_proof_folds_to_the_root_and_a_changed_leaf_does_not(edge):
    digests = [h(str(i)) for i in range(23)]
    root, beside = tree(digests)
    for i, d in enumerate(digests):
        assert folded(d, beside[i], [(i, 23)]) == root != folded(h("x"), beside[i], [(i, 23)])
    for r in merkle_manifest(edge, offered={"text": F.when(F.col("doc_id") == 70, F.lit("other")).otherwise(F.col("text"))}).collect():
        assert (r.folded_root == r.root) == (r.doc_id != 70)


def test_query(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    out = op11_merkle_manifest(spark, DATA).collect()
    want = {(i, d): (s, root, h(p)) for i, d, s, root, p in brute([tuple(r[c] for c in FIELDS) for r in docs.values()])}
    assert len(out) == len(docs) == len(want)
    for r in out:
        assert (r.subroot, r.root, r.proof_sha256) == want[repr(r.doc_id), r.leaf]
        changed = zlib.crc32(str(r.doc_id).encode()) % 2 == 0 and "\n" in (docs[r.doc_id].text or "")
        assert r.verified == (r.folded_root == r.root) == (not changed)
