import random

import pytest
from pyspark.sql import functions as F

from docmill.llm.graph import components
from docmill.llm.line_dedup import line_dedup, op2_line_dedup
from docmill.llm.ngram_join import boundary, least_difference, ngram_components, op7_ngram_join, parity_map, shingle_sets
from docmill.llm.substring_dedup import op4_substring_dedup, substring_dedup
from tests.llm import brute
from tests.llm.conftest import DATA


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def texts(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("few", [1 << 20, 0], ids=["broadcast", "joined"])
def test_line_dedup(edge, few):
    out = line_dedup(edge, broadcast_keys=few)
    assert out.columns == [*edge.columns, "n_lines", "n_dropped"]
    assert rows(out, "doc_id", "n_lines", "n_dropped", "text") == sorted(brute.line_dedup(texts(edge)), key=repr)
    assert out.where("n_dropped > 0").count() == 11


def test_line_dedup_replaces_columns_of_its_names(edge):
    out = line_dedup(edge.withColumn("n_lines", F.lit("x")).drop("score"))
    assert dict(out.dtypes)["n_lines"] == "bigint" and out.columns.count("n_lines") == 1


def test_line_dedup_nothing(nothing):
    assert line_dedup(nothing).count() == 0


def test_op2(spark, documents):
    want = [(i, n, d, brute.sha(t)) for i, n, d, t in brute.line_dedup(texts(documents))]
    assert rows(op2_line_dedup(spark, DATA), "doc_id", "n_lines", "n_dropped", "kept_sha256") == sorted(want, key=repr)


def test_substring_dedup(edge, nothing):
    got = rows(substring_dedup(edge), "doc_id", "n_words", "n_removed", "text")
    assert got == sorted(brute.substring_dedup(texts(edge)), key=repr)
    assert sum(r[2] > 0 for r in got) >= 13
    assert substring_dedup(nothing).count() == 0


def test_substring_dedup_of_rows_that_share_an_id(spark):
    """One id holds most rows, with passages of its own, of others, and repeated texts."""
    rng = random.Random(9)
    say = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    passages = [say(60) for _ in range(6)]
    made = [(k % 3 and 50, f"{say(10)} {passages[k % 6]} {say(k)} {passages[(k * 5) % 6]}") for k in range(40)] + [(7, passages[1]), (90, f"{passages[2]} {passages[3]}"), (50, passages[4]), (None, passages[5])]
    made += made[3:5]
    docs = spark.createDataFrame(made, "doc_id long, text string").repartition(3)
    assert rows(substring_dedup(docs), "doc_id", "n_words", "n_removed", "text") == sorted(brute.substring_dedup(made), key=repr)


def test_operators_on_a_very_long_text(spark):
    """Texts of megabytes, beside columns named like the engine's own."""
    rng = random.Random(4)
    passage = " ".join(f"p{k}" for k in range(70))
    line = "a line that many documents hold, longer than forty characters"
    long = " ".join(f"w{rng.randrange(9000)}" for _ in range(250_000))
    made = [(1, f"{passage}\n{line}"), (2, f"{long} {passage}\n{line}\n{line}"), (3, f"{long} end"), *((k, line) for k in range(4, 8))]
    docs = spark.createDataFrame([(i, t, 1, 2, "x", 3) for i, t in made], "doc_id long, text string, n int, same int, kept string, c int")
    assert rows(substring_dedup(docs), "doc_id", "n_words", "n_removed", "text") == sorted(brute.substring_dedup(made), key=repr)
    assert rows(line_dedup(docs), "doc_id", "n_lines", "n_dropped", "text") == sorted(brute.line_dedup(made), key=repr)
    assert rows(ngram_components(docs), "doc_id", "n_shingles", "component_id") == sorted(brute.ngram_components(made), key=repr)


def test_substring_dedup_other_window(edge):
    assert rows(substring_dedup(edge, 21), "doc_id", "n_words", "n_removed", "text") == sorted(brute.substring_dedup(texts(edge), 21), key=repr)


def test_op4(spark, documents):
    want = [(i, n, d, brute.sha(t)) for i, n, d, t in brute.substring_dedup(texts(documents))]
    assert rows(op4_substring_dedup(spark, DATA), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(want, key=repr)


def test_ngram_components(edge, nothing):
    assert rows(ngram_components(edge), "doc_id", "n_shingles", "component_id") == sorted(brute.ngram_components(texts(edge)), key=repr)
    assert ngram_components(nothing).count() == 0


def test_op7(spark, documents):
    assert rows(op7_ngram_join(spark, DATA), "doc_id", "n_shingles", "component_id") == sorted(brute.ngram_components(texts(documents)), key=repr)


def test_a_chain_of_near_copies_in_one_long_list(spark):
    """Each document links to its neighbours only, and all share most shingles: no pair may be lost."""
    words = [f"w{k}" for k in range(300)]
    made = []
    for i in range(60):
        own = list(words)
        for k in range(i):
            own[5 * k + 2] = f"x{k}"
        made.append((500 - i, " ".join(own)))
    docs = spark.createDataFrame(made, "doc_id long, text string")
    assert rows(ngram_components(docs), "doc_id", "n_shingles", "component_id") == sorted(brute.ngram_components(made), key=repr)


@pytest.mark.parametrize("meeting", [4096, 7], ids=["one block", "many blocks"])
def test_a_list_of_documents_that_do_not_link(spark, meeting):
    """Documents made of a few common passages share shingles with very many others and link with few: what is left in long lists is tested block by block."""
    rng = random.Random(5)
    passage = [" ".join(f"p{k}x{j}" for j in range(12)) for k in range(9)]
    made = [(i, " ".join(rng.sample(passage, 4))) for i in range(160)] + [(1000 + i, " ".join([*passage[:5], f"end{i}"])) for i in range(20)]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    assert rows(ngram_components(docs, meeting=meeting), "doc_id", "n_shingles", "component_id") == sorted(brute.ngram_components(made), key=repr)


def test_small_sets(spark):
    """Sizes around those at which sets begin to link, on both sides of the boundary."""
    made, word = [], [f"t{k}" for k in range(60)]
    for n in range(1, 45):
        made += [(100 * n, " ".join(word[:n])), (100 * n + 1, " ".join(word[:n]) + " end"), (100 * n + 2, "begin " + " ".join(word[:n]))]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    assert rows(ngram_components(docs), "doc_id", "n_shingles", "component_id") == sorted(brute.ngram_components(made), key=repr)


@pytest.mark.parametrize("links_a_task", [1 << 16, 7])
def test_components(spark, links_a_task):
    """A long chain, a star, a ring, pairs and repeated links, joined in one task and in many."""
    links = [(i, i + 1) for i in range(100, 160)] + [(900, 1000 + i) for i in range(40)] + [(2000 + i, 2000 + (i + 1) % 9) for i in range(9)] + [(7, 3), (3, 7), (5, 5), (-4, 3)]
    up = {x: x for p in links for x in p}
    for _ in links:
        for a, b in links:
            up[a] = up[b] = min(up[a], up[b])
    table = spark.createDataFrame(links, "u long, v long").repartition(11)
    got = {r.node: r.component for r in components(table, links_a_task).collect()}
    assert got == {x: r for x, r in up.items() if x != 5}
    assert components(table.where("1 = 0"), links_a_task).count() == 0


def test_maps_bound_the_difference():
    a, b = shingle_sets([b" ".join(b"w%d" % k for k in range(900)), b" ".join(b"w%d" % k for k in range(40, 300))])
    assert 0 < least_difference(parity_map(a), parity_map(b)) <= len(set(a.tolist()) ^ set(b.tolist()))
    assert least_difference(parity_map(a), parity_map(a)) == 0


def test_boundary_follows_cost():
    assert boundary(1.0, 80) < boundary(3.0, 80) < boundary(6.0, 80)


def test_large_ids_beside_null_ones(spark):
    """Ids that doubles can't hold, in one batch with a null id."""
    text = " ".join(f"w{k}" for k in range(80))
    made = [(2**60 + 1, text + " a"), (2**60 + 2, text + " b"), (None, text), (2**60 + 3, "x " + text)]
    docs = spark.createDataFrame(made, "doc_id long, text string").coalesce(1)
    assert rows(substring_dedup(docs), "doc_id", "n_words", "n_removed", "text") == sorted(brute.substring_dedup(made), key=repr)
    assert rows(ngram_components(docs), "doc_id", "n_shingles", "component_id") == sorted(brute.ngram_components(made), key=repr)
