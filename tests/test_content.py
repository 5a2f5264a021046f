import collections
import math
import random
import time

from pyspark.sql import functions as F

from docmill.functions.content import HOLDER_COST, LEAF_COST, LINK_COST, extract_main, main_blocks, main_text
from docmill.functions.html import EXTRACTORS, extract_chain
from docmill.operators.language import accuracy, detected, fit_languages

SAY = "The committee met on Tuesday to discuss what it had heard, and nobody was surprised by the outcome. "


def words(n, seed=0):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n))


def test_lists_of_links_and_named_parts_fall_away():
    links = "".join(f"<li><a href='/{k}'>Some other story number {k} of the day</a></li>" for k in range(20))
    page = f"<html><head><title>T</title><script>var x = '<p>no</p>'</script></head><body><div class='top menu'>{SAY}</div><ul>{links}</ul><div id='story'><h1>Head</h1><p>{SAY * 3}</p><div class='x sidebar y'>{SAY * 9}</div><p>{SAY * 2}<a href='/s'>with a link</a></p></div><div>{links}</div><aside>{SAY * 9}</aside><footer>{SAY}</footer>"
    got = main_blocks(page)
    assert got == ["Head", (SAY * 3).strip(), (SAY * 2 + "with a link").strip()]


def test_unclosed_tags_end_where_html_ends_them():
    body = "".join(f"<p><b>{words(30, k)}" for k in range(4))
    assert main_blocks(f"<body><article>{body}") == [words(30, k) for k in range(4)]
    table = "<table><tr><td>" + words(40, 1) + "<td>" + words(40, 2) + "<tr><td>" + words(40, 3) + "</table>"
    assert main_blocks(table) == [words(40, k) for k in (1, 2, 3)]
    items = "<ul><li>" + words(40, 1) + "<ul><li>" + words(40, 2) + "<li>" + words(40, 3) + "</ul><li>" + words(40, 4) + "</ul>"
    assert main_blocks(items) == [words(40, k) for k in (1, 2, 3, 4)]
    assert main_blocks(f"</div></p><p>{words(50)}</i></article> more {words(9, 2)}</b><p>{words(30, 3)}") == [f"{words(50)} more {words(9, 2)}", words(30, 3)]


def test_of_equal_parts_the_inner_one():
    one, two = "a" * (LEAF_COST + HOLDER_COST), "b" * (LEAF_COST + HOLDER_COST)
    assert main_blocks(f"<div><p>{one}</p><p>{two}</p></div>") == [one]
    assert main_blocks(f"<div><p>{one}</p><p>{two}b</p></div>") == [f"{two}b"]
    assert main_blocks(f"<div><p>{one}</p><p>{two}</p><p>{one}</p></div>") == [one, two, one]


def test_nested_articles_and_several_sections():
    inner = f"<article><p>{words(80, 1)}</p><article><p>{words(60, 2)}</p></article></article>"
    assert main_blocks(f"<main><div><a href='x'>{words(30)}</a></div>{inner}<section><p>{words(70, 3)}</p></section></main>") == [words(80, 1), words(60, 2), words(70, 3)]
    # what is worth less than the elements that hold it stays out
    assert main_blocks(f"<div>{inner}<div><div>few words here</div></div></div>") == [words(80, 1), words(60, 2)]


def test_text_between_blocks_entities_and_white_space():
    assert main_blocks(f"<div>{words(40)} &amp; a\n\t<i>b</i>c<br>d<p>{words(30, 1)}</p>tail {words(10, 2)}</div>") == [f"{words(40)} & a bc d", words(30, 1), f"tail {words(10, 2)}"]


def test_nothing_to_find():
    for page in (None, "", "   ", "<p>short</p>", "<nav>" + SAY * 20 + "</nav>", "<<<>>>", "<a href='/'>" + SAY * 5 + "</a>", "<!-- " + SAY + " -->"):
        assert extract_main(page) is None


def random_tree(rng, depth):
    """(tag, [children]) with strings as text and ('a', text) as links."""
    kids = []
    for _ in range(rng.randint(1, 4)):
        kind = rng.random()
        if depth and kind < 0.5:
            kids.append(random_tree(rng, depth - 1))
        elif kind < 0.65:
            kids.append(("a", words(rng.randint(1, 12), rng.random())))
        else:
            kids.append(words(rng.randint(1, 30), rng.random()))
    return (rng.choice(["div", "section", "blockquote", "article"]), kids)


def written(tree):
    if isinstance(tree, str):
        return tree
    return f"<{tree[0]}>{tree[1] if tree[0] == 'a' else ' '.join(map(written, tree[1]))}</{tree[0]}>"


def best_part(tree):
    """(weight, texts) of the best connected part, over all choices of branches of every element, by plain recursion."""

    def runs(kids):
        out, run, linked = [], [], 0
        for kid in [*kids, None]:
            if isinstance(kid, str) or kid and kid[0] == "a":
                run.append(kid if isinstance(kid, str) else kid[1])
                linked += 0 if isinstance(kid, str) else len("".join(kid[1].split()))
            else:
                if run:
                    text = " ".join(run)
                    out.append((len(text) - LINK_COST * linked - LEAF_COST, text))
                run, linked = [], 0
                if kid:
                    out.append(kid)
        return out

    candidates = []

    def value(node):
        total, texts = 0 if node[0] == "blockquote" else -HOLDER_COST, []
        for kid in runs(node[1]):
            w, t = kid if isinstance(kid[0], int) else value(kid)
            t = [t] if isinstance(t, str) else t
            if isinstance(kid[0], int):
                candidates.append((w, t))
            if w > 0:
                total, texts = total + w, texts + t
        candidates.append((total, texts))
        return total, texts

    value(tree)
    return max(c[0] for c in candidates), candidates


def test_random_trees_against_plain_recursion():
    rng = random.Random(3)
    for _ in range(150):
        tree = random_tree(rng, 4)
        most, candidates = best_part(tree)
        got = main_blocks(written(tree))
        assert got in [t for w, t in candidates if w == most] if most > 0 else got == []


def test_megabytes_in_linear_time():
    page = "<body><ul>" + "<li><a href='x'>y y y</a>" * 30_000 + "</ul><div>" + f"<p>{SAY}" * 30_000
    began = time.time()
    assert len(main_blocks(page)) == 30_000 and time.time() - began < 20


def test_columns_and_chain(spark):
    rows = spark.createDataFrame([(1, f"<div><p>{words(250)}</p></div>"), (2, None), (3, "")], "i int, html string")
    assert {r.i: r.t for r in rows.select("i", main_text(F.col("html")).alias("t")).collect()} == {1: words(250), 2: None, 3: None}
    assert rows.select("i", extract_chain(F.col("html"), ("main", "page"))["extraction_method"].alias("m")).where("i = 1").first().m == "main"
    assert list(EXTRACTORS)[-3:] == ["article", "main", "page"]


def naive_bayes(train, texts):
    grams = lambda t: [f" {t.lower()} "[k : k + 3] for k in range(len(t))] if t else []
    counts = collections.defaultdict(collections.Counter)
    for text, lang in train:
        counts[lang].update(grams(text))
    known, docs = set().union(*counts.values()), collections.Counter(x for _, x in train)
    out = []
    for t in texts:
        score = {x: math.log(docs[x] / len(train)) + sum(math.log((counts[x][g] + 1) / (sum(counts[x].values()) + len(known))) for g in grams(t) if g in known) for x in counts}
        best = min(score, key=lambda x: (-round(score[x], 3), x))
        out.append((best, round(score[best], 3)))
    return out


def test_language_profiles_against_plain_python(spark):
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 3000").limit(80).collect()]
    docs += [(9001, None, "fr"), (9002, "", "de"), (9003, "Ünïcode 😀 ẞ", None), (9004, "a", "en"), (9005, "😀😀😀😀", "xx")]
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3)
    model = fit_languages(table.where("doc_id % 3 > 0"))
    want = naive_bayes([(t, x) for i, t, x in docs if i % 3 > 0 and x], [t for _, t, _ in docs])
    got = {r.doc_id: (r.language, r.score) for r in detected(table, model).collect()}
    assert model.languages == tuple(sorted({x for i, _, x in docs if i % 3 > 0 and x})) and len(got) == len(docs)
    for (i, _, _), (language, score) in zip(docs, want, strict=True):
        assert got[i][0] == language and abs(got[i][1] - score) < 0.002
    few = fit_languages(table, most=50)
    assert few.profiles.count() == 50


def test_language_without_labels(spark):
    table = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in detected(table, fit_languages(table)).collect()] == [(1, "unknown", 0.0)]
    assert detected(table.where("1 = 0"), fit_languages(table)).count() == 0


def test_language_of_texts_not_learnt_from(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rest = docs.where("doc_id % 5 = 0")
    found = accuracy(rest.select("doc_id", "lang").join(detected(rest, fit_languages(docs.where("doc_id % 5 <> 0"))), "doc_id"))
    assert found.where("lang is null").first()["share"] >= 0.95 and found.where("share < 0.9").isEmpty()
