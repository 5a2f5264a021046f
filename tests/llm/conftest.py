import random

import pytest

DATA = "/root/testdata/sf0.001"


def edge_rows():
    """(doc_id, text, source): nulls, empties, ties, repeats, long texts, odd white space."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("aeioubdgklmnrst") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    line = "This very line is repeated in many documents, word for word."
    passage, base = say(70), say(120)
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t\n\x0b ", None), (4, "one two", "b"), (5, "one two", "b"), (None, say(60), "a"), (None, None, None)]
    rows += [(10 + i, f"{say(40)}\n  {line.upper()}\x0b\n{say(30)}", "hot") for i in range(8)]
    rows += [(30 + i, base, "hot") for i in range(4)]
    for i in range(6):
        words = base.split()
        words[7 * i + 3] = f"change{i}"
        rows.append((40 + i, " ".join(words), "hot"))
    rows += [(60 + i, f"{say(25 + i)} {passage} {say(12)}", "b") for i in range(5)]
    rows += [(70, say(3000), "long"), (71, ("ab " * 4000).strip(), "long"), (72, "é" * 50 + "   😀 " + say(55), "c")]
    rows += [(73, base, "hot"), (73, base, "hot"), (74, say(55) + "\n" + say(5), None)]
    return rows


@pytest.fixture(scope="session")
def edge(spark):
    """The rows above with columns whose names the operators use inside."""
    wide = [(i, t, s, "xx", 7, 1, "k", 2.5) for i, t, s in edge_rows()]
    return spark.createDataFrame(wide, "doc_id long, text string, source string, lang string, n_chars long, n long, key string, score double").repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.where("1 = 0")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")
