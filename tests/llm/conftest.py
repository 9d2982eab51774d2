import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def made_docs(seed=3, n=120):
    """Documents with a hot source, exact and near copies, shared lines, and odd texts: null, empty, blank, symbols, very long."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(r.randint(2, 9))) for _ in range(400)]
    line = lambda k: " ".join(r.choice(words) for _ in range(k)).capitalize() + "."
    shared = [line(9) for _ in range(3)]
    rows = []
    for i in range(n):
        lines = [line(r.randint(3, 25)) for _ in range(r.randint(1, 8))]
        if i % 4 == 0:
            lines.insert(r.randint(0, len(lines)), r.choice(["", "  ", "\t"]) + shared[0].upper() + " ")
        if i % 9 == 0:
            lines.append(shared[1])
        rows.append((i, "\n".join(lines)))
    for i in range(n, n + 30):
        rows.append((i, rows[7][1]))
    for i in range(n + 30, n + 45):
        w = (rows[11][1] + " " + rows[12][1] + " " + rows[13][1]).split(" ")
        w[r.randrange(len(w))] = r.choice(words)
        rows.append((i, " ".join(w)))
    rows += [(n + 50, None), (n + 51, ""), (n + 52, " \n\t\n"), (n + 53, "### $$$ !!!"), (n + 54, "one"), (n + 55, " ".join(words * 60)), (n + 56, "x" * 50_000), (n + 57, "日本語のテキスト，全角　空白"), (n + 58, "Ünï cödé\x85 \x1fcontrol"), (n + 59, "one"), (None, "a document without an id, with some words of its own")]
    rows.append(rows[5])
    return [(i, t, r.choice(["en", "de", None]), "hot" if r.random() < 0.4 else f"s{r.randint(0, 5)}" if r.random() < 0.9 else None, None if t is None else len(t)) for i, t in rows]


@pytest.fixture(scope="session")
def rows():
    return made_docs()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
