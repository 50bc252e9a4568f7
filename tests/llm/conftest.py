import random

import pytest

SCHEMA = "doc_id long, source string, text string, n_words string, kept int, tk string, host string, size string, taken string"


def _text(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" + rng.choice(["", "", ",", ".", "é"]) for _ in range(n)]


def make_rows(seed=7, n=160):
    """(doc_id, source, text): copies, near copies, shared passages and lines, nulls, empty and long texts."""
    rng = random.Random(seed)
    passage, line = " ".join(_text(rng, 40)), "All Rights reserved 1999, see the licence text of this page"
    base = " ".join(_text(rng, 120))
    rows = []
    for i in range(n):
        w = _text(rng, rng.choice([3, 20, 60, 90, 150]))
        for k in range(9, len(w), 12):
            w[k] += "\n"
        kind = i % 10
        text = " ".join(w).replace("\n ", "\n")
        if kind == 1 and rows:
            text = rows[rng.randrange(len(rows))][2]
        elif kind == 2:
            near = base.split()
            for _ in range(rng.randrange(4)):
                near[rng.randrange(len(near))] = "changed"
            text = " ".join(near)
        elif kind == 3:
            text = f"{line}\n{text}\n{line}"
        elif kind == 4:
            text = f"{text} {passage} {text[:50]}"
        elif kind == 5:
            text = "\n".join(["first line of a block", "second line of a block", passage, "fourth", text])
        elif kind == 6:
            text = " ".join(w[:4] * 20)
        rows.append((i, None if i % 17 == 0 else f"s{i % 3 if i % 2 else 0}", text))
    rows += [
        (n, "s0", None), (n + 1, "s1", ""), (n + 2, "s1", " \t\n "), (n + 3, None, None),
        (n + 4, "s2", " ".join(_text(rng, 30_000))), (n + 5, "ünï", "one"), (n + 6, "s0", "\n" * 500),
        (n + 7, "s0", base.upper()), (n + 8, "s9", "x " * 200 + "\u0001 \u0000 end"),
    ]
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows with extra columns whose names the operators use themselves."""
    full = [(d, s, t, "a", 1, "b", "c", "d", "e") for d, s, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def narrow(docs):
    return docs.select("doc_id", "source", "text")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
