import random

import pytest


def prose(rng: random.Random, words: int) -> str:
    parts = ["the", "and", "of", "ter", "ing", "ona", "eri", "sto", "lle", "qua", "É", "zu"]
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(words))


@pytest.fixture(scope="session")
def docs_rows():
    """Documents with copies, near copies, odd texts, null fields, a hot source and repeated rows."""
    rng = random.Random(3)
    rows = []
    for i in range(60):
        rows.append((i, prose(rng, rng.randint(1, 120)), ["en", "de", None][i % 3], "hot" if i % 3 else f"s{i % 4}"))
    base = prose(rng, 100).split()
    for i in range(60, 80):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
        rows.append((i, " ".join(w), "en", "hot"))
    rows += [(80, rows[0][1], "en", None), (81, rows[0][1].upper(), None, "x"), (82, "", "en", "x"), (83, None, "de", None), (84, " \t\n ", "en", "x"), (85, "123 ... !!", "en", "y"), (86, "a b c", "en", "y"), (87, "A  b\tc", "en", "y")]
    rows += [(None, "no id here at all", "en", "x"), (None, None, None, None), rows[5], rows[5], (88, "word " * 6000, "de", "long"), (89, "😀 é" * 400 + " Ω", "en", "z")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, docs_rows):
    """With columns whose names the operators use themselves."""
    rows = [(*r, 1, 2.0, "h", [1]) for r in docs_rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size int, score double, h string, tokens array<int>")


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("doc_id = -1")
