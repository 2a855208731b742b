from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, spans string, ids string, counts string, doc long, n int, key string, word string, line string, sid long, label int"


def prose(seed: int, n: int) -> str:
    """Words that hardly ever repeat from one seed to the next, with a full stop and a line break now and then."""
    rng, out = random.Random(seed), []
    for i in range(n):
        word = "".join(rng.choice(["ka", "lo", "mi", "ter", "san", "vu", "pre", "qui", "don", "ze"]) for _ in range(rng.randint(1, 4)))
        out.append(word + (".\n" if i % 17 == 16 else ""))
    return " ".join(out).replace("\n ", "\n")


def row(doc_id, text, lang="en"):
    return (doc_id, text, lang, "s", None if text is None else len(text), True, 0.5, "x", "y", "z", 7, 8, "k", "w", "l", 9, 1)


@pytest.fixture
def documents(spark):
    """Build documents with columns whose names the operators use themselves."""
    return lambda rows: spark.createDataFrame([row(*r) for r in rows], SCHEMA)


@pytest.fixture
def edge(documents):
    """Null ids and texts, empty, blank and very long texts, copies and repeated rows."""
    text = prose(1, 80)
    return documents(
        [(1, ""), (2, None), (None, prose(2, 70)), (3, text), (3, text), (4, text), (5, prose(3, 40_000)), (6, " \n\n\t "), (7, "Hi."), (8, text + " end", None)]
    )


@pytest.fixture
def nothing(documents):
    return documents([])


@pytest.fixture
def labels(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture
def benchmark(spark):
    return lambda rows: spark.createDataFrame(rows, "item_id long, text string")
