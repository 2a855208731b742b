from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from martlet.llm import vector_codes
from martlet.llm.queries import QUERIES, SQL
from tools.verify import compare, duck

SCHEMA = "vec_id long, embedding array<float>, label int, code string, place int, packed string, error long"


@pytest.fixture
def vectors(spark):
    return lambda rows: spark.createDataFrame([(*r, "c", 1, "p", 5) for r in rows], SCHEMA)


def plain(rows):
    """{vec_id: (code, error)} and the codebooks, entry by entry."""
    whole = [(i, [math.floor(4096 * float(np.float32(x))) for x in v]) for i, v, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    w = len(whole[0][1]) // 8
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(v, p) for _, v in sorted(whole)[:16]] for p in range(8)]

    def nearest(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(book))

    for _ in range(6):
        for p in range(8):
            members = {}
            for _, v in whole:
                members.setdefault(nearest(cut(v, p), books[p])[1], []).append(cut(v, p))
            books[p] = [[sum(c) // len(members[k]) for c in zip(*members[k])] if k in members else e for k, e in enumerate(books[p])]
    out = {}
    for i, v in whole:
        found = [nearest(cut(v, p), books[p]) for p in range(8)]
        out[i] = ("".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found))
    return out, books


def test_walk_equals_all_distances():
    rng = np.random.default_rng(4)
    for leaves in (1, 3, 50, 1 << 16):
        for spread in (2, 5, 4000):
            parts = np.unique(rng.integers(-spread, spread, (300, 4)), axis=0)
            entries = rng.integers(-spread, spread, (7, 4))
            every = ((parts[:, None] - entries[None]) ** 2).sum(2)
            code, error = vector_codes.walk(parts, entries, leaves)
            assert (code == every.argmin(1)).all() and (error == every.min(1)).all()


def test_packed_parts_sort_like_their_numbers():
    rows = np.array([[-5, 3], [-5, -9], [0, 0], [7, -1], [-(1 << 26), 1 << 26]])
    order = sorted(range(5), key=rows.tolist().__getitem__)
    made = vector_codes.packed(rows)
    assert sorted(range(5), key=made.__getitem__) == order


def test_equals_plain_version(vectors):
    rng = random.Random(2)
    values = [round(rng.gauss(0, 0.3), 1) for _ in range(6)]  # few values: long common prefixes, ties and equal parts
    rows = [(i, [rng.choice(values) for _ in range(24)], rng.choice([0, 1, None])) for i in range(150)]
    rows += [(900, None, 1), (901, [None] + [0.5] * 23, 1), (902, [float("nan")] * 24, 1), (903, [float("inf")] * 24, 1), (-4, [0.25] * 24, 2)]
    expected, books = plain(rows)
    coded, found = vector_codes.compress(vectors(rows).repartition(5))
    got = {r["vec_id"]: r for r in vector_codes.with_label_errors(coded).collect()}
    assert {i: (r["code"], r["error"]) for i, r in got.items()} == expected
    assert found.tolist() == books
    assert vector_codes.digest(found) == hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    for label in (0, 1, 2, None):
        own = [i for i, v, lab in rows if lab == label and i in expected]
        assert {got[i]["label_error"] for i in own} == {sum(expected[i][1] for i in own)}


def test_odd_rows(vectors):
    empty, books = vector_codes.compress(vectors([]))
    assert empty.collect() == [] and books is None and vector_codes.with_label_errors(empty).collect() == []
    assert vector_codes.compress(vectors([(1, None, 1), (2, [], 1), (3, [1.0] * 7, 1)]))[1] is None
    few = [(5, [0.5] * 8, None), (5, [0.5] * 8, None), (None, [1.0] * 8, 3), (6, [1.0] * 16, 3), (7, [3e38] * 8, 3)]
    coded, books = vector_codes.compress(vectors(few))
    rows = vector_codes.with_label_errors(coded).collect()
    assert sorted((r["vec_id"] or 0) for r in rows) == [0, 5, 5, 7]  # another length goes, a huge component saturates
    assert books.shape == (8, 4, 1)


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert compare(QUERIES["op13_vector_codes"](spark, sf), duck(sf), SQL["op13_vector_codes"]) is None
