from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from martlet.llm import ranked_search
from martlet.llm.queries import QUERIES, SQL
from tests.llm.conftest import prose
from tools.verify import compare, duck


def plain_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_ranks(docs, items):
    """{item: [(doc_id, score), ...]} by scoring every document for every item."""
    bags = [(i, plain_terms(t)) for i, t in docs]
    bags = [(i, Counter(t), len(t)) for i, t in bags if t]
    total, words = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    out = {}
    for item, text in set(items):
        scored = []
        for doc, bag, n in bags:
            m = 25 + 75 * n * total // words
            score = sum(
                math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (1_000_000_000 * bag[t] // (1000 * bag[t] + 8 * m)) for t in plain_terms(text) if t in bag
            )
            if score > 0:
                scored.append((doc, score))
        scored.sort(key=lambda r: (-r[1], r[0] is None, r[0] or 0))
        if scored:
            out.setdefault(item, []).append(scored[:10])
    return out


def ranks(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        out.setdefault(r["item_id"], []).append((r["doc_id"], r["score"]))
    return out


@pytest.mark.parametrize("postings", [ranked_search.POSTINGS, 40])
def test_equals_scoring_everything(documents, benchmark, postings, monkeypatch):
    monkeypatch.setattr(ranked_search, "CELLS", 500)  # several blocks a batch
    rng = random.Random(3)
    docs = [(i, prose(i % 60, rng.choice([5, 30, 80]))) for i in range(200)]
    docs += [(300, "Ka-LO,mi_ter\x00san"), (301, "ÉÈ ka lo 12ab"), (302, ""), (303, None), (304, "ka " * 5000)]
    items = [(i, prose(i, 20)) for i in range(12)] + [(50, "ka ka ka lo"), (51, ""), (52, None), (53, "absent"), (54, "É ÉÈ ab 12AB")]
    got = ranks(ranked_search.ranked_documents(documents(docs), benchmark(items), postings))
    expected = plain_ranks(docs, items)
    assert got == {item: lists[0] for item, lists in expected.items()}
    assert 53 not in got and 54 in got and got[50][0][1] > 0


def test_ties_repeats_and_missing_ids(documents, benchmark):
    docs = [(None, "alpha beta"), (9, "alpha beta"), (2, "alpha beta"), (2, "alpha beta"), (4, "alpha"), (4, "gamma delta")]
    got = ranks(ranked_search.ranked_documents(documents(docs), benchmark([(1, "beta"), (1, "beta"), (None, "gamma")])))
    assert [d for d, _ in got[1]] == [2, 2, 9, None]
    assert len({s for _, s in got[1]}) == 1
    assert [d for d, _ in got[None]] == [4]
    twice = ranked_search.ranked_documents(documents(docs), benchmark([(1, "beta"), (1, "gamma")])).collect()
    assert sorted(r["doc_id"] for r in twice if r["rank"] == 1) == [2, 4]


def test_odd_rows(edge, nothing, documents, benchmark):
    assert ranked_search.ranked_documents(nothing, benchmark([(1, "ka")])).collect() == []
    assert ranked_search.ranked_documents(edge, benchmark([])).collect() == []
    assert ranked_search.ranked_documents(edge, edge.selectExpr("doc_id as item_id", "text", "n as score", "doc_id")).count() > 0


def test_more_documents_than_a_heap_holds(documents, benchmark):
    docs = [(i, "hot " * (1 + i % 7) + f"w{i}") for i in range(4000)]
    got = ranks(ranked_search.ranked_documents(documents(docs).repartition(7), benchmark([(0, "hot")])))
    assert got == {item: lists[0] for item, lists in plain_ranks(docs, [(0, "hot")]).items()}


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert compare(QUERIES["op12_ranked_search"](spark, sf), duck(sf), SQL["op12_ranked_search"]) is None
