from __future__ import annotations

import random
import re

import pytest
import xxhash

from martlet.llm import simhash
from tests.llm.conftest import prose


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def plain_components(prints, distance=2):
    """The smallest index that each index reaches, by comparing all pairs."""
    label = list(range(len(prints)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                a, b = sorted((find(i), find(j)))
                label[b] = a
    return [find(i) for i in range(len(prints))]


def test_fingerprints_and_components_equal_all_pairs(spark, documents):
    rng, texts = random.Random(5), []
    for seed in range(40):
        words = prose(seed, rng.choice([3, 40, 900, 2500])).split(" ")
        texts.append(" ".join(words))
        for _ in range(3):  # one word edited: few bits move in a long text
            words = list(words)
            words[rng.randrange(len(words))] = rng.choice(["Edit", "ÄÖ", "x"])
            texts.append("\t".join(words))
    texts += ["", " \n", "one", "ONE two", "One TWO", "É é", "a\x1cb c\x85d e"]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(documents(list(enumerate(texts)))).collect()}
    prints = [plain_fingerprint(t) for t in texts]
    assert [got[i]["fingerprint"] for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert [got[i]["component_id"] for i in range(len(texts))] == plain_components(prints)
    assert len(set(plain_components(prints))) < len(set(prints))  # some links join different fingerprints


@pytest.mark.parametrize("few", [2, 5, 64])
def test_crowded_variants_lose_no_link(spark, few):
    from martlet.llm.components import components

    rng, prints = random.Random(8), set()
    for _ in range(6):  # clouds of fingerprints around a middle, with crowded and with rare variants
        middle = rng.getrandbits(64)
        for _ in range(60):
            prints.add(middle ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))))
    prints |= {0, 1, (1 << 63), (1 << 63) | 1, (1 << 64) - 1, (1 << 64) - 1 ^ (3 << 31)}
    prints = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    found = components(simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"), few))
    label = {r["node"]: r["label"] for r in found.collect()}
    expected = plain_components([p & (1 << 64) - 1 for p in prints])
    assert [label.get(p, p) for p in prints] == [prints[i] for i in expected]


def test_odd_rows(spark, documents, edge, nothing):
    assert simhash.near_duplicates(nothing).collect() == []
    rows = simhash.near_duplicates(edge).collect()
    assert len(rows) == edge.count()
    by_id = {}
    for r in rows:
        by_id.setdefault(r["doc_id"], []).append((r["fingerprint"], r["component_id"]))
    assert by_id[1] == by_id[2] == by_id[6] == [("0" * 16, 1)]
    assert len(by_id[3]) == 2 and set(by_id[3]) == set(by_id[4])
    assert by_id[None][0][1] is None
    assert by_id[7] == [(f"{plain_fingerprint('Hi.'):016x}", 7)]
    # One id with two texts: a fingerprint each; a copy without an id gets the id of its component.
    twice = simhash.near_duplicates(documents([(1, "a b c d"), (1, "q r s t"), (None, "q r s t"), (5, "A B C D")])).collect()
    prints = {t: f"{plain_fingerprint(t):016x}" for t in ("a b c d", "q r s t")}
    assert sorted((r["doc_id"] or -1, r["fingerprint"], r["component_id"]) for r in twice) == sorted(
        [(1, prints["a b c d"], 1), (1, prints["q r s t"], 1), (-1, prints["q r s t"], 1), (5, prints["a b c d"], 1)]
    )


def test_a_class_of_most_rows_is_not_joined_by_key(spark, documents):
    texts = [(i, "same text in every row") for i in range(3000)] + [(5000 + i, prose(i, 30)) for i in range(20)]
    got = simhash.near_duplicates(documents(texts))
    assert got.filter("component_id = 0").count() == 3000
    assert got.filter("component_id = doc_id").count() == 21


def test_native(spark, documents):
    plan = simhash.fingerprints(documents([(1, "a b c")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_patterns_are_never_sent_to_the_driver(spark):
    rng = random.Random(9)
    middle = rng.getrandbits(48)
    prints = sorted({middle ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(i)})  # crowded variants
    found = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"), few=4)
    found.collect()
    joins = [line for line in found._jdf.queryExecution().executedPlan().toString().split("\n") if "Join" in line]
    assert joins and not any("Broadcast" in line for line in joins)


def test_a_table_is_broadcast_by_its_counted_rows(spark):
    from martlet.llm.common import join_counted

    rows, some = spark.range(50), spark.range(10).selectExpr("id", "2 * id AS twice")
    for most, sent in ((10, True), (9, False)):
        joined = join_counted(rows, some, ["id"], most)
        assert sorted(map(tuple, joined.collect())) == [(i, 2 * i) for i in range(10)]
        assert ("BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()) == sent
