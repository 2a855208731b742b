from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from martlet.llm import byte_cnn, ftrl, isolation_forest
from martlet.llm.common import held_out
from tests.llm.conftest import prose


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_counts_match_a_plain_version():
    texts = [None, "", "a", "a a a a", "x y z\nx y z\n\n", "é|è é|è é|è q", "a b a b\x1c", "w " * 5000, prose(4, 300)]
    for text in texts:
        assert isolation_forest.counts_of(text)[:5] == plain_counts(text)


def test_forest_finds_what_is_odd():
    rng = np.random.default_rng(0)
    rows = np.concatenate([rng.normal(0, 1, (500, 3)), rng.normal(12, 0.1, (5, 3))])
    scores = isolation_forest.Forest.fit(rows).score(rows)
    assert scores[500:].min() > np.quantile(scores[:500], 0.99)


def test_quality_rules_on_odd_rows(spark, edge, nothing, labels):
    judged = isolation_forest.judge_documents(edge, labels([])).collect()
    assert len(judged) == 10
    by_id = {r.doc_id: r for r in judged}
    assert not by_id[1].kept and not by_id[2].kept and by_id[2].counts.n_words == 0
    assert by_id[3].kept and by_id[5].counts.n_words == 40_000 and by_id[None].kept
    kept = isolation_forest.keep_documents(edge, labels([(3, 1, 0), (3, None, 0), (99, 0, 0)]))
    assert kept.columns == edge.columns and kept.count() == 6
    assert isolation_forest.keep_documents(nothing, labels([])).count() == 0


def test_forest_threshold_comes_from_labels(spark, documents, labels):
    good = [(i, prose(i, 120)) for i in range(250)]
    bad = [(1000 + i, " ".join(w.upper() + "###" for w in prose(2000 + i, 120).split())) for i in range(8)]
    known = labels([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad])
    kept = {r.doc_id for r in isolation_forest.keep_documents(documents(good + bad), known).collect()}
    assert kept == {r.doc_id for r in isolation_forest.judge_documents(documents(good + bad), known).filter("kept").collect()}
    assert len([i for i in kept if i < 1000]) >= 247 and not [i for i in kept if i >= 1000]


def test_held_out_is_the_checksum_of_the_id(spark):
    got = spark.range(200).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in got)


def test_ftrl_learns_and_ignores_held_out_labels(spark, documents, labels, edge, nothing):
    good = [(i, prose(i, 60)) for i in range(80)]
    bad = [(1000 + i, " ".join(w + "###" for w in prose(2000 + i, 60).split())) for i in range(80)]
    docs = documents(good + bad)
    out = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, _ in good + bad}
    known = labels([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad])
    flipped = labels([(i, 1 - out[i], 0) for i, _ in good] + [(i, int(out[i]), 0) for i, _ in bad])
    weights = ftrl.fit(docs, known)
    assert np.array_equal(weights, ftrl.fit(docs, flipped))
    rows = ftrl.score_documents(docs.select("doc_id", "text"), weights).collect()
    assert all((r.score > 0.5) == (r.doc_id < 1000) for r in rows)
    odd = ftrl.score_documents(edge.select("doc_id", "text"), weights).collect()
    assert len(odd) == 10 and all(0 <= r.score <= 1 for r in odd)
    assert len({r.score for r in odd if not (r.text or "").strip()}) == 1
    assert not ftrl.fit(nothing, labels([])).any() and ftrl.score_documents(nothing, weights).count() == 0


def test_ftrl_score_is_the_sparse_product(spark):
    place, value = ftrl.features("one two two", ftrl._Words())
    w = np.zeros(ftrl.DIMENSIONS, np.float32)
    w[place] = np.arange(len(place))
    df = spark.createDataFrame([("one two two",)], "text string")
    assert abs(ftrl.score_documents(df, w).first().score - 1 / (1 + np.exp(-(np.arange(len(place)) @ value)))) < 1e-9


def test_network_tables_give_the_responses_of_the_filters():
    net = byte_cnn.Network(["a", "b"])
    x = byte_cnn.windows(prose(5, 90).encode())
    _, pooled = net._pooled(x)
    hidden = np.maximum(np.concatenate([pooled[w][1] for w in byte_cnn.WIDTHS], axis=1), 0)
    logits = hidden @ net.p["out"] + net.p["out_bias"]
    want = logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))
    assert np.allclose(net.log_probabilities(x, net.tables()), want, atol=1e-4)


def test_windows_see_every_run_of_bytes():
    data = bytes(i % 251 for i in range(1000))
    seen = {w[i : i + 4].tobytes() for w in byte_cnn.windows(data) for i in range(byte_cnn.WINDOW - 3)}
    assert {byte_cnn.CLASS[np.frombuffer(data[i : i + 4], np.uint8)].tobytes() for i in range(997)} <= seen


def test_language_of_whole_texts(spark, documents, edge, nothing):
    other = lambda s, n: prose(s, n).translate(str.maketrans("aeiou", "öäüéè"))
    docs = documents([(i, prose(i, 60), "en") for i in range(60)] + [(100 + i, other(i, 60), "xx") for i in range(60)])
    network = byte_cnn.fit(docs)
    rows = byte_cnn.identify(docs.select("doc_id", "text"), network).collect()
    assert sum(r.lang_pred == ("en" if r.doc_id < 100 else "xx") for r in rows) >= 118
    odd = byte_cnn.identify(edge.select("doc_id", "text"), network).collect()
    assert {r.doc_id for r in odd if r.lang_pred == "und"} == {1, 2, 6} and all(0 <= r.score <= 1 for r in odd)
    digits = byte_cnn.identify(documents([(1, "123 ++")]).select("text"), network).first()
    assert (digits.lang_pred, digits.score) == ("und", 0.0)
    assert byte_cnn.fit(nothing) is None and byte_cnn.identify(edge, None).filter("lang_pred <> 'und'").count() == 0
