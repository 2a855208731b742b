from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.ml.evaluation import RankingEvaluator
from pyspark.sql import functions as F

from martlet.operators import interactions as I
from martlet.operators import recommender as R
from martlet.operators import similarity as S


def test_index_by_frequency_then_text(frame):
    df = frame([("b",), ("b",), ("10",), ("9",), ("a",), ("a",)], "id string")
    assert {r.id: r.i for r in I.index_ids(df, "id", "i").collect()} == {"a": 0, "b": 1, "10": 2, "9": 3}


def test_ranking_metrics_by_hand(frame):
    actual = frame([(1, 10), (1, 11), (1, 10), (2, 20)], "userId int, itemId int")
    predicted = frame(
        [(1, 10, 1), (1, 99, 2), (1, 11, 3), (2, 98, 1), (2, 20, 2), (3, 1, 1)], "userId int, itemId int, rank int"
    )
    got = {r.k: r for r in R.ranking_metrics(actual, predicted, [1, 5]).collect()}
    assert got[1].map == pytest.approx((1 / 2 + 0) / 2) and got[1].users == 2
    assert got[5].map == pytest.approx(((1 + 2 / 3) / 2 + 1 / 2) / 2)
    ideal = 1 / math.log(2) + 1 / math.log(3)
    first = (1 / math.log(2) + 1 / math.log(4)) / ideal
    second = (1 / math.log(3)) / (1 / math.log(2))
    assert got[5].ndcg == pytest.approx((first + second) / 2)


def test_ranking_metrics_agree_with_the_evaluator(spark):
    rng = np.random.default_rng(4)
    met = [(u, int(i)) for u in range(30) for i in rng.integers(0, 40, rng.integers(1, 15))]
    guessed = [(u, int(i), n + 1) for u in range(30) for n, i in enumerate(rng.permutation(40)[:10])]
    actual = spark.createDataFrame(met, "userId int, itemId int")
    predicted = spark.createDataFrame(guessed, "userId int, itemId int, rank int")
    frame = R.ranking_frame(actual, predicted)
    for r in R.ranking_metrics(actual, predicted).collect():
        cut = frame.withColumn("p", F.slice("predicted", 1, r.k))
        score = lambda m: RankingEvaluator(metricName=m, labelCol="actual", predictionCol="p", k=r.k).evaluate(cut)  # noqa: B023, E731
        assert r.map == pytest.approx(score("meanAveragePrecision"))
        assert r.ndcg == pytest.approx(score("ndcgAtK"))


def test_random_split_is_a_partition_and_repeatable(frame):
    df = frame([(i, i % 7) for i in range(2000)], "userId int, itemId int")
    train, test = I.random_split(df)
    assert train.count() + test.count() == 2000 and train.intersect(test).count() == 0
    assert 0.75 < train.count() / 2000 < 0.85
    assert I.random_split(df.repartition(13))[0].exceptAll(train).count() == 0


def test_time_split_respects_order_and_size(frame):
    df = frame([(i // 10, i) for i in range(103)], "ts int, id int")
    parts = I.time_split(df, "ts", 0.2, "id").collect()
    assert len(parts) == 103
    train = [r.id for r in parts if r.split == "train"]
    assert sorted(train) == list(range(82))


def test_time_split_on_a_boundary_and_at_the_ends(frame):
    df = frame([(i // 10, i) for i in range(100)], "ts int, id int")
    train = lambda ratio: I.time_split(df, "ts", ratio, "id").filter("split = 'train'").count()
    assert (train(0.2), train(0.0), train(1.0)) == (80, 100, 0)


def test_random_split_stats(frame):
    df = frame([(i % 90, i % 7) for i in range(2000)], "userId int, itemId int").distinct()
    train, test = I.random_split(df)
    r = I.random_split_stats(df).first()
    assert (r.train_size, r.test_size) == (train.count(), test.count())
    common = train.select("userId").intersect(test.select("userId")).count()
    assert r.common_users == common
    assert r.user_overlap_percentage == pytest.approx(100 * common / test.select("userId").distinct().count())


def test_cold_start_comparison_is_a_choice(frame):
    df = frame([(1,), (1,), (1,), (2,)], "u int")
    cold = lambda inclusive: {r.u for r in I.cold_start(df, "u", 3, inclusive).filter("is_cold").collect()}
    assert cold(False) == {2} and cold(True) == {1, 2}


def test_unknown_ids(frame):
    recs = frame([(0, 0, 1.0), (0, 5, 0.5)], "userId int, itemId int, score double")
    users, items = frame([("u", 0)], "customer_id string, userId int"), frame([("p", 0)], "product_id string, itemId int")
    assert {r.product_id for r in R.map_ids(recs, users, items).collect()} == {"p", "Unknown"}


def test_als_recommends_for_every_user(frame):
    rows = [(u, i, 1.0) for u in range(12) for i in range(12) if (u + i) % 3 == 0]
    model = R.fit_als(frame(rows, "userId int, itemId int, rating double"), rank=3, maxIter=3)
    recs = R.explode_recs(R.recommend(model, 4))
    assert recs.groupBy("userId").count().filter("count <> 4").count() == 0
    assert {r["rank"] for r in recs.collect()} == {1, 2, 3, 4}


def test_searches_report_every_trial(frame):
    rows = [(u, i, float((u * i) % 4 + 1)) for u in range(10) for i in range(10)]
    df = frame(rows, "userId int, itemId int, rating double")
    _, grid = R.grid_search(df, {"rank": [2, 3]}, folds=2, maxIter=2)
    assert grid.count() == 2 and "rmse" in grid.columns
    configs = R.random_configurations(R.SEARCH_SPACE, 50, 1)
    assert all(5 <= c["rank"] < 200 and 0.001 <= c["regParam"] <= 10 and 5 <= c["maxIter"] < 30 for c in configs)
    assert configs == R.random_configurations(R.SEARCH_SPACE, 50, 1)


def _brute_force(vectors, n):
    ids = sorted(vectors)
    m = np.array([vectors[i] for i in ids], dtype=float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    sims = m @ m.T
    out = {}
    for a, i in enumerate(ids):
        order = sorted((b for b in range(len(ids)) if b != a), key=lambda b: (-round(sims[a, b], 9), ids[b]))
        out[i] = [(ids[b], round(sims[a, b], 6)) for b in order[:n]]
    return out


@pytest.mark.parametrize("max_pivots,block", [(1024, 4096), (3, 16), (1, 7)])
def test_similar_items_exact_with_many_copies(spark, max_pivots, block):
    rng = np.random.default_rng(0)
    vectors = {i: np.round(rng.normal(size=6) + 3 * np.eye(6)[i % 4], 3).tolist() for i in range(120)}
    for i in range(120, 180):  # a third of all rows are copies of one vector
        vectors[i] = vectors[5]
    df = spark.createDataFrame(list(vectors.items()), "id int, features array<double>")
    out = S.similar_items(df, 8, max_pivots=max_pivots, block=block).collect()
    got: dict = {}
    for r in sorted(out, key=lambda r: (r.item, r["rank"])):
        got.setdefault(r.item, []).append((r.similar, round(r.similarity, 6)))
    want = _brute_force(vectors, 8)
    assert got.keys() == want.keys()
    for i in want:
        assert [s for _, s in got[i]] == pytest.approx([s for _, s in want[i]], abs=2e-6)
        assert [x for x, _ in got[i]] == [x for x, _ in want[i]]


def test_similar_items_skips_zero_vectors(frame):
    df = frame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 1.0])], "id int, features array<double>")
    assert {(r.item, r.similar) for r in S.similar_items(df, 5).collect()} == {(2, 3), (3, 2)}
    assert [r.similar for r in S.similar_to(df, 2).collect()] == [3]


def test_time_split_keeps_rows_without_a_time(frame):
    rows = [(1, None), (2, "2024-01-01 00:00:00"), (3, "2024-01-02 00:00:00"), (4, "2024-01-03 00:00:00")]
    df = frame(rows, "id int, at string").withColumn("at", F.to_timestamp_ntz("at"))
    for share, train in ((0.5, {1, 2}), (0.9, set()), (0.0, {1, 2, 3, 4}), (0.75, {1})):
        got = I.time_split(df, "at", share, "id").collect()
        assert len(got) == 4 and {r.id for r in got if r.split == "train"} == train


def _clouds(frame, clouds=12, members=40, dims=16, copies=3):
    rng = np.random.default_rng(7)
    middles = rng.normal(size=(clouds, dims))
    rows = [(int(c * members + i), (middles[c] + 0.15 * rng.normal(size=dims)).tolist()) for c in range(clouds) for i in range(members)]
    rows += [(10_000 + i, rows[0][1]) for i in range(copies)] + [(20_000, [0.0] * dims), (20_001, None)]
    return frame(rows, "id long, features array<double>")


def test_the_index_finds_what_it_promises_from_few_pairs(frame):
    items = _clouds(frame)
    exact = {}
    for r in S.similar_items(items, 5).collect():
        exact.setdefault(r.item, {})[r.similar] = r.similarity
    found, facts = S.indexed_similar_items(items, 5, recall=0.95, judged=128)
    got = {}
    for r in found.collect():
        got.setdefault(r.item, {})[r.similar] = r.similarity
    assert set(got) == set(exact) and all(len(v) == 5 for v in got.values())
    hits = sum(s in exact[i] for i, near in got.items() for s in near)
    assert hits >= 0.9 * sum(map(len, exact.values()))
    assert all(abs(exact[i][s] - x) < 1e-9 for i, near in got.items() for s, x in near.items() if s in exact[i])
    assert 0 < facts["share_of_pairs"] < 0.35 and facts["probes"] < facts["cells"]


def test_all_cells_give_the_exact_answer(frame):
    items = _clouds(frame, clouds=4, members=15)
    found, facts = S.indexed_similar_items(items, 4, recall=1.0, judged=10_000)
    key = lambda r: (r.item, r["rank"], r.similar)
    assert sorted(map(key, found.collect())) == sorted(map(key, S.similar_items(items, 4).collect()))


def test_an_index_over_nothing(frame):
    found, facts = S.indexed_similar_items(frame([(1, [0.0, 0.0])], "id long, features array<double>"), 3)
    assert found.collect() == [] and facts["cells"] == 0


def test_lists_of_a_model_come_by_blocks(spark, frame):
    rows = [(u, i, 1.0 + (u * i) % 3) for u in range(30) for i in range(40) if (u + i) % 3 == 0]
    pairs = frame(rows, "userId int, itemId int, rating double")
    width = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        model = R.fit_als(pairs, rank=3, maxIter=3)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", width)
    assert model.userFactors.rdd.getNumPartitions() == R.MIN_BLOCKS  # not the width of shuffles
    key = lambda df: {(r.userId, tuple((x.itemId, x.rating) for x in r.recommendations)) for r in df.collect()}
    assert key(R.recommend(model, 4)) == key(model.recommendForAllUsers(4))
    some = frame([(3,), (3,), (5,), (99,)], "userId int")
    assert key(R.recommend(model, 4, some)) == key(model.recommendForUserSubset(some, 4))


def test_iterations_leave_no_files_behind():
    assert R.als().getCheckpointInterval() <= 2


def test_interactions_read_the_fact_once(spark, frame):
    from pyspark.sql import types as T

    seen = spark.sparkContext.accumulator(0)
    fact = frame([(1, 10, 2.0, 5), (1, 11, 4.0, 6), (2, 10, 1.0, 7)], "customer_id int, product_id int, price double, at int")

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    counted = fact.mapInArrow(count, T.StructType(fact.schema.fields))
    pairs, _, _ = I.interactions(counted, "at")
    assert {(r.customer_id, r.product_id, r.rating) for r in pairs.collect()} == {(1, 10, 5.0), (1, 11, 10.0), (2, 10, 2.5)}
    assert seen.value == 3


def test_a_vector_is_sent_to_bins_and_not_to_every_cell(spark, monkeypatch):
    rng = np.random.default_rng(5)
    vectors = {i: rng.normal(size=8).tolist() for i in range(400)}  # directions without clusters: nearly all cells matter
    items = spark.createDataFrame(list(vectors.items()), "id int, features array<double>")
    sent, applied = [], type(items).mapInPandas

    def counted(self, function, schema, **how):
        out = applied(self, function, schema, **how)
        if "cells" in out.columns or out.columns == ["rep", "vec", "cell"]:
            sent.append(out)
        return out

    monkeypatch.setattr(type(items), "mapInPandas", counted)
    monkeypatch.setattr(S, "ROUTED_AT_ONCE", 16)
    got = {}
    for r in S.similar_items(items, 5, block=100).collect():
        got.setdefault(r.item, {})[r["rank"]] = r.similar
    assert sent[0].count() <= 400 * 7 < 400 * 20  # bins of up to a hundred vectors, twenty cells
    want = _brute_force(vectors, 5)
    assert all([got[i][k + 1] for k in range(5)] == [s for s, _ in want[i]] for i in want)


def test_a_fitted_model_holds_no_shuffles_of_its_training(frame):
    pairs = frame([(u, i, float(1 + (u * i) % 5)) for u in range(12) for i in range(9) if (u + i) % 3], "userId int, itemId int, rating double")
    model = R.fit_als(pairs, rank=3, maxIter=2)
    for factors in (model.userFactors, model.itemFactors):
        assert not any(kind in factors._jdf.rdd().toDebugString() for kind in ("Shuffled", "CoGrouped"))
    assert {u.userId: len(u.recommendations) for u in R.recommend(model, 4).collect()} == {u: 4 for u in range(12)}
    unknown = frame([(99, 1, 1.0), (1, 2, 1.0)], "userId int, itemId int, rating double")
    assert [(r["userId"], r["itemId"]) for r in R.predict(model, unknown).collect()] == [(1, 2)]


def test_large_trials_do_not_train_side_by_side_and_drop_what_they_leave(frame, monkeypatch):
    pairs = frame([(u, i, float(1 + (u * i) % 5)) for u in range(12) for i in range(9) if (u + i) % 3], "userId int, itemId int, rating double")
    assert R._side_by_side(pairs, 4) == 4
    monkeypatch.setattr(R, "PAIRS_SIDE_BY_SIDE", 2 * pairs.count())
    assert R._side_by_side(pairs, 4) == 2 and R._side_by_side(pairs, 1) == 1
    monkeypatch.setattr(R, "PAIRS_SIDE_BY_SIDE", 1)
    assert R._side_by_side(pairs, 4) == 1
    dropped, tidy = [], R.tidied
    monkeypatch.setattr(R, "tidied", lambda spark: dropped.append(1) or tidy(spark))
    trials = R.grid_search(pairs, {"rank": [2, 3]}, folds=2, maxIter=2)[1]
    assert trials.count() == 2 and len(dropped) == 4  # after each fit of each fold
