"""Hand-computed and brute-force answers on small fixtures."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from martlet.functions import columns as FC
from martlet.operators import aggregates as A
from martlet.operators import joins as J
from martlet.operators import projections as P
from martlet.operators import topk as K
from martlet.operators import windows as W
from martlet.operators.ordering import global_row_number, global_running_sum, rank_within


def test_hour_boundaries(frame):
    rows = [("2018-01-01 10:05", "2018-01-01 10:59"), ("2018-01-01 10:59", "2018-01-01 11:01"), ("2018-01-01 23:30", "2018-01-03 00:10")]
    df = frame(rows, "a string, b string").select(F.to_timestamp("a").alias("a"), F.to_timestamp("b").alias("b"))
    assert [r.h for r in df.select(FC.hour_boundaries("a", "b").alias("h")).collect()] == [0, 1, 25]


def test_blank_as_null(frame):
    df = frame([("  ",), ("",), (None,), (" x ",)], "s string")
    assert [r.s for r in df.select(FC.blank_as_null("s").alias("s")).collect()] == [None, None, None, " x "]


def test_fill_template(frame):
    df = frame([("a", "b")], "x string, y string")
    assert df.select(FC.fill_template("1 {x} 2 {y}", x="x", y="y").alias("t")).first().t == "1 a 2 b"
    with pytest.raises(ValueError):
        FC.fill_template("{z}", x="x")


def test_names():
    assert FC.underscore_name("Product Segment") == "Product_Segment"
    assert FC.plain_name("sales (R$)!") == "sales_R_"


def test_sample_skewness(frame):
    values = [1.0, 2.0, 2.0, 3.0, 10.0]
    got = frame([(v,) for v in values], "v double").agg(FC.sample_skewness("v").alias("s")).first().s
    n, m = len(values), np.mean(values)
    g1 = np.mean((np.array(values) - m) ** 3) / np.std(values) ** 3
    assert got == pytest.approx(g1 * math.sqrt(n * (n - 1)) / (n - 2))


def test_gini_and_coverage(frame):
    counts = frame([(1,), (1,), (2,), (4,)], "n int")
    assert A.gini(counts, "n").first().gini == pytest.approx(0.0625)
    assert A.gini(counts.filter("n > 9"), "n").first().gini == 0.0
    recs = frame([("a",), ("a",), ("b",)], "product_id string")
    catalog = frame([(c,) for c in "abcde"], "product_id string")
    assert A.coverage(recs, catalog).first().catalog_coverage_percent == pytest.approx(40.0)


def test_gini_against_formula(frame):
    rng = random.Random(3)
    values = sorted(rng.choice([1, 1, 1, 2, 3, 50]) for _ in range(300))
    n = len(values)
    want = 1 - 2 * sum((n + 1 - i) * v for i, v in enumerate(values, 1)) / (n * sum(values))
    assert A.gini(frame([(v,) for v in values], "n int"), "n").first().gini == pytest.approx(want)


def test_pareto_cut_against_listing(frame):
    rng = random.Random(5)
    rows = [(rng.choice("aaaaaabbbcdefghij"),) for _ in range(500)]
    df = frame(rows, "k string")
    listed = W.pareto(df, "k").collect()
    cut = W.pareto_cut(df, "k").first()
    assert cut.groups_within == sum(r.cumulative_percentage <= 80 for r in listed)
    assert cut.groups == len(listed)


def test_global_order_with_a_hot_key(frame):
    rng = random.Random(1)
    rows = [(0 if rng.random() < 0.4 else rng.randrange(50), i) for i in range(5000)]
    df = frame(rows, "k int, id int").repartition(7)
    got = {r.id: r.row_number for r in global_row_number(df, "k", "id").collect()}
    assert got == {i: n for n, (_, i) in enumerate(sorted(rows), 1)}
    sums = {r.id: r.running_sum for r in global_running_sum(df, "id", F.desc("k"), F.col("id")).collect()}
    total, want = 0, {}
    for k, i in sorted(rows, key=lambda r: (-r[0], r[1])):
        total += i
        want[i] = total
    assert sums == want


def test_rank_within_hot_and_null_groups(frame):
    rng = random.Random(6)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), rng.randrange(20), i) for i in range(1500)]
    out = W.rank_recs(frame(rows, "u string, s int, i int").repartition(5), "u", "i", "s").collect()
    groups: dict = {}
    for u, s, i in rows:
        groups.setdefault(u, []).append((-s, i))
    want = {i: n for members in groups.values() for n, (_, i) in enumerate(sorted(members), 1)}
    assert {r.i: r["rank"] for r in out} == want


def test_a_hot_group_is_ranked_and_listed_in_many_tasks(spark, frame):
    names = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8"}
    before = {name: spark.conf.get(name) for name in names}
    try:
        for name, value in names.items():
            spark.conf.set(name, value)
        rows = [("hot", i) for i in range(4000)] + [(None, 1), ("cold", 2)]
        out = rank_within(frame(rows, "k string, v int").repartition(5), ["k"], "v").withColumn("task", F.spark_partition_id()).collect()
        listed = A.list_per(frame(rows, "k string, v int"), "k", "v", max_len=100).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert {(r.k, r.v): r["rank"] for r in out} == {(k, v): v + 1 if k == "hot" else 1 for k, v in rows}
    assert max(Counter(r.task for r in out).values()) < 3000
    assert len(listed) == 42 and len({r.task for r in listed}) > 3


@pytest.mark.parametrize("by", [None, ["g"]])
def test_exact_quantiles(frame, by):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.6 else rng.choice(["x", "y", None]), float(rng.randrange(100))) for _ in range(2000)]
    out = A.exact_quantiles(frame(rows, "g string, v double"), "v", [0.0, 0.25, 0.5, 0.9, 1.0], by).collect()
    assert len(out) == (1 if by is None else 4)
    for r in out:
        mine = [v for g, v in rows if by is None or g == r.g]
        want = np.quantile(mine, [0.0, 0.25, 0.5, 0.9, 1.0])
        assert [r.q0, r.q1, r.q2, r.q3, r.q4] == pytest.approx(list(want))


def test_list_per_splits_hot_keys_and_keeps_all(frame):
    rows = [("hot", i % 40) for i in range(400)] + [("cold", 3), ("cold", 1), ("cold", 3), (None, 5)]
    out = A.list_per(frame(rows, "k string, v int"), "k", "v", max_len=50).collect()
    assert [r["values"] for r in out if r.k == "cold"] == [[1, 3, 3]]
    assert [r["values"] for r in out if r.k is None] == [[5]]
    hot = [r for r in out if r.k == "hot"]
    assert sorted(r.part for r in hot) == list(range(8)) and {len(r["values"]) for r in hot} == {50}
    assert [v for r in sorted(hot, key=lambda r: r.part) for v in r["values"]] == sorted(v for k, v in rows if k == "hot")
    assert {r.part for r in out if r.k != "hot"} == {0}


def test_list_rows_number_the_values_of_each_key(frame):
    rows = [("b", 2), ("b", 1), ("b", 2), ("b", None), (None, 7), ("a", 4)]
    out = A.list_rows(frame(rows, "k string, v int"), "k", "v").collect()
    assert sorted((r.k or "", r.position, r.value) for r in out) == [("", 1, 7), ("a", 1, 4), ("b", 1, 1), ("b", 2, 2), ("b", 3, 2)]


def test_box_stats_ignores_outliers_for_whiskers(frame):
    df = frame([("a", float(v)) for v in (1, 2, 3, 4, 5, 100)], "g string, v double")
    r = A.box_stats(df, "v", "g").first()
    assert (r.q1, r.median, r.q3, r.whisker_low, r.whisker_high) == (2.25, 3.5, 4.75, 1.0, 5.0)


def test_histogram_includes_the_maximum(frame):
    df = frame([(float(v),) for v in (0, 1, 2, 3, 10)], "v double")
    assert {r.bin: r["count"] for r in A.histogram(df, "v", 5).collect()} == {0: 2, 1: 2, 4: 1}
    flat = A.histogram(frame([(2.0,), (2.0,)], "v double"), "v", 5).collect()
    assert [(r.bin, r["count"]) for r in flat] == [(0, 2)]


def test_cross_filter_counts_each_review_once(frame):
    fact = frame([("o1", "x")] * 3 + [("o1", "y")], "order_id string, category string")
    reviews = frame([("o1", "r1", 5), ("o1", "r2", 1), ("o2", "r3", 3)], "order_id string, review_id string, score int")
    out = J.cross_filter(fact, reviews, ["category"], "order_id")
    assert sorted((r.category, r.review_id) for r in out.collect()) == [("x", "r1"), ("x", "r2"), ("y", "r1"), ("y", "r2")]
    assert J.cross_filter(fact, reviews, [], "order_id").count() == 2


def test_join_back_does_not_multiply(frame):
    df = frame([(1, "a"), (1, "b")], "id int, text string")
    enriched = frame([(1, "a", "A"), (1, "b", "B"), (1, "a", "A")], "id int, text string, out string")
    assert sorted(r.out for r in J.join_back(df, enriched, ["id", "text"]).collect()) == ["A", "B"]


def test_products_enriched(frame):
    products = frame([(1, "a_b"), (2, "zz"), (3, None)], "product_id int, product_category_name string")
    translations = frame([("a_b", "nice_things")], "product_category_name string, product_category_name_english string")
    segments = frame([("nice things", "Home")], "Category string, product_segment string")
    out = {r.product_id: (r.Category, r["Product Segment"]) for r in J.products_enriched(products, translations, segments).collect()}
    assert out == {1: ("nice things", "Home"), 2: (None, None), 3: (None, None)}


def test_facets_drop_missing_prices(frame):
    df = frame([("Food", None, 1), ("food", 0.0, 1), ("FOOD", 5.0, 0), ("food", 6.0, 2)], "category string, price double, stock int")
    assert P.facet_filter(df, "food", 0, 10).count() == 2
    assert P.facet_filter(df, "food", 0, 10, in_stock=True).count() == 1
    assert P.facet_filter(df, "All Categories").count() == 4


def test_text_search_handles_nulls(frame):
    df = frame([("Red Shoe", None), (None, "blue"), ("x", "A RED one")], "name string, description string")
    assert P.text_search(df, ["name", "description"], "ReD").count() == 2


def test_select_types_drops_empty_columns(frame):
    df = frame([(1, None, "x")], "a int, b double, c string")
    assert P.select_types(df, ["number"], drop_all_null=True).columns == ["a"]
    assert P.select_types(df, ["number", "category"]).columns == ["a", "b", "c"]


def test_fill_both_directions(frame):
    df = frame([(1, None), (2, 5.0), (3, None), (4, 7.0), (5, None)], "d int, v double")
    assert [r.v for r in W.fill(df, [], "d", "v").orderBy("d").collect()] == [5.0, 5.0, 7.0, 7.0, 7.0]


def test_catalog_sort_treats_missing_as_zero(frame):
    df = frame([(1, 5.0, None), (2, None, 4.0), (3, 2.0, 5.0)], "product_id int, price double, rating double")
    order = lambda option: [r.product_id for r in K.catalog_sort(df, option).collect()]
    assert order("price_asc") == [2, 3, 1]
    assert order("price_desc") == [1, 3, 2]
    assert order("rating") == [3, 2, 1]
    assert sorted(order("newest")) == [1, 2, 3]
    with pytest.raises(ValueError):
        K.catalog_sort(df, "cheapest")


def test_paging(frame):
    df = frame([(i,) for i in range(30)], "i int")
    assert [r.i for r in K.page(df, 3, "i").collect()] == list(range(24, 30))
    assert K.page_count(df).first().pages == 3


def test_cross_filter_drops_unrelated_rows_first(frame):
    from martlet.operators import joins as J

    fact = frame([("a", 1), ("a", 1), ("b", 1), ("b", 2), ("b", None)], "category string, order_id int")
    other = frame([(1, 5), (1, 4), (None, 3)], "order_id int, score int")
    out = J.cross_filter(fact, other, ["category"], "order_id")
    assert "LeftSemi" in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.category, r.score) for r in out.collect()) == [("a", 4), ("a", 5), ("b", 4), ("b", 5)]
