"""Measures and time intelligence on a tiny star, against answers worked out by hand."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from martlet.operators import measures as M
from martlet.operators import time_intelligence as TI

D = dt.date


@pytest.fixture(scope="module")
def model(spark):
    rows = [
        # order, customer, product, price, purchased, delivered
        ("o1", "c1", "p1", 10.0, "2016-02-28 10:59:00", "2016-02-28 11:01:00"),
        ("o1", "c1", "p1", 20.0, "2016-02-28 10:59:00", "2016-02-28 11:01:00"),
        ("o1", "c1", "p2", 5.0, "2016-02-28 10:59:00", None),
        ("o2", "c2", "p2", 7.0, "2016-02-29 00:00:00", "2016-03-01 00:00:00"),
        ("o3", "c1", "p1", 3.0, "2017-02-28 08:00:00", "2017-02-28 09:00:00"),
        ("o4", "c1", "p3", 2.0, "2017-03-05 08:00:00", "2017-03-05 08:30:00"),
    ]
    schema = "order_id string, customer_id string, product_id string, price double, bought string, delivered string"
    fact = spark.createDataFrame(rows, schema).select(
        "order_id", "customer_id", "product_id", "price",
        F.to_timestamp_ntz("bought").alias("order_purchase_timestamp"),
        F.to_timestamp_ntz("bought").alias("order_approved_at"),
        F.to_timestamp_ntz("delivered").alias("order_delivered_customer_date"),
    )
    fact = M.with_calculated_columns(
        fact, "order_approved_at", "order_delivered_customer_date", "order_purchase_timestamp"
    )
    products = spark.createDataFrame([("p1", "A"), ("p2", "B")], "product_id string, category string")
    reviews = spark.createDataFrame(
        [("r1", "o1", 5, 0.0), ("r2", "o1", 1, None), ("r3", "o2", 4, 1.0), ("r4", "o9", 1, 1.0)],
        "review_id string, order_id string, review_score int, defect_score double",
    )
    return M.StarModel(fact, {"products": (products, "product_id", "product_id")}, reviews)


def test_reviews_are_counted_once_per_group(model):
    out = M.evaluate(model, ["total_orders", "total_reviews", "average_review", "average_defect_ratio"], ["category"])
    got = {r.category: tuple(r)[1:] for r in out.collect()}
    assert got["A"] == (3, 2, 3.0, 0.0)
    assert got["B"] == (2, 3, pytest.approx(10 / 3), 0.5)
    assert got[None] == (1, None, None, None)


def test_totals_and_filters(model):
    out = M.evaluate(model, ["total_sales", "total_reviews"], filters={"category": ["B"]}).first()
    assert (out.total_sales, out.total_reviews) == (12.0, 3)
    assert M.evaluate(model, ["average_delivery_time"]).first()[0] == pytest.approx((1 + 1 + 24 + 1 + 0) / 5)


def test_predicates_on_dimension_columns(model):
    out = M.evaluate(model, ["total_sales"], filters={"category": F.col("category") == "A"}).first()
    assert out.total_sales == 33.0
    both = M.evaluate(model, ["total_sales", "total_reviews"], filters={"category": F.col("category") == "A"}).first()
    assert (both.total_sales, both.total_reviews) == (33.0, 2)


def test_measures_by_key_equal_the_general_way(model):
    general = M.evaluate(model, ["total_sales", "total_orders"], ["category", "date"]).groupBy("category")
    want = {r.category: (r.s, r.n) for r in general.agg(F.sum("total_sales").alias("s"), F.sum("total_orders").alias("n")).collect()}
    by_key = M.evaluate(model, ["total_sales", "total_orders"], ["category"]).collect()
    assert {r.category: (r.total_sales, r.total_orders) for r in by_key} == want


def test_only_named_measures_and_known_columns(model):
    with pytest.raises(ValueError):
        M.evaluate(model, ["median_sales"])
    with pytest.raises(ValueError):
        M.evaluate(model, ["total_sales"], ["colour"])


def test_sales_over_days(model):
    got = {r.period: r for r in TI.time_calculations(model, "total_sales", "day").collect()}
    feb29, mar5, feb28 = got[D(2016, 2, 29)], got[D(2017, 3, 5)], got[D(2017, 2, 28)]
    assert (feb29.current, feb29.mtd, feb29.ytd, feb29.py) == (7.0, 42.0, 42.0, None)
    # The day a year before 28 February 2017 is 28 February 2016; the leap day has no successor.
    assert (feb28.current, feb28.py, feb28.yoy) == (3.0, 35.0, -32.0)
    assert feb28.yoy_pct == pytest.approx(-32 / 35)
    assert (mar5.mtd, mar5.ytd) == (2.0, 5.0)
    assert got[D(2016, 12, 31)].ytd == 42.0 and got[D(2016, 12, 31)].mtd is None
    assert max(got) == D(2017, 12, 31)


def test_distinct_customers_to_date(model):
    got = {r.period: r for r in TI.time_calculations(model, "total_active_customers", "month").collect()}
    assert (got[D(2016, 2, 1)].current, got[D(2016, 2, 1)].ytd) == (2.0, 2.0)
    assert (got[D(2017, 3, 1)].current, got[D(2017, 3, 1)].ytd, got[D(2017, 3, 1)].py) == (1.0, 1.0, None)
    assert got[D(2017, 2, 1)].py == 2.0


def test_review_average_to_date(model):
    got = {r.period: r for r in TI.time_calculations(model, "average_review", "day").collect()}
    assert got[D(2016, 2, 28)].current == 3.0
    assert got[D(2016, 2, 29)].mtd == pytest.approx(10 / 3)


def test_single_item(model):
    out = TI.time_calculation(model, "total_sales", "yoy_pct", "year").collect()
    assert [(r.period, r.value) for r in out] == [(D(2017, 1, 1), pytest.approx((5 - 42) / 42))]
    with pytest.raises(ValueError):
        TI.time_calculation(model, "total_sales", "qtd")


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_orders_without_reviews_are_not_grouped(model):
    out = M.evaluate(model, ["total_reviews", "average_review"], ["category"])
    assert "LeftSemi" in _plan(out)
    assert {(r.category, r.total_reviews) for r in out.collect()} == {("A", 2), ("B", 3)}
    mixed = M.evaluate(model, ["total_sales", "total_reviews"], ["category"])  # sales count without a review
    assert "LeftSemi" not in _plan(mixed) and mixed.agg(F.sum("total_sales")).first()[0] == 47.0
