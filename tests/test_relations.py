"""Groups and filters on many-to-many tables of a tiny star, against answers worked out by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from martlet.operators import measures as M
from martlet.operators import time_intelligence as TI
from martlet.operators.relations import Relation

SALES = [
    # order, customer, seller, price, day
    ("o1", "c1", "s1", 10.0, "2016-02-28"),
    ("o1", "c1", "s2", 20.0, "2016-02-28"),
    ("o2", "c2", "s1", 7.0, "2016-03-01"),
    ("o3", None, None, 3.0, "2017-02-28"),
]


@pytest.fixture
def model(spark, frame):
    fact = frame(SALES, "order_id string, customer_id string, seller_id string, price double, order_approved_at string")
    fact = fact.withColumn("order_approved_at", F.to_timestamp_ntz("order_approved_at", F.lit("yyyy-MM-dd")))
    customers = frame([("c1", "z1", "X"), ("c2", "z2", "Y")], "customer_id string, zip string, region string")
    reviews = frame(
        [("r1", "o1", 5, 0.0), ("r2", "o1", 1, 1.0), ("r3", "o1", 1, 0.0), ("r4", "o2", 1, 1.0), ("r5", "gone", 5, 1.0), ("r6", None, 5, 1.0)],
        "review_id string, order_id string, review_score int, defect_score double",
    )
    payments = frame([("o1", "card", 9.0), ("o1", "card", 21.0), ("o1", "voucher", 1.0), ("o3", "card", 3.0)], "order_id string, payment_type string, paid double")
    leads = frame([("m1", "s1", "web"), ("m2", "s1", "web"), ("m3", "s2", None), ("m4", "s1", "mail")], "mql_id string, seller string, origin string")
    visits = frame([("m1", "a"), ("m1", "a"), ("m2", "b"), ("m3", "a")], "mql_id string, host string")
    places = frame([("z1", "North"), ("z1", "North"), ("z1", "Coast"), ("z2", "Coast")], "geo_zip string, area string")
    relations = {
        "payments": Relation(payments, "order_id"),
        "leads": Relation(leads, "seller", target_key="seller_id"),
        "visits": Relation(visits, "mql_id", "leads"),
        "places": Relation(places, "geo_zip", "customers", "zip"),
    }
    return M.StarModel(fact, {"customers": (customers, "customer_id", "customer_id")}, reviews, relations=relations)


def by_group(df, *columns):
    return {tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]]: r for r in df.collect()}


def test_a_row_counts_once_in_each_of_its_groups(model):
    got = by_group(M.evaluate(model, ["total_sales", "total_orders", "total_active_customers"], ["review_score"]), "review_score")
    assert {k: tuple(r)[1:] for k, r in got.items()} == {5: (30.0, 2, 1), 1: (37.0, 3, 2)}  # o1 has two reviews of score 1
    paid = by_group(M.evaluate(model, ["total_sales"], ["payment_type"]), "payment_type")
    assert {k: r.total_sales for k, r in paid.items()} == {"card": 33.0, "voucher": 30.0}


def test_groups_on_two_relations_and_a_dimension(model):
    got = by_group(M.evaluate(model, ["total_sales"], ["origin", "payment_type", "region"]), "origin", "payment_type", "region")
    assert {k: r.total_sales for k, r in got.items()} == {
        ("web", "card", "X"): 10.0, ("web", "voucher", "X"): 10.0, ("mail", "card", "X"): 10.0,
        ("mail", "voucher", "X"): 10.0, (None, "card", "X"): 20.0, (None, "voucher", "X"): 20.0,
    }


def test_filters_are_semi_joins(model):
    total = lambda **filters: M.evaluate(model, ["total_sales", "total_orders"], filters=filters).first()
    assert tuple(total(payment_type=["card"])) == (33.0, 3)
    assert tuple(total(payment_type=["card", "voucher"], review_score=[1])) == (30.0, 2)
    assert tuple(total(paid=F.col("paid") > 20)) == (30.0, 2)
    assert tuple(total(origin=["nothing"])) == (None, None)


def test_two_conditions_on_one_table_hold_for_the_same_row(model):
    # o1 has a card payment and a payment of 1.0, but no card payment of 1.0.
    both = {"payment_type": ["card"], "paid": F.col("paid") < 2}
    assert M.evaluate(model, ["total_orders"], filters=both).first()[0] is None


def test_relations_two_steps_away(model):
    got = by_group(M.evaluate(model, ["total_sales"], ["host"]), "host")
    assert {k: r.total_sales for k, r in got.items()} == {"a": 37.0, "b": 17.0}
    web = by_group(M.evaluate(model, ["total_sales"], ["host"], {"origin": ["web"]}), "host")
    assert {k: r.total_sales for k, r in web.items()} == {"a": 17.0, "b": 17.0}
    areas = by_group(M.evaluate(model, ["total_sales", "total_orders"], ["area"]), "area")
    assert {k: tuple(r)[1:] for k, r in areas.items()} == {"North": (30.0, 2), "Coast": (37.0, 3)}


def test_reviews_by_their_own_and_by_other_columns(model):
    own = by_group(M.evaluate(model, ["total_reviews", "average_defect_ratio"], ["review_score"]), "review_score")
    assert {k: tuple(r)[1:] for k, r in own.items()} == {5: (1, 0.0), 1: (3, pytest.approx(2 / 3))}
    filtered = M.evaluate(model, ["total_reviews", "total_sales"], ["payment_type"], {"review_score": [1]})
    assert {r.payment_type: (r.total_reviews, r.total_sales) for r in filtered.collect()} == {"card": (2, 30.0), "voucher": (2, 30.0)}


def test_rows_of_a_relation_under_filters_of_the_model(model):
    rows = M.related_rows(model, "payments", ["region"], {"review_score": [5], "payment_type": ["card"]})
    assert sorted((r.region, r.paid) for r in rows.collect()) == [("X", 9.0), ("X", 21.0)]
    assert M.related_rows(model, "reviews").count() == 4  # no sale, no review
    with pytest.raises(ValueError):
        M.related_rows(model, "payments", ["payment_type"])


def test_time_calculations_take_relation_columns(model):
    got = {(r.payment_type, str(r.period)): r for r in TI.time_calculations(model, "total_sales", "year", ["payment_type"]).collect()}
    assert (got["card", "2017-01-01"].current, got["card", "2017-01-01"].py) == (3.0, 30.0)
    assert (got["voucher", "2017-01-01"].current, got["voucher", "2017-01-01"].py) == (None, 30.0)
    ones = TI.time_calculations(model, "total_reviews", "year", filters={"review_score": [1]}).collect()
    assert [(str(r.period), r.current) for r in ones if r.current] == [("2016-01-01", 3.0)]


def test_blank_is_zero_on_every_step(model):
    rows = {str(r.period): r for r in TI.time_calculations(model, "total_sales_missing_dates", "month").collect()}
    assert len(rows) == 24
    assert (rows["2016-01-01"].current, rows["2016-04-01"].ytd, rows["2016-04-01"].current) == (0.0, 37.0, 0.0)
    assert (rows["2017-03-01"].yoy, rows["2017-03-01"].yoy_pct, rows["2017-04-01"].yoy_pct) == (-7.0, -1.0, None)
    grouped = TI.time_calculations(model, "total_sales_missing_dates", "year", ["region"]).collect()
    assert sorted((str(r.region), str(r.period)[:4], r.current) for r in grouped) == [
        ("None", "2016", 0.0), ("None", "2017", 3.0), ("X", "2016", 30.0), ("X", "2017", 0.0), ("Y", "2016", 7.0), ("Y", "2017", 0.0)
    ]


def test_forecast_over_time_takes_calendar_filters(model, frame):
    from dataclasses import replace

    days = frame([("2016-01-31", 5.0), ("2016-02-01", 6.0), ("2017-01-01", 9.0)], "date string, predicted_sales double").withColumn("date", F.to_date("date"))
    calendar = days.select("date", F.month("date").alias("month_number"))
    got = TI.time_calculations(replace(model, forecast=days, calendar=calendar), "total_sales_forecast", "year", filters={"month_number": [1]}).collect()
    assert [(str(r.period), r.current, r.py) for r in got] == [("2016-01-01", 5.0, None), ("2017-01-01", 9.0, 5.0)]


def test_unknown_and_ambiguous_columns(model, frame):
    from dataclasses import replace

    with pytest.raises(ValueError, match="unknown"):
        M.evaluate(model, ["total_sales"], ["colour"])
    twice = replace(model, relations={**model.relations, "more": Relation(frame([("o1", "x")], "order_id string, payment_type string"), "order_id")})
    with pytest.raises(ValueError, match="several"):
        M.evaluate(twice, ["total_sales"], ["payment_type"])


def test_rows_in_no_group_are_not_summed(model):
    out = M.evaluate(model, ["total_sales", "total_reviews"], ["payment_type"])
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LeftSemi") == 2
