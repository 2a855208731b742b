"""Queries over measures and time intelligence."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from martlet.functions.columns import midnight
from martlet.operators import measures as M
from martlet.operators import time_intelligence as TI
from martlet.plans.registry import query, with_
from martlet.plans.tables import CUSTOMERS, DELIVERED, DELIVERED_FACT, FACT, LANDINGS, LEADS, PAYMENTS, REVIEWS, Tables


def off_ties(column: str, places: int = 6):
    return F.round(F.col(column) + 1e-9, places).alias(column)


@query(
    "M10 M1 A14 P5 P7",
    with_(
        """SELECT d AS date, round(sum(price), 2) AS total_sales FROM fact
           WHERE order_status = 'F' AND d BETWEEN make_date(1997, 1, 1) AND make_date(1998, 8, 30) GROUP BY d""",
        FACT,
    ),
)
def daily_sales_measure(t: Tables):
    """Total sales of delivered orders per day of a period: the extract that feeds the forecast."""
    day = F.col("order_approved_at")
    period = (day >= midnight(dt.date(1997, 1, 1))) & (day < midnight(dt.date(1998, 8, 31)))
    out = M.evaluate(
        t.model(), ["total_sales"], ["date"], {"order_status": [DELIVERED], "order_approved_at": period}
    )
    return out.select("date", F.round("total_sales", 2).alias("total_sales")).orderBy("date")


@query(
    "M1 M2 M5 M6 M10 P6",
    with_(
        """SELECT customer_region, p_brand AS product_segment, round(sum(price), 2) AS total_sales, count(*) AS total_orders,
                  count(DISTINCT customer_id) AS total_active_customers, round(avg(hours) + 1e-9, 6) AS average_delivery_time
           FROM fact LEFT JOIN customers USING (customer_id) LEFT JOIN part ON product_id = p_partkey
           WHERE order_status IN ('F', 'O') AND customer_segment IN ('BUILDING', 'MACHINERY') GROUP BY 1, 2""",
        FACT,
        CUSTOMERS,
    ),
)
def sales_measures_by_dimension(t: Tables):
    measures = ["total_sales", "total_orders", "total_active_customers", "average_delivery_time"]
    filters = {"order_status": ["F", "O"], "customer_segment": ["BUILDING", "MACHINERY"]}
    out = M.evaluate(t.model(), measures, ["customer_region", "product_segment"], filters)
    return out.select(
        "customer_region",
        "product_segment",
        F.round("total_sales", 2).alias("total_sales"),
        "total_orders",
        "total_active_customers",
        off_ties("average_delivery_time"),
    )


@query(
    "M3 M4 M8 J11",
    with_(
        """SELECT category, count(*) AS total_reviews, round(avg(review_score) + 1e-9, 6) AS average_review,
                  round(avg(defect_score) + 1e-9, 6) AS average_defect_ratio
           FROM (SELECT DISTINCT p_type AS category, order_id FROM fact JOIN part ON product_id = p_partkey) v
           JOIN reviews USING (order_id) GROUP BY 1""",
        FACT,
        REVIEWS,
    ),
)
def review_measures_by_category(t: Tables):
    out = M.evaluate(t.model(), ["total_reviews", "average_review", "average_defect_ratio"], ["category"])
    return out.select("category", "total_reviews", off_ties("average_review"), off_ties("average_defect_ratio"))


@query(
    "M1 M3 M4 M10",
    with_(
        """, a AS (SELECT customer_state, sum(price) AS s FROM fact LEFT JOIN customers USING (customer_id) GROUP BY 1),
             v AS (SELECT DISTINCT customer_state, order_id FROM fact LEFT JOIN customers USING (customer_id)),
             b AS (SELECT customer_state, count(*) AS n, avg(review_score) AS r FROM v JOIN reviews USING (order_id) GROUP BY 1)
           SELECT coalesce(a.customer_state, b.customer_state) AS customer_state, round(s, 2) AS total_sales, n AS total_reviews,
                  round(r + 1e-9, 6) AS average_review FROM a FULL JOIN b ON a.customer_state IS NOT DISTINCT FROM b.customer_state""",
        FACT,
        CUSTOMERS,
        REVIEWS,
    ).replace(") , a AS", "), a AS"),
)
def mixed_measures_by_state(t: Tables):
    out = M.evaluate(t.model(), ["total_sales", "total_reviews", "average_review"], ["customer_state"])
    return out.select(
        "customer_state", F.round("total_sales", 2).alias("total_sales"), "total_reviews", off_ties("average_review")
    )


@query(
    "M1 M2 M3 M4",
    with_(
        """SELECT (SELECT round(sum(price), 2) FROM fact WHERE order_status = 'F') AS total_sales,
                  (SELECT count(*) FROM fact WHERE order_status = 'F') AS total_orders,
                  (SELECT count(*) FROM reviews WHERE order_id IN (SELECT order_id FROM fact WHERE order_status = 'F')) AS total_reviews,
                  (SELECT round(avg(review_score) + 1e-9, 6) FROM reviews
                     WHERE order_id IN (SELECT order_id FROM fact WHERE order_status = 'F')) AS average_review""",
        FACT,
        REVIEWS,
    ),
)
def grand_totals_of_measures(t: Tables):
    out = M.evaluate(
        t.model(),
        ["total_sales", "total_orders", "total_reviews", "average_review"],
        filters={"order_status": [DELIVERED]},
    )
    return out.select(
        F.round("total_sales", 2).alias("total_sales"), "total_orders", "total_reviews", off_ties("average_review")
    )


@query(
    "M1 M2 M5 M6 M10",
    with_(
        """SELECT customer_region, order_status, round(sum(price), 2) AS total_sales, count(*) AS total_orders,
                  count(DISTINCT customer_id) AS total_active_customers, round(avg(hours) + 1e-9, 6) AS average_delivery_time
           FROM fact LEFT JOIN customers USING (customer_id) WHERE customer_segment IN ('BUILDING', 'MACHINERY') AND order_status <> 'P'
           GROUP BY 1, 2""",
        FACT,
        CUSTOMERS,
    ),
)
def sales_measures_summed_by_key_first(t: Tables):
    measures = ["total_sales", "total_orders", "total_active_customers", "average_delivery_time"]
    filters = {"customer_segment": ["BUILDING", "MACHINERY"], "order_status": F.col("order_status") != "P"}
    out = M.evaluate(t.model(), measures, ["customer_region", "order_status"], filters)
    return out.select(
        "customer_region",
        "order_status",
        F.round("total_sales", 2).alias("total_sales"),
        "total_orders",
        "total_active_customers",
        off_ties("average_delivery_time"),
    )


# -- groups and filters on many-to-many tables --------------------------------------------------------------


@query(
    "M10 J11 M1 M2 M5",
    with_(
        """SELECT review_score, round(sum(price), 2) AS total_sales, count(*) AS total_orders, count(DISTINCT customer_id) AS total_active_customers
           FROM (SELECT DISTINCT order_id, review_score FROM reviews) r JOIN fact USING (order_id) GROUP BY 1""",
        FACT,
        REVIEWS,
    ),
)
def sales_by_review_score(t: Tables):
    out = M.evaluate(t.model(), ["total_sales", "total_orders", "total_active_customers"], ["review_score"])
    return out.select("review_score", F.round("total_sales", 2).alias("total_sales"), "total_orders", "total_active_customers")


@query(
    "M10 J11 M1 M2 M6",
    with_(
        """SELECT payment_type, customer_region, round(sum(price), 2) AS total_sales, count(*) AS total_orders,
                  round(avg(hours) + 1e-9, 6) AS average_delivery_time
           FROM (SELECT DISTINCT order_id, payment_type FROM payments) p JOIN fact USING (order_id) LEFT JOIN customers USING (customer_id)
           WHERE order_status IN ('F', 'O') AND seller_id IN (SELECT seller_id FROM leads WHERE origin IN ('BUILDING', 'MACHINERY'))
             AND order_id IN (SELECT order_id FROM reviews WHERE review_score = 1) GROUP BY 1, 2""",
        FACT,
        CUSTOMERS,
        PAYMENTS,
        LEADS,
        REVIEWS,
    ),
)
def sales_by_payment_type_filtered(t: Tables):
    """Groups by one many-side table and a dimension, filters on two other many-side tables and the fact."""
    filters = {"order_status": ["F", "O"], "origin": ["BUILDING", "MACHINERY"], "review_score": [1]}
    out = M.evaluate(t.model(), ["total_sales", "total_orders", "average_delivery_time"], ["payment_type", "customer_region"], filters)
    return out.select("payment_type", "customer_region", F.round("total_sales", 2).alias("total_sales"), "total_orders", off_ties("average_delivery_time"))


@query(
    "M10 J11 M1 M4",
    with_(
        """, o AS (SELECT DISTINCT seller_id, origin FROM leads), p AS (SELECT DISTINCT order_id, payment_type FROM payments),
             s AS (SELECT origin, payment_type, sum(price) AS total_sales FROM fact JOIN o USING (seller_id) JOIN p USING (order_id) GROUP BY 1, 2),
             v AS (SELECT DISTINCT origin, payment_type, order_id FROM fact JOIN o USING (seller_id) JOIN p USING (order_id)),
             r AS (SELECT origin, payment_type, count(*) AS total_reviews, avg(review_score) AS a FROM v JOIN reviews USING (order_id) GROUP BY 1, 2)
           SELECT origin, payment_type, round(total_sales, 2) AS total_sales, total_reviews, round(a + 1e-9, 6) AS average_review
           FROM s FULL JOIN r USING (origin, payment_type)""",
        FACT,
        PAYMENTS,
        LEADS,
        REVIEWS,
    ).replace(") , o AS", "), o AS").replace(") \n           , o AS", "), o AS"),
)
def measures_by_lead_origin_and_payment_type(t: Tables):
    """Groups on two many-side tables at once, for measures of the fact and of a third one."""
    out = M.evaluate(t.model(), ["total_sales", "total_reviews", "average_review"], ["origin", "payment_type"])
    return out.select("origin", "payment_type", F.round("total_sales", 2).alias("total_sales"), "total_reviews", off_ties("average_review"))


@query(
    "M10 J11 M1 J13",
    with_(
        """SELECT landing_host, round(sum(price), 2) AS total_sales, count(*) AS total_orders
           FROM (SELECT DISTINCT seller_id, landing_host FROM leads JOIN landings USING (mql_id) WHERE origin <> 'BUILDING') b JOIN fact USING (seller_id) GROUP BY 1""",
        FACT,
        LEADS,
        LANDINGS,
    ),
)
def sales_by_landing_host(t: Tables):
    """A group two many-to-many steps away from the fact, with a filter on the step between."""
    out = M.evaluate(t.model(), ["total_sales", "total_orders"], ["landing_host"], {"origin": F.col("origin") != "BUILDING"})
    return out.select("landing_host", F.round("total_sales", 2).alias("total_sales"), "total_orders")


@query(
    "M10 J11",
    with_(
        """SELECT customer_region, payment_type, count(*) AS payments, round(sum(payment_value), 2) AS paid
           FROM (SELECT DISTINCT customer_region, order_id FROM fact LEFT JOIN customers USING (customer_id) WHERE order_status = 'F'
                   AND order_id IN (SELECT order_id FROM reviews WHERE review_score = 1)) v
           JOIN payments USING (order_id) WHERE payment_type <> 'error' GROUP BY 1, 2""",
        FACT,
        CUSTOMERS,
        PAYMENTS,
        REVIEWS,
    ),
)
def payments_by_customer_region(t: Tables):
    """The other way: rows of a many-side table under filters of the fact, another many-side table and their own."""
    filters = {"order_status": [DELIVERED], "review_score": [1], "payment_type": F.col("payment_type") != "error"}
    rows = M.related_rows(t.model(), "payments", ["customer_region"], filters)
    return rows.groupBy("customer_region", "payment_type").agg(F.count(F.lit(1)).alias("payments"), F.round(F.sum("payment_value"), 2).alias("paid"))


@query(
    "M7 M10",
    with_(
        """, c AS (SELECT year(CAST(o_orderdate AS DATE)) AS year_number, month(o_orderdate) AS month_number, o_totalprice AS p FROM orders),
             f AS (SELECT year_number, month_number, sum(p) AS forecast FROM c GROUP BY 1, 2),
             s AS (SELECT year(d) AS year_number, month(d) AS month_number, sum(price) AS sales FROM fact GROUP BY 1, 2)
           SELECT CAST(year_number AS INTEGER) AS year_number, CAST(month_number AS INTEGER) AS month_number,
                  round(sales, 2) AS total_sales, round(forecast, 2) AS total_sales_forecast
           FROM f FULL JOIN s USING (year_number, month_number)""",
        FACT,
    ).replace(") , c AS", "), c AS"),
)
def forecast_next_to_sales(t: Tables):
    model = t.model(with_calendar=True)
    out = M.evaluate(model, ["total_sales", "total_sales_forecast"], ["year_number", "month_number"])
    return out.select(
        "year_number",
        "month_number",
        F.round("total_sales", 2).alias("total_sales"),
        F.round("total_sales_forecast", 2).alias("total_sales_forecast"),
    )


@query(
    "M9",
    with_(
        """SELECT s.date, round(coalesce(sum(price), 0), 2) AS total_sales_missing_dates
           FROM (SELECT CAST(unnest(generate_series(
                   (SELECT CAST(date_trunc('year', min(o_orderdate)) AS DATE) FROM orders),
                   (SELECT CAST(date_trunc('year', max(o_orderdate)) + INTERVAL 1 YEAR - INTERVAL 1 DAY AS DATE) FROM orders),
                   INTERVAL 1 DAY)) AS DATE) AS date) s
           LEFT JOIN fact ON d = s.date GROUP BY 1""",
        FACT,
    ),
)
def sales_on_every_date(t: Tables):
    out = M.total_sales_all_dates(t.model(), t.calendar())
    return out.select("date", F.round("total_sales_missing_dates", 2).alias("total_sales_missing_dates"))


@query(
    "M19",
    with_(
        """SELECT p_brand AS product_segment, p_type AS category, round(sum(price), 2) AS total_sales, count(*) AS total_orders
           FROM fact LEFT JOIN part ON product_id = p_partkey GROUP BY 1, 2""",
        FACT,
    ),
)
def drill_to_category(t: Tables):
    out = M.drill(t.model(), ["total_sales", "total_orders"], "product", 2)
    return out.withColumn("total_sales", F.round("total_sales", 2))


@query(
    "M19",
    with_(
        """SELECT p_brand AS product_segment, round(sum(price), 2) AS total_sales
           FROM fact LEFT JOIN part ON product_id = p_partkey GROUP BY 1""",
        FACT,
    ),
)
def drill_to_segment(t: Tables):
    return M.drill(t.model(), ["total_sales"], "product", 1).withColumn("total_sales", F.round("total_sales", 2))


@query(
    "M20",
    """SELECT strftime(o_orderdate, '%b %Y') AS month_year, CAST(min(year(o_orderdate) * 12 - 1 + month(o_orderdate)) AS INTEGER) AS year_month_number
       FROM orders GROUP BY 1""",
)
def months_in_calendar_order(t: Tables):
    ordered = t.scan("orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    labelled = t.calendar().join(ordered, "date", "left_semi")
    return M.sorted_by(labelled, "month_year", "year_month_number")


# -- time intelligence: SQL states every period by a join of dates to facts, Spark by running sums ---------


def _time_sql(grain: str, source: str, value: str, by: str = "", once: str = "") -> str:
    """Reference semantics by brute force. ``source`` has (by, d, columns); ``value`` aggregates them."""
    group = f"{by}, " if by else ""
    on_by = f"f.{by} IS NOT DISTINCT FROM p.{by} AND " if by else ""
    unit = {"day": "DAY", "month": "MONTH", "year": "YEAR"}[grain]
    last = {"day": "p.period", "month": "last_day(p.period)", "year": "make_date(year(p.period), 12, 31)"}[grain]
    select_by = f"p.{by}, " if by else ""
    using = f"p.{by} IS NOT DISTINCT FROM x.{by} AND " if by else ""

    def over(name: str, start: str, end: str) -> str:
        return f"""{name} AS (SELECT {select_by}p.period, {value} AS v FROM periods p
             JOIN src f ON {on_by}f.d BETWEEN {start} AND {end} GROUP BY ALL)"""

    back = "p.period - INTERVAL 1 YEAR"
    back_end = {"day": back, "month": f"last_day(CAST({back} AS DATE))", "year": f"make_date(year(p.period) - 1, 12, 31)"}[grain]
    joins = " ".join(
        f"LEFT JOIN (SELECT * FROM {n}) {a} ON {using.replace('x.', a + '.')}p.period = {a}.period"
        for n, a in (("cur", "c"), ("mtd_", "m"), ("ytd_", "y"), ("py_", "q"))
    )
    return f"""WITH {FACT}, {REVIEWS}, src AS ({source}),
      days AS (SELECT CAST(unnest(generate_series(
                 (SELECT CAST(date_trunc('year', min(d)) AS DATE) FROM src),
                 (SELECT make_date(year(max(d)), 12, 31) FROM src), INTERVAL 1 DAY)) AS DATE) AS day),
      steps AS (SELECT DISTINCT CAST(date_trunc('{unit}', day) AS DATE) AS period FROM days),
      periods AS (SELECT {group}period FROM steps {', (SELECT DISTINCT ' + by + ' FROM src) g' if by else ''}),
      {over('cur', 'p.period', last)},
      {over('mtd_', f"CAST(date_trunc('month', {last}) AS DATE)", last)},
      {over('ytd_', "CAST(date_trunc('year', p.period) AS DATE)", last)},
      {over('py_', f"CAST({back} AS DATE)", f"CAST({back_end} AS DATE)")}
      SELECT {select_by}p.period, round(c.v + 1e-9, 4) AS current, round(m.v + 1e-9, 4) AS mtd, round(y.v + 1e-9, 4) AS ytd,
             round(q.v + 1e-9, 4) AS py,
             round(CASE WHEN c.v IS NOT NULL OR q.v IS NOT NULL THEN coalesce(c.v, 0) - coalesce(q.v, 0) END + 1e-9, 4) AS yoy,
             round(CASE WHEN q.v <> 0 THEN (coalesce(c.v, 0) - q.v) / q.v END + 1e-9, 4) AS yoy_pct
      FROM periods p {joins}
      WHERE coalesce(c.v, m.v, y.v, q.v) IS NOT NULL"""


def _time(t: Tables, measure: str, grain: str, by=(), filters=None):
    out = TI.time_calculations(t.model(), measure, grain, by, filters)
    return out.select(*by, "period", *[F.round(F.col(c) + 1e-9, 4).alias(c) for c in TI.TIME_CALCULATIONS])


SALES_SOURCE = "SELECT d, price FROM fact"


@query("M11 M12 M13 M14 M15 M16", _time_sql("day", SALES_SOURCE, "sum(price)"))
def sales_over_time_by_day(t: Tables):
    return _time(t, "total_sales", "day")


@query("M11 M12 M13 M14 M15 M16", _time_sql("month", "SELECT d, price, p_type AS category FROM fact JOIN part ON product_id = p_partkey", "sum(price)", "category"))
def sales_over_time_by_month_and_category(t: Tables):
    return _time(t, "total_sales", "month", ["category"])


@query("M11 M14 M15 M16", _time_sql("year", SALES_SOURCE, "sum(price)"))
def sales_over_time_by_year(t: Tables):
    return _time(t, "total_sales", "year")


@query("M12 M13 M14 M5", _time_sql("month", "SELECT d, customer_id FROM fact", "CAST(count(DISTINCT customer_id) AS DOUBLE)"))
def active_customers_over_time(t: Tables):
    return _time(t, "total_active_customers", "month")


@query("M12 M13 M14 M5", _time_sql("day", "SELECT d, customer_id FROM fact WHERE order_status = 'F'", "CAST(count(DISTINCT customer_id) AS DOUBLE)"))
def active_customers_by_day(t: Tables):
    return _time(t, "total_active_customers", "day", filters={"order_status": [DELIVERED]})


@query("M12 M13 M14 M6", _time_sql("day", "SELECT d, hours FROM fact", "avg(hours)"))
def delivery_time_over_time(t: Tables):
    return _time(t, "average_delivery_time", "day")


@query(
    "M12 M13 M14 M3",
    _time_sql(
        "month",
        "SELECT DISTINCT d, order_id, review_id, review_score FROM fact JOIN reviews USING (order_id)",
        "avg(review_score)",
    ),
)
def review_score_over_time(t: Tables):
    return _time(t, "average_review", "month")


@query(
    "M12 M13 M14 M4",
    _time_sql(
        "day",
        "SELECT DISTINCT d, order_id, review_id FROM fact JOIN reviews USING (order_id)",
        "CAST(count(*) AS DOUBLE)",
    ),
)
def review_count_over_time(t: Tables):
    return _time(t, "total_reviews", "day")


@query(
    "M12 M13 M14 M8",
    _time_sql(
        "month",
        "SELECT DISTINCT d, order_id, defect_score FROM fact JOIN reviews USING (order_id)",
        "avg(defect_score)",
    ),
)
def defect_ratio_over_time(t: Tables):
    return _time(t, "average_defect_ratio", "month")


@query(
    "M10 J11 M11 M12 M13 M14",
    _time_sql(
        "month",
        """SELECT d, price, payment_type FROM (SELECT DISTINCT event_id // 3 AS order_id, event_type AS payment_type FROM events) JOIN fact USING (order_id)
           WHERE order_id IN (SELECT order_id FROM reviews WHERE review_score = 1)""",
        "sum(price)",
        "payment_type",
    ),
)
def sales_over_time_by_payment_type(t: Tables):
    return _time(t, "total_sales", "month", ["payment_type"], {"review_score": [1]})


@query("M9 M11 M12 M13 M14", _time_sql("month", "SELECT d, price FROM fact UNION ALL SELECT CAST(unnest(generate_series(date_trunc('year', min(d)) - INTERVAL 1 YEAR, make_date(year(max(d)), 12, 31), INTERVAL 1 DAY)) AS DATE), 0 FROM fact", "sum(price)").replace("date_trunc('year', min(d)) AS DATE) FROM src)", "date_trunc('year', min(d)) AS DATE) FROM fact)"))
def sales_with_zero_for_blank_over_time(t: Tables):
    return _time(t, "total_sales_missing_dates", "month")


@query("M7 M13", _time_sql("month", "SELECT CAST(o_orderdate AS DATE) AS d, o_totalprice AS price FROM orders", "sum(price)"))
def sales_forecast_over_time(t: Tables):
    return _time(t, "total_sales_forecast", "month")


@query(
    "M13 W6",
    with_(
        """SELECT d AS period, round(sum(sum(price)) OVER (PARTITION BY year(d) ORDER BY d), 2) AS value
           FROM delivered_fact GROUP BY d""",
        FACT,
        DELIVERED_FACT,
    ),
)
def single_time_item_on_sold_days(t: Tables):
    ytd = TI.time_calculation(t.model(), "total_sales", "ytd", filters={"order_status": [DELIVERED]})
    sold = t.delivered().select(F.to_date("order_approved_at").alias("period")).distinct()
    return ytd.join(sold, "period", "left_semi").select("period", F.round("value", 2).alias("value"))
