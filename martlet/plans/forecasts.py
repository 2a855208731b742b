"""Queries over resampling and forecasting."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from martlet.operators import forecasting as X
from martlet.plans.registry import query, with_
from martlet.plans.tables import DELIVERED, DELIVERED_FACT, FACT, Tables
from martlet.sources import readers, writers

SERIES = "series AS (SELECT d AS date, price AS sales FROM delivered_fact)"
SPANS = "spans AS (SELECT CAST(min(d) AS DATE) AS a, CAST(max(d) AS DATE) AS b FROM delivered_fact)"
DAILY = """daily AS (SELECT s.date, round(coalesce(sum(sales), 0), 2) AS sales
  FROM (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM spans) s LEFT JOIN series USING (date) GROUP BY 1)"""


def _series(t: Tables, keys=()):
    return X.sales_series(t.fact(), "order_purchase_timestamp", DELIVERED, keys=keys)


def rounded(df, places: int = 2):
    return df.withColumn("sales", F.round("sales", places))


def _daily(t: Tables):
    return rounded(X.resample_day(_series(t)))


@query(
    "F1 P5 P7",
    with_(
        """SELECT d AS date, price AS sales FROM delivered_fact WHERE d BETWEEN make_date(1997, 1, 1) AND make_date(1998, 8, 30)""",
        FACT,
        DELIVERED_FACT,
    ),
)
def sales_rows_of_window(t: Tables):
    return X.sales_series(
        t.fact(), "order_purchase_timestamp", DELIVERED, dt.date(1997, 1, 1), dt.date(1998, 8, 30)
    )


@query(
    "F1 P8",
    with_(
        """SELECT d AS date, price AS sales FROM delivered_fact WHERE year(d) >= 1997 AND NOT (year(d) = 1998 AND month(d) = 9)""",
        FACT,
        DELIVERED_FACT,
    ),
)
def sales_rows_without_month(t: Tables):
    return X.sales_series(t.fact(), "order_purchase_timestamp", DELIVERED, low=dt.date(1997, 1, 1), incomplete=(1998, 9))


@query("F2", with_("SELECT date, sales FROM daily", FACT, DELIVERED_FACT, SERIES, SPANS, DAILY))
def sales_per_day(t: Tables):
    return _daily(t)


@query(
    "F2",
    """WITH s AS (SELECT l_partkey, CAST(l_shipdate AS DATE) AS date, sum(l_extendedprice) AS sales FROM lineitem WHERE l_quantity = 50 GROUP BY 1, 2),
            d AS (SELECT l_partkey, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM s GROUP BY 1)
       SELECT l_partkey, count(*) AS days, count(*) FILTER (WHERE sales IS NULL) AS empty_days, round(sum(sales), 2) AS sales
       FROM d LEFT JOIN s USING (l_partkey, date) GROUP BY 1""",
)
def many_daily_series(t: Tables):
    rows = t.scan("lineitem").filter("l_quantity = 50").select(
        "l_partkey", F.to_date("l_shipdate").alias("date"), F.col("l_extendedprice").alias("sales")
    )
    daily = X.resample_day(rows, ["l_partkey"])
    return daily.groupBy("l_partkey").agg(
        F.count(F.lit(1)).alias("days"),
        F.count_if(F.col("sales") == 0).alias("empty_days"),
        F.round(F.sum("sales"), 2).alias("sales"),
    )


@query(
    "F3 K5",
    with_(
        """, w AS (SELECT CAST(date + CAST((7 - isodow(date)) AS INTEGER) AS DATE) AS date, sum(sales) AS sales FROM daily GROUP BY 1)
           SELECT date, round(sales, 2) AS sales FROM w WHERE date < (SELECT max(date) FROM w)""",
        FACT,
        DELIVERED_FACT,
        SERIES,
        SPANS,
        DAILY,
    ).replace(") , w AS", "), w AS"),
)
def sales_per_week(t: Tables):
    return rounded(X.resample_week(_series(t)))


@query(
    "F4",
    with_(
        "SELECT last_day(date) AS date, round(sum(sales), 2) AS sales FROM daily GROUP BY 1",
        FACT,
        DELIVERED_FACT,
        SERIES,
        SPANS,
        DAILY,
    ),
)
def sales_per_month(t: Tables):
    return rounded(X.resample_month(_series(t)))


@query(
    "F5 W9",
    """WITH d AS (SELECT CAST(o_orderdate AS DATE) AS date, CASE WHEN count(*) > 5 THEN round(sum(o_totalprice), 2) END AS sales FROM orders GROUP BY 1),
            f AS (SELECT date, coalesce(
                first_value(sales IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
                last_value(sales IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS sales FROM d),
            s AS (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM d)
       SELECT s.date, round(coalesce(sales, 0), 2) AS sales FROM s LEFT JOIN f USING (date)""",
)
def filled_then_resampled(t: Tables):
    daily = t.scan("orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(
        F.when(F.count(F.lit(1)) > 5, F.round(F.sum("o_totalprice"), 2)).alias("sales")
    )
    return rounded(X.fill_then_resample(daily))


@query(
    "F6",
    with_(
        """SELECT date, sales, CASE WHEN row_number() OVER (ORDER BY date DESC) <= 31 THEN 'test' ELSE 'train' END AS split FROM daily""",
        FACT,
        DELIVERED_FACT,
        SERIES,
        SPANS,
        DAILY,
    ),
)
def chronological_holdout(t: Tables):
    return X.holdout(_daily(t), 31)


@query(
    "F6",
    with_(
        """SELECT date, sales, CASE WHEN row_number() OVER (ORDER BY date DESC) <= floor((SELECT count(*) FROM daily) * CAST('0.2' AS DOUBLE))
                  THEN 'test' ELSE 'train' END AS split FROM daily""",
        FACT,
        DELIVERED_FACT,
        SERIES,
        SPANS,
        DAILY,
    ),
)
def holdout_by_share(t: Tables):
    return X.holdout_share(_daily(t), 0.2)


@query(
    "F7",
    """WITH e AS (SELECT event_id, CASE WHEN event_type <> 'error' THEN value END AS value, CASE WHEN event_type <> 'view' THEN event_type END AS kind,
                         CASE WHEN event_type <> 'click' THEN CAST(user_id AS DOUBLE) END AS who FROM events),
            s AS (SELECT skewness(value) AS sv, avg(value) AS av, median(value) AS mv, skewness(who) AS sw, avg(who) AS aw, median(who) AS mw FROM e),
            k AS (SELECT kind FROM e WHERE kind IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, kind LIMIT 1)
       SELECT event_id, round(coalesce(value, CASE WHEN sv <= 1 THEN av ELSE mv END), 6) AS value,
              round(coalesce(who, CASE WHEN sw <= 1 THEN aw ELSE mw END), 6) AS who, coalesce(e.kind, k.kind) AS kind FROM e, s, k""",
)
def imputed_by_skew(t: Tables):
    kind = F.col("event_type")
    rows = t.scan("events").select(
        "event_id",
        F.when(kind != "error", F.col("value")).alias("value"),
        F.when(kind != "view", kind).alias("kind"),
        F.when(kind != "click", F.col("user_id").cast("double")).alias("who"),
    )
    out = X.impute_by_skew(rows, rows, ["value", "who", "kind"])
    return out.select("event_id", F.round("value", 6).alias("value"), F.round("who", 6).alias("who"), "kind")


@query(
    "F7",
    """WITH e AS (SELECT event_id, CASE WHEN event_type NOT IN ('error', 'view') THEN ts END AS seen, CASE WHEN event_id % 7 > 2 THEN CAST(ts AS DATE) END AS day,
                         CASE WHEN event_type <> 'click' THEN value END AS value FROM events),
            m AS (SELECT skewness(value) AS s, avg(value) AS a, median(value) AS q FROM e),
            d AS (SELECT day FROM e WHERE day IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, day LIMIT 1),
            t AS (SELECT seen FROM e WHERE seen IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, seen LIMIT 1),
            w AS (SELECT event_id, value, last_value(seen IGNORE NULLS) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS seen,
                         last_value(day IGNORE NULLS) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS day FROM e)
       SELECT event_id, coalesce(w.seen, t.seen) AS seen, coalesce(w.day, d.day) AS day,
              round(coalesce(value, CASE WHEN s <= 1 THEN a ELSE q END), 6) AS value FROM w, m, d, t""",
)
def imputed_with_dates(t: Tables):
    """Dates and times carried forward in the order of the events, in the same step as the other columns."""
    rows = t.scan("events").select(
        "event_id",
        F.when(~F.col("event_type").isin("error", "view"), F.col("ts")).alias("seen"),
        F.when(F.col("event_id") % 7 > 2, F.to_date("ts")).alias("day"),
        F.when(F.col("event_type") != "click", F.col("value")).alias("value"),
    )
    out = X.impute_by_skew(rows, rows, ["seen", "day", "value"], ["event_id"])
    return out.withColumn("value", F.round("value", 6))


@query(
    "F9",
    with_(
        """, p AS (SELECT date, sales, lag(sales, 7) OVER (ORDER BY date) AS predicted FROM daily)
           SELECT round(avg(abs((sales - predicted) / sales)) FILTER (WHERE sales <> 0), 6) AS mape,
                  count(*) FILTER (WHERE sales <> 0 AND predicted IS NOT NULL) AS n FROM p""",
        FACT,
        DELIVERED_FACT,
        SERIES,
        SPANS,
        DAILY,
    ).replace(") , p AS", "), p AS"),
)
def error_of_seasonal_naive(t: Tables):
    return X.mape(X.seasonal_naive(_daily(t), 7)).withColumn("mape", F.round("mape", 6))


@query("F8")
def forecast_daily_total(t: Tables):
    return X.forecast(X.resample_day(_series(t)), "day")


@query("F8")
def forecast_weekly_total(t: Tables):
    return X.forecast(X.resample_week(_series(t)), "week")


@query("F8")
def forecast_monthly_total(t: Tables):
    return X.forecast(X.resample_month(_series(t)), "month")


@query("F8")
def forecast_per_product_and_month(t: Tables):
    return X.forecast(X.resample_month(_series(t, ["product_id"]), ["product_id"]), "month", keys=["product_id"])


@query(
    "F8 F11",
    with_(
        """, m AS (SELECT product_id, last_day(d) AS date, sum(price) AS sales FROM delivered_fact GROUP BY 1, 2),
             s AS (SELECT product_id, min(date) AS a, max(date) AS b FROM m GROUP BY 1)
           SELECT product_id, last_day(CAST(b + INTERVAL 10 DAY AS DATE)) AS first_date, last_day(CAST(b + INTERVAL 10 DAY AS DATE)) AS last_date, CAST(1 AS BIGINT) AS steps,
                  date_diff('month', a, b) > 0 AS has_error, true AS not_worse FROM s""",
        FACT,
        DELIVERED_FACT,
    ).replace(") , m AS", "), m AS"),
)
def forecast_facts_per_product(t: Tables):
    """Every product is forecast for its next month, and no simple model would have done better on the month held out."""
    monthly = X.resample_month(_series(t, ["product_id"]), ["product_id"])
    w = Window.partitionBy("product_id").orderBy("date")
    simple = monthly.select("product_id", "sales", F.lag("sales").over(w).alias("last"), F.lag("sales", 12).over(w).alias("naive"), F.lead("date").over(w).alias("_next")).filter("_next is null")
    off = lambda c: F.when(F.col("sales") != 0, F.abs((F.col("sales") - F.col(c)) / F.col("sales")))
    ahead = X.forecast(monthly, "month", keys=["product_id"]).groupBy("product_id").agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count(F.lit(1)).alias("steps"), F.max("mape").alias("mape")
    )
    joined = ahead.join(simple, "product_id")
    least = F.least(off("last"), off("naive"))
    return joined.select(
        "product_id", "first_date", "last_date", "steps", (F.col("mape").isNotNull()).alias("has_error"), F.coalesce(F.col("mape") <= least + 1e-9, F.lit(True)).alias("not_worse")
    )


@query("F10 S5")
def forecast_rows_stored(t: Tables):
    path = t.scratch("forecast")
    predictions = X.forecast(X.resample_day(_series(t)), "day")
    writers.append_path(X.forecast_rows(predictions, dt.datetime(2024, 1, 31)), path)
    return readers.scan_path(t.spark, path, merge_schema=True)


@query(
    "F11",
    with_(
        "SELECT CAST(unnest(generate_series(b + 1, b + 31, INTERVAL 1 DAY)) AS DATE) AS date FROM spans",
        FACT,
        DELIVERED_FACT,
        SPANS,
    ),
)
def dates_to_forecast(t: Tables):
    return X.future_dates(_series(t), 31)


@query(
    "F12",
    with_(
        """, a AS (SELECT date, sales FROM daily WHERE date <= DATE '2001-06-30'),
             p AS (SELECT CAST(date + INTERVAL 364 DAY AS DATE) AS date, sales AS predicted_sales FROM daily)
           SELECT date, sales, predicted_sales FROM a FULL JOIN p USING (date)""",
        FACT,
        DELIVERED_FACT,
        SERIES,
        SPANS,
        DAILY,
    ).replace(") , a AS", "), a AS"),
)
def actual_next_to_predicted(t: Tables):
    daily = _daily(t)
    predicted = daily.select(F.date_add("date", 364).alias("date"), F.col("sales").alias("predicted_sales"))
    return X.compare(daily.filter("date <= date'2001-06-30'"), predicted)
