"""Queries over aggregations, windows, top-k and paging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlet.operators import aggregates as A
from martlet.operators import profiles as PR
from martlet.operators import topk as K
from martlet.operators import windows as W
from martlet.plans.registry import query, with_
from martlet.plans.tables import DELIVERED_FACT, FACT, RUNS, Tables
from martlet.sources.writers import append_path
from martlet.operators.drift import drift_scores, metric_history


def r(column: str, places: int = 6):
    return F.round(column, places).alias(column)


# Added before means are rounded, here and in SQL, so that exact ties do not hang on the order of a sum.
OFF_TIES = 1e-7

# -- aggregations -------------------------------------------------------------------------------------


@query(
    "A1",
    with_(
        """SELECT count(*) AS total_rows, count(DISTINCT customer_id) AS unique_customers,
                  count(DISTINCT product_id) AS unique_products, count(DISTINCT order_id) AS unique_orders,
                  round(count(*) / count(DISTINCT order_id), 6) AS avg_rows_per_key FROM fact""",
        FACT,
    ),
)
def fact_key_statistics(t: Tables):
    keys = {"unique_customers": "customer_id", "unique_products": "product_id", "unique_orders": "order_id"}
    out = A.key_stats(t.fact(), keys, per="order_id")
    return out.withColumn("avg_rows_per_key", F.round("avg_rows_per_key", 6))


@query("A2", with_("SELECT order_status, count(*) AS count FROM fact GROUP BY 1", FACT))
def status_frequency(t: Tables):
    return A.freq(t.fact(), "order_status")


@query("A2", with_("SELECT product_id, count(*) AS count FROM fact GROUP BY 1", FACT))
def product_frequency(t: Tables):
    return A.freq(t.fact(), "product_id")


@query("A3", with_("SELECT customer_id, count(DISTINCT order_id) AS order_count FROM fact GROUP BY 1", FACT))
def orders_per_customer(t: Tables):
    return A.distinct_per(t.fact(), "customer_id", "order_id", "order_count")


@query(
    "A4",
    with_(
        """SELECT count(*) AS groups, count(*) FILTER (WHERE n = 1) AS singletons,
                  round(100 * avg(CASE WHEN n = 1 THEN 1 ELSE 0 END), 6) AS singleton_percent
           FROM (SELECT order_id, count(*) AS n FROM fact GROUP BY 1)""",
        FACT,
    ),
)
def single_item_orders(t: Tables):
    return A.singleton_share(t.fact(), "order_id").withColumn("singleton_percent", F.round("singleton_percent", 6))


@query(
    "A4",
    with_(
        """SELECT count(*) AS groups, count(*) FILTER (WHERE n = 1) AS singletons,
                  round(100 * avg(CASE WHEN n = 1 THEN 1 ELSE 0 END), 6) AS singleton_percent
           FROM (SELECT customer_id, count(DISTINCT order_id) AS n FROM fact GROUP BY 1)""",
        FACT,
    ),
)
def single_order_customers(t: Tables):
    out = A.singleton_share(t.fact(), "customer_id", "order_id")
    return out.withColumn("singleton_percent", F.round("singleton_percent", 6))


@query(
    "A5",
    """SELECT items_count, count(*) AS groups FROM (SELECT l_orderkey, count(*) AS items_count FROM lineitem GROUP BY 1)
       GROUP BY 1""",
)
def items_per_order_histogram(t: Tables):
    return A.size_histogram(t.scan("lineitem"), "l_orderkey")


@query(
    "A6",
    """WITH e AS (SELECT min(l_extendedprice) AS lo, (max(l_extendedprice) - min(l_extendedprice)) / 50 AS w FROM lineitem)
       SELECT CAST(least(floor((l_extendedprice - lo) / w), 49) AS INTEGER) AS bin, count(*) AS count,
              round(any_value(lo) + least(floor((l_extendedprice - lo) / w), 49) * any_value(w), 4) AS bin_start
       FROM lineitem, e GROUP BY least(floor((l_extendedprice - lo) / w), 49)""",
)
def price_histogram(t: Tables):
    return A.histogram(t.scan("lineitem"), "l_extendedprice", 50).withColumn("bin_start", F.round("bin_start", 4))


@query(
    "A6",
    """WITH e AS (SELECT min(l_extendedprice) AS lo, (max(l_extendedprice) - min(l_extendedprice)) / 20 AS w FROM lineitem),
            b AS (SELECT l_returnflag, least(floor((l_extendedprice - lo) / w), 19) AS bin, lo, w FROM lineitem, e),
            c AS (SELECT l_returnflag, bin, any_value(lo) AS lo, any_value(w) AS w, count(*) AS n FROM b GROUP BY 1, 2)
       SELECT l_returnflag, CAST(bin AS INTEGER) AS bin, n AS count, round(lo + bin * w, 4) AS bin_start,
              round(n / (sum(n) OVER (PARTITION BY l_returnflag) * w), 10) AS density FROM c""",
)
def price_density_by_flag(t: Tables):
    out = A.histogram(t.scan("lineitem"), "l_extendedprice", 20, by="l_returnflag")
    return out.withColumns({"bin_start": F.round("bin_start", 4), "density": F.round("density", 10)})


@query(
    "A7",
    """WITH q AS (SELECT o_orderstatus, quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS median,
                         quantile_cont(o_totalprice, 0.75) AS q3 FROM orders GROUP BY 1)
       SELECT o_orderstatus, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3,
              min(o_totalprice) FILTER (WHERE o_totalprice >= q1 - 1.5 * (q3 - q1) AND o_totalprice <= q3 + 1.5 * (q3 - q1)) AS whisker_low,
              max(o_totalprice) FILTER (WHERE o_totalprice >= q1 - 1.5 * (q3 - q1) AND o_totalprice <= q3 + 1.5 * (q3 - q1)) AS whisker_high
       FROM orders JOIN q USING (o_orderstatus) GROUP BY 1, 2, 3, 4, q1, median, q3""",
)
def order_value_box_plot(t: Tables):
    out = A.box_stats(t.scan("orders"), "o_totalprice", "o_orderstatus")
    return out.select("o_orderstatus", r("q1", 4), r("median", 4), r("q3", 4), "whisker_low", "whisker_high")


@query(
    "A8",
    with_(
        """SELECT 'price' AS "column", count(price) AS count, round(avg(price), 4) AS mean, round(stddev(price), 4) AS stddev,
                  min(price) AS min, max(price) AS max FROM fact
           UNION ALL
           SELECT 'freight_value', count(freight_value), round(avg(freight_value), 4), round(stddev(freight_value), 4),
                  min(freight_value), max(freight_value) FROM fact""",
        FACT,
    ),
)
def describe_prices(t: Tables):
    out = A.describe(t.fact(), ["price", "freight_value"])
    return out.withColumns({"mean": F.round("mean", 4), "stddev": F.round("stddev", 4)})


@query(
    "A9",
    with_(
        """, m AS (SELECT max(price) AS p FROM delivered_fact), x AS (SELECT price / p * 10 AS rating FROM delivered_fact, m)
           SELECT unnest(['rating_min', 'rating_25p', 'rating_50p', 'rating_75p', 'rating_max', 'rating_mean', 'rating_stddev'])
                    AS metric_name,
                  unnest([round(min(rating), 6), round(quantile_cont(rating, 0.25), 6), round(quantile_cont(rating, 0.5), 6),
                          round(quantile_cont(rating, 0.75), 6), round(max(rating), 6), round(avg(rating), 6),
                          round(stddev(rating), 6)]) AS value FROM x""",
        FACT,
        DELIVERED_FACT,
    ).replace(") , m AS", "), m AS"),
)
def rating_metric_summary(t: Tables):
    rated = A.scale_by_max(t.delivered(), "price", 10.0, "rating")
    return A.metric_summary(rated, "rating").withColumn("value", F.round("value", 6))


@query(
    "A10 R2",
    """SELECT l_orderkey, l_linenumber, l_partkey,
              round(l_extendedprice / (SELECT max(l_extendedprice) FROM lineitem) * 10, 8) AS preference FROM lineitem""",
)
def preference_by_max_price(t: Tables):
    out = A.scale_by_max(t.scan("lineitem"), "l_extendedprice", 10.0, "preference")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", r("preference", 8))


@query("A12", with_("SELECT customer_id, round(avg(price) + 1e-7, 4) AS customer_avg_price FROM delivered_fact GROUP BY 1", FACT, DELIVERED_FACT))
def average_price_per_customer(t: Tables):
    return A.mean_per(t.delivered(), "customer_id", "price", "customer_avg_price").withColumn(
        "customer_avg_price", F.round(F.col("customer_avg_price") + OFF_TIES, 4)
    )


@query("A13", "SELECT l_suppkey, round(sum(l_extendedprice), 2) AS total, count(*) AS count FROM lineitem GROUP BY 1")
def revenue_per_supplier(t: Tables):
    return A.sum_count_per(t.scan("lineitem"), "l_suppkey", "l_extendedprice").withColumn("total", F.round("total", 2))


@query(
    "A13",
    "SELECT round(sum(l_extendedprice), 2) AS total, count(*) AS count, count(DISTINCT l_suppkey) AS groups FROM lineitem",
)
def revenue_overall(t: Tables):
    per = A.sum_count_per(t.scan("lineitem"), "l_suppkey", "l_extendedprice")
    return A.sum_of_groups(per).withColumn("total", F.round("total", 2))


@query(
    "A14",
    with_("SELECT d AS date, round(sum(price), 2) AS sales FROM delivered_fact GROUP BY d", FACT, DELIVERED_FACT),
)
def sales_by_date(t: Tables):
    out = A.sales_by_date(t.delivered(), F.to_date("order_purchase_timestamp"), "price")
    return out.withColumn("sales", F.round("sales", 2))


@query(
    "A15",
    """SELECT l_returnflag, CAST((i - 1) // 1000 AS INTEGER) AS part, list(l_partkey ORDER BY i) AS items
       FROM (SELECT l_returnflag, l_partkey, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_partkey) AS i FROM lineitem) GROUP BY 1, 2""",
)
def items_per_flag_in_chunks(t: Tables):
    """Three keys with a third of all rows each: lists in chunks of a thousand."""
    return A.list_per(t.scan("lineitem"), "l_returnflag", "l_partkey", "items", 1000)


@query(
    "A15",
    """SELECT l_returnflag, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_partkey)::BIGINT AS position, l_partkey AS value FROM lineitem""",
)
def items_per_flag_in_rows(t: Tables):
    return A.list_rows(t.scan("lineitem"), "l_returnflag", "l_partkey")


@query("A15", "SELECT l_orderkey, 0::INT AS part, list(l_partkey ORDER BY l_partkey) AS items FROM lineitem GROUP BY 1")
def items_per_order_list(t: Tables):
    return A.list_per(t.scan("lineitem"), "l_orderkey", "l_partkey", "items")


@query("A16 X12", "SELECT p_type, 0::INT AS part, string_agg(p_brand, ', ' ORDER BY p_brand) AS brands FROM (SELECT DISTINCT p_type, p_brand FROM part) GROUP BY 1")
def brands_per_type_text(t: Tables):
    pairs = A.distinct_pairs(t.scan("part"), "p_type", "p_brand")
    return A.joined_list_per(pairs, "p_type", "p_brand", name="brands")


@query("A17", with_("SELECT DISTINCT customer_id, product_id FROM fact", FACT))
def customer_product_pairs(t: Tables):
    return A.distinct_pairs(t.fact(), "customer_id", "product_id")


@query(
    "A18",
    """SELECT lang, source, min(doc_id) AS doc_id FROM documents GROUP BY 1, 2""",
)
def first_document_per_source(t: Tables):
    return A.dedupe(t.scan("documents").select("lang", "source", "doc_id"), ["lang", "source"], F.col("doc_id"))


@query(
    "A19",
    with_(
        """SELECT count(DISTINCT customer_id) AS total_users, count(DISTINCT product_id) AS total_items,
                  count(*) AS total_interactions,
                  round(1 - count(*) / (count(DISTINCT customer_id) * count(DISTINCT product_id)), 8) AS matrix_sparsity,
                  round(count(*) / count(DISTINCT customer_id), 6) AS avg_interactions_per_user,
                  round(count(*) / count(DISTINCT product_id), 6) AS avg_interactions_per_item FROM delivered_fact""",
        FACT,
        DELIVERED_FACT,
    ),
)
def interaction_matrix_statistics(t: Tables):
    out = A.matrix_stats(t.delivered(), "customer_id", "product_id")
    return out.withColumns(
        {
            "matrix_sparsity": F.round("matrix_sparsity", 8),
            "avg_interactions_per_user": F.round("avg_interactions_per_user", 6),
            "avg_interactions_per_item": F.round("avg_interactions_per_item", 6),
        }
    )


SCORES = """scores AS (
  SELECT start_time AS timestamp, metric_name, value - lag(value) OVER w AS drift_score
  FROM runs WINDOW w AS (PARTITION BY metric_name ORDER BY start_time) QUALIFY lag(value) OVER w IS NOT NULL)"""


@query(
    "A20 D11",
    with_(
        """SELECT metric_name, round(avg(drift_score), 4) AS drift_mean, round(stddev(drift_score), 4) AS drift_std,
                  round(max(drift_score), 4) AS drift_max, round(min(drift_score), 4) AS drift_min,
                  'abs_diff' AS statistical_test, 2.5::DOUBLE AS threshold, round(max(drift_score), 4) > 2.5 AS above_threshold
           FROM scores GROUP BY 1""",
        RUNS,
        SCORES,
    ),
)
def drift_score_summary(t: Tables):
    return A.drift_summary(drift_scores(metric_history(t.runs())), 2.5)


EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


@query(
    "A21 D12",
    with_(
        "SELECT timestamp, "
        + ", ".join(f"round(max(CASE WHEN metric_name = '{e}' THEN drift_score END), 6) AS {e}" for e in EVENT_TYPES)
        + " FROM scores GROUP BY 1",
        RUNS,
        SCORES,
    ),
)
def drift_score_pivot(t: Tables):
    out = A.pivot_scores(drift_scores(metric_history(t.runs())), EVENT_TYPES)
    return out.select("timestamp", *[r(e) for e in EVENT_TYPES])


@query(
    "A22",
    """WITH c AS (SELECT l_partkey, count(*) AS v FROM lineitem GROUP BY 1),
            o AS (SELECT v, row_number() OVER (ORDER BY v) AS i, count(*) OVER () AS n FROM c)
       SELECT round(1 - 2 * sum((n + 1 - i) * v) / (any_value(n) * sum(v)), 8) AS gini FROM o""",
)
def item_popularity_gini(t: Tables):
    popularity = t.scan("lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    return A.gini(popularity, "n").withColumn("gini", F.round("gini", 8))


@query(
    "A23",
    """SELECT count(DISTINCT l_partkey) AS recommended, (SELECT count(*) FROM part) AS catalog_size,
              round(count(DISTINCT l_partkey) * 100.0::DOUBLE / (SELECT count(*) FROM part), 6) AS catalog_coverage_percent
       FROM lineitem WHERE l_quantity >= 49""",
)
def catalog_coverage(t: Tables):
    recs = t.scan("lineitem").filter("l_quantity >= 49").select(F.col("l_partkey").alias("product_id"))
    out = A.coverage(recs, t.products())
    return out.withColumn("catalog_coverage_percent", F.round("catalog_coverage_percent", 6))


@query(
    "A24",
    """WITH a AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'A'),
            b AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R')
       SELECT (SELECT count(*) FROM a) AS train_items, (SELECT count(*) FROM b) AS test_items,
              (SELECT count(*) FROM a JOIN b USING (l_partkey)) AS common_items,
              round(100.0::DOUBLE * (SELECT count(*) FROM a JOIN b USING (l_partkey)) / (SELECT count(*) FROM b), 6) AS items_overlap_percentage""",
)
def item_overlap_of_splits(t: Tables):
    items = t.scan("lineitem")
    out = A.split_overlap(items.filter("l_returnflag = 'A'"), items.filter("l_returnflag = 'R'"), "l_partkey", "items")
    return out.withColumn("items_overlap_percentage", F.round("items_overlap_percentage", 6))


PROFILED = ["l_partkey", "l_quantity", "l_extendedprice", "l_discount"]


@query(
    "A25",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS rows, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS "distinct",
                   round(CAST(min({c}) AS DOUBLE), 4) AS min, round(CAST(max({c}) AS DOUBLE), 4) AS max,
                   round(avg({c}), 4) AS mean, round(stddev({c}), 4) AS stddev FROM lineitem"""
        for c in PROFILED
    ),
)
def column_profile(t: Tables):
    out = A.profile(t.scan("lineitem"), PROFILED, exact_distinct=True)
    return out.select(
        "column",
        "rows",
        "nulls",
        "distinct",
        F.round(F.col("min").cast("double"), 4).alias("min"),
        F.round(F.col("max").cast("double"), 4).alias("max"),
        r("mean", 4),
        r("stddev", 4),
    )


@query("A25")
def column_profile_quantiles(t: Tables):
    return A.profile_quantiles(t.scan("lineitem"), PROFILED, [0.05, 0.25, 0.5, 0.75, 0.95])


_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_MERGED_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) AS rows, count(*) - count({c}) AS nulls, round(min({c}), 4)::DOUBLE AS min_number, round(max({c}), 4)::DOUBLE AS max_number,
        NULL::VARCHAR AS min_text, NULL::VARCHAR AS max_text, round(avg({c}), 4) AS mean, round(stddev({c}), 4) AS stddev, true AS distinct_in_bounds, true AS median_in_bounds FROM lineitem"""
    for c in _NUMBERS
) + " UNION ALL " + " UNION ALL ".join(
    f"""SELECT '{c}', count(*), count(*) - count({c}), NULL, NULL, min({x}), max({x}), NULL, NULL, true, NULL FROM lineitem"""
    for c, x in (("l_returnflag", "l_returnflag"), ("l_linestatus", "l_linestatus"), ("l_shipdate", "CAST(l_shipdate AS VARCHAR)"))
)


def _rank_of(c: str):
    """Shares of the values under, and up to, the median of column ``c`` in ``_medians``."""
    value, median = F.col(c).cast("double"), F.col(f"_medians.{c}")
    return F.struct(F.lit(c).alias("column"), F.avg((value < median).cast("double")).alias("under"), F.avg((value <= median).cast("double")).alias("upto"))


@query("A25", _MERGED_SQL)
def column_profile_merged(t: Tables):
    """All columns of the items: a state for each month, stored, read back and merged, held against exact counts and ranks."""
    path, items = t.scratch("profile"), t.scan("lineitem")
    monthly = items.withColumn("month", F.trunc("l_shipdate", "month"))
    append_path(PR.profile_states(monthly, ["month"]), path)
    out = PR.read_states(PR.merge_states(t.spark.read.parquet(path)), [0.5])
    exact = reduce(DataFrame.unionAll, [items.select(c).distinct().agg(F.lit(c).alias("column"), F.count(c).alias("exact")) for c in items.columns])
    medians = out.filter("quantiles is not null").select("column", F.get("quantiles", F.lit(0)).alias("median"))
    one_row = medians.agg(F.struct(*[F.max(F.when(F.col("column") == c, F.col("median"))).alias(c) for c in _NUMBERS])).scalar()
    below = items.select(*_NUMBERS, one_row.alias("_medians"))
    ranks = below.agg(F.array(*[_rank_of(c) for c in _NUMBERS]).alias("_ranks")).select(F.inline("_ranks"))
    joined = out.join(exact, "column").join(ranks, "column", "left")
    return joined.select(
        "column",
        "rows",
        "nulls",
        *[r(c, 4) for c in ("min_number", "max_number")],
        "min_text",
        "max_text",
        *[r(c, 4) for c in ("mean", "stddev")],
        F.col("exact").between(F.col("distinct_low"), F.col("distinct_high")).alias("distinct_in_bounds"),
        ((F.col("under") <= 0.5 + PR.RANK_ERROR) & (F.col("upto") >= 0.5 - PR.RANK_ERROR)).alias("median_in_bounds"),
    )


@query(
    "A26",
    """SELECT CAST(i AS INTEGER) - 1 AS dimension, round(avg(abs(CAST(w AS DOUBLE))), 6) AS importance
       FROM (SELECT unnest(embedding) AS w, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY i""",
)
def factor_importance(t: Tables):
    factors = t.scan("embeddings").select(F.col("embedding").cast("array<double>").alias("features"))
    return A.factor_importance(factors).withColumn("importance", F.round("importance", 6))


# -- windows ------------------------------------------------------------------------------------------


@query(
    "W2",
    """WITH c AS (SELECT l_partkey, count(*) AS count FROM lineitem GROUP BY 1)
       SELECT l_partkey, count, CAST(sum(count) OVER w AS BIGINT) AS cumulative_count,
              round(sum(count) OVER w * 100.0::DOUBLE / (SELECT count(*) FROM lineitem), 6) AS cumulative_percentage
       FROM c WINDOW w AS (ORDER BY count DESC, l_partkey)""",
)
def product_pareto(t: Tables):
    out = W.pareto(t.scan("lineitem"), "l_partkey")
    return out.withColumn("cumulative_percentage", F.round("cumulative_percentage", 6))


@query(
    "W3",
    """WITH c AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1),
            p AS (SELECT sum(n) OVER (ORDER BY n DESC, l_partkey) * 100 / (SELECT count(*) FROM lineitem) AS pct FROM c)
       SELECT count(*) FILTER (WHERE pct <= 80) AS groups_within, count(*) AS groups,
              round(count(*) FILTER (WHERE pct <= 80) * 100.0::DOUBLE / count(*), 6) AS percent_of_groups FROM p""",
)
def products_for_80_percent(t: Tables):
    out = W.pareto_cut(t.scan("lineitem"), "l_partkey", 80.0)
    return out.withColumn("percent_of_groups", F.round("percent_of_groups", 6))


@query(
    "W4",
    with_(
        """SELECT run_id, metric_name, value, lag(value) OVER w AS previous_value, lag(run_id) OVER w AS previous_run_id
           FROM runs WINDOW w AS (PARTITION BY metric_name ORDER BY start_time)""",
        RUNS,
    ),
)
def runs_with_previous(t: Tables):
    history = metric_history(t.runs())
    out = W.with_previous(history, ["metric_name"], "start_time", ["value", "run_id"])
    return out.select("run_id", "metric_name", "value", "previous_value", "previous_run_id")


@query(
    "W5",
    with_(
        """SELECT metric_name, run_id, value, CAST(row_number() OVER w AS INTEGER) AS rn FROM runs
           WINDOW w AS (PARTITION BY metric_name ORDER BY start_time DESC) QUALIFY row_number() OVER w <= 2""",
        RUNS,
    ),
)
def latest_two_runs(t: Tables):
    out = W.latest_n(metric_history(t.runs()), ["metric_name"], 2, F.desc("start_time"))
    return out.select("metric_name", "run_id", "value", "rn")


@query(
    "W6",
    """WITH d AS (SELECT o_orderpriority, CAST(o_orderdate AS DATE) AS date, sum(o_totalprice) AS sales FROM orders GROUP BY 1, 2)
       SELECT o_orderpriority, date, round(sales, 2) AS sales,
              round(sum(sales) OVER (PARTITION BY o_orderpriority, date_trunc('month', date) ORDER BY date), 2) AS mtd,
              round(sum(sales) OVER (PARTITION BY o_orderpriority, year(date) ORDER BY date), 2) AS ytd FROM d""",
)
def running_period_totals(t: Tables):
    daily = (
        t.scan("orders")
        .groupBy("o_orderpriority", F.to_date("o_orderdate").alias("date"))
        .agg(F.sum("o_totalprice").alias("sales"))
    )
    out = W.period_to_date(daily, ["o_orderpriority"], "date", "sales", "month", "mtd")
    out = W.period_to_date(out, ["o_orderpriority"], "date", "sales", "year", "ytd")
    return out.select("o_orderpriority", "date", r("sales", 2), r("mtd", 2), r("ytd", 2))


@query(
    "W7",
    """WITH m AS (SELECT o_orderstatus, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, sum(o_totalprice) AS sales
                  FROM orders GROUP BY 1, 2)
       SELECT a.o_orderstatus, a.month, round(a.sales, 2) AS sales, round(b.sales, 2) AS sales_before,
              round(a.sales / b.sales - 1, 6) AS sales_change
       FROM m a LEFT JOIN m b ON a.o_orderstatus = b.o_orderstatus AND b.month = a.month - INTERVAL 12 MONTH""",
)
def month_over_prior_year(t: Tables):
    monthly = (
        t.scan("orders")
        .groupBy("o_orderstatus", F.trunc("o_orderdate", "month").alias("month"))
        .agg(F.sum("o_totalprice").alias("sales"))
    )
    out = W.period_over_period(monthly, ["o_orderstatus"], "month", "sales")
    return out.select("o_orderstatus", "month", r("sales", 2), r("sales_before", 2), r("sales_change", 6))


@query(
    "W8",
    """SELECT l_suppkey, l_partkey, l_extendedprice FROM (SELECT DISTINCT l_suppkey, l_partkey, l_extendedprice FROM lineitem)
       QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_partkey) = 1""",
)
def best_sale_per_supplier(t: Tables):
    sales = t.scan("lineitem").select("l_suppkey", "l_partkey", "l_extendedprice")
    return A.dedupe(sales, ["l_suppkey"], F.desc("l_extendedprice"), F.col("l_partkey"))


@query(
    "W9",
    """WITH d AS (SELECT event_type, CAST(ts AS DATE) AS date, CASE WHEN avg(value) > 10 THEN round(avg(value), 6) END AS v
                  FROM events GROUP BY 1, 2)
       SELECT event_type, date, coalesce(
           first_value(v IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
           last_value(v IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS v
       FROM d""",
)
def filled_daily_means(t: Tables):
    daily = (
        t.scan("events")
        .groupBy("event_type", F.to_date("ts").alias("date"))
        .agg(F.when(F.avg("value") > 10, F.round(F.avg("value"), 6)).alias("v"))
    )
    return W.fill(daily, ["event_type"], "date", "v")


@query(
    "W10",
    """SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank
       FROM events WHERE event_type = 'view'""",
)
def ranked_views_per_user(t: Tables):
    views = t.scan("events").filter("event_type = 'view'")
    return W.rank_recs(views, "user_id", "event_id", "value").select("user_id", "event_id", "value", "rank")


# -- sorting, limits and paging -----------------------------------------------------------------------


@query("K1", "SELECT o_orderpriority, o_totalprice, o_orderkey FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey")
def sorted_orders(t: Tables):
    orders = t.scan("orders").select("o_orderpriority", "o_totalprice", "o_orderkey")
    return K.sort(orders, "o_orderpriority", F.desc("o_totalprice"), "o_orderkey")


@query("K2", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def head_of_orders(t: Tables):
    return K.head(t.scan("orders").select("o_orderkey", "o_totalprice"), 10, F.desc("o_totalprice"), "o_orderkey")


@query(
    "K3",
    with_(
        "SELECT customer_id, round(sum(price), 2) AS value FROM fact GROUP BY 1 ORDER BY sum(price) DESC, 1 LIMIT 10", FACT
    ),
)
def top_customers(t: Tables):
    return K.top_k(t.fact(), "customer_id", F.sum("price"), 10).withColumn("value", F.round("value", 2))


DAILY = "daily AS (SELECT CAST(o_orderdate AS DATE) AS date, round(sum(o_totalprice), 2) AS sales FROM orders GROUP BY 1)"


def _daily(t: Tables):
    return t.scan("orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("sales")
    )


@query("K4", with_("SELECT * FROM (SELECT * FROM daily ORDER BY date DESC LIMIT 31)", DAILY))
def last_days_of_series(t: Tables):
    return K.tail(_daily(t), 31, "date")


@query("K5", with_("SELECT * FROM daily WHERE date < (SELECT max(date) FROM daily)", DAILY))
def series_without_last_day(t: Tables):
    return K.drop_last_period(_daily(t), "date")


RECS = """recs AS (SELECT 'u' || lpad(CAST(user_id AS VARCHAR), 3, '0') AS customer_id, event_id AS product_id, value AS score,
                          ts AS recommendation_ts_utc FROM events WHERE event_type = 'purchase')"""


def _recs(t: Tables):
    return t.scan("events").filter("event_type = 'purchase'").select(
        F.concat(F.lit("u"), F.lpad(F.col("user_id").cast("string"), 3, "0")).alias("customer_id"),
        F.col("event_id").alias("product_id"),
        F.col("value").alias("score"),
        F.col("ts").alias("recommendation_ts_utc"),
    )


@query(
    "K6",
    with_(
        """SELECT * FROM recs WHERE starts_with(customer_id, 'u01')
           ORDER BY recommendation_ts_utc DESC, score DESC, customer_id, product_id LIMIT 10""",
        RECS,
    ),
)
def latest_recommendations(t: Tables):
    return K.latest_recs(_recs(t), "u01", 10)


@query(
    "R26",
    with_(
        """SELECT customer_id, product_id, score, p_type AS category, p_brand AS product_segment FROM (
             SELECT * FROM recs WHERE starts_with(customer_id, 'u01')
             ORDER BY recommendation_ts_utc DESC, score DESC, customer_id, product_id LIMIT 10)
           LEFT JOIN part ON product_id = p_partkey""",
        RECS,
    ),
)
def personal_recommendations(t: Tables):
    out = K.personal_recs(_recs(t), t.products(), "u01", 10)
    return out.select("customer_id", "product_id", "score", "category", "product_segment")


@query("K7", "SELECT p_partkey AS product_id, p_retailprice AS price FROM part ORDER BY coalesce(price, 0) DESC, product_id")
def catalog_by_price(t: Tables):
    listed = t.scan("part").select(F.col("p_partkey").alias("product_id"), F.col("p_retailprice").alias("price"))
    return K.catalog_sort(listed, "price_desc")


@query(
    "K7",
    """SELECT p_partkey AS product_id, p_name AS name, p_type AS category, p_brand AS product_segment, p_retailprice AS list_price,
              p_size AS stock FROM part""",
)
def catalog_shuffled(t: Tables):
    return K.catalog_sort(t.products(), "newest")


@query("K8", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice, p_partkey LIMIT 12 OFFSET 24")
def catalog_page(t: Tables):
    return K.page(t.scan("part").select("p_partkey", "p_retailprice"), 3, "p_retailprice", "p_partkey")


@query("K8", "SELECT count(*) AS rows, CAST(ceil(count(*) / 12) AS BIGINT) AS pages FROM part")
def catalog_page_count(t: Tables):
    return K.page_count(t.scan("part"))


@query("K9")
def random_products(t: Tables):
    return K.random_n(t.products())


@query("K10")
def sampled_items(t: Tables):
    return K.sample(t.scan("lineitem"), 0.3)
