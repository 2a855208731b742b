"""Queries over sources, projections, joins and set operations."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from martlet.functions.columns import blank_as_null
from martlet.operators import joins as J
from martlet.operators import projections as P
from martlet.operators import sets as U
from martlet.plans.registry import query, with_
from martlet.plans.tables import CUSTOMERS, FACT, REVIEWS, SELLERS, Tables
from martlet.sources import catalog, readers, writers

# -- sources ------------------------------------------------------------------------------------------


@query(
    "S1",
    """SELECT o_orderstatus, count(*) AS orders, round(sum(o_totalprice), 2) AS total,
              min(o_orderdate) AS first_order, max(o_orderkey) AS last_key
       FROM orders GROUP BY o_orderstatus""",
)
def csv_scan_inferred(t: Tables):
    path = t.scratch("orders-csv")
    t.scan("orders").write.option("header", True).csv(path)
    read = readers.read_csv(t.spark, path)
    return read.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("orders"),
        F.round(F.sum("o_totalprice"), 2).alias("total"),
        F.min("o_orderdate").cast("timestamp_ntz").alias("first_order"),
        F.max("o_orderkey").cast("long").alias("last_key"),
    )


@query("S3", "SELECT event_id, date_trunc('millisecond', ts) AS ts FROM events")
def timestamps_to_milliseconds(t: Tables):
    return readers.cast_timestamps(t.scan("events").select("event_id", "ts"))


@query(
    "S4 S8",
    "SELECT o_orderpriority, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1",
)
def table_by_name(t: Tables):
    t.scan("orders").createOrReplaceTempView("martlet_orders")
    return readers.scan_table(t.spark, "martlet_orders").groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )


@query(
    "S5",
    """SELECT CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS o_orderpriority, count(*) AS orders,
              round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1""",
)
def append_with_new_column(t: Tables):
    path, orders = t.scratch("orders-appended"), t.scan("orders")
    # The first batch does not know the priority yet.
    writers.append_path(orders.filter("o_orderstatus <> 'F'").drop("o_orderpriority"), path)
    writers.append_path(orders.filter("o_orderstatus = 'F'"), path)
    return readers.scan_path(t.spark, path, merge_schema=True).groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )


@query(
    "S7",
    """SELECT l_returnflag, l_linestatus, count(*) AS items, round(sum(l_quantity), 2) AS quantity
       FROM lineitem GROUP BY 1, 2""",
)
def scan_by_path(t: Tables):
    return (
        readers.scan_path(t.spark, f"{t.sf_dir}/lineitem.parquet")
        .groupBy("l_returnflag", "l_linestatus")
        .agg(F.count(F.lit(1)).alias("items"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
    )


@query(
    "S9 U1",
    """SELECT category, english, count(p_partkey) AS products FROM (
         SELECT DISTINCT p_type AS category, lower(p_type) AS english FROM part
         UNION ALL VALUES ('GAMING', 'gaming_pc'), ('KITCHEN', 'portable_kitchen')) c
       LEFT JOIN part ON p_type = category GROUP BY 1, 2""",
)
def categories_with_added_rows(t: Tables):
    part = t.scan("part")
    known = part.select(F.col("p_type").alias("category"), F.lower("p_type").alias("english")).distinct()
    extended = U.add_rows(known, [("GAMING", "gaming_pc"), ("KITCHEN", "portable_kitchen")])
    return (
        extended.join(part, extended.category == part.p_type, "left")
        .groupBy("category", "english")
        .agg(F.count("p_partkey").alias("products"))
    )


@query("S11", "SELECT count(*) AS items, round(sum(l_extendedprice), 2) AS total FROM lineitem")
def dataset_snapshot(t: Tables):
    root = t.scratch("snapshots")
    writers.write_snapshot(t.scan("lineitem"), root, "1")
    return writers.read_snapshot(t.spark, root, "1").agg(
        F.count(F.lit(1)).alias("items"), F.round(F.sum("l_extendedprice"), 2).alias("total")
    )


@query(
    "S10 S13 S4 S8",
    """SELECT name, true AS exported, rows FROM (
         SELECT 'my_customers' AS name, count(*) AS rows FROM customer UNION ALL SELECT 'products', count(*) FROM part
         UNION ALL SELECT 'sellers', count(*) FROM supplier)""",
)
def model_exported_and_listed(t: Tables):
    database = f"martlet_{uuid.uuid4().hex}"
    t.spark.sql(f"CREATE DATABASE {database} LOCATION '{t.scratch('database')}'")
    model = {"My Customers": t.customers(), "products": t.products(), "sellers": t.sellers()}
    outcome = writers.export_model(t.spark, model, database).withColumn("name", F.lower("table_name"))
    sizes = U.stack(
        {n: readers.scan_table(t.spark, f"{database}.{n}").agg(F.count(F.lit(1)).alias("rows")) for n in ("my_customers", "products", "sellers")},
        "name",
    )
    listed = catalog.list_tables(t.spark, database).select(F.col("Name").alias("name"))
    return listed.join(outcome, "name").join(sizes, "name").select("name", "exported", "rows")


@query("S12", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def export_sample_csv(t: Tables):
    path = t.scratch("sample")
    writers.export_sample(t.scan("orders").orderBy(F.desc("o_totalprice"), "o_orderkey"), 100, path)
    return readers.read_csv(t.spark, path).select(
        F.col("o_orderkey").cast("long"),
        F.col("o_custkey").cast("long"),
        "o_totalprice",
        F.col("o_orderdate").cast("timestamp_ntz"),
    )


@query("S14 U5", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def documents_not_labelled(t: Tables):
    return catalog.pending_tables(t.scan("documents").select("doc_id"), t.scan("labels"), "doc_id")


@query(
    "S15 A18",
    """SELECT o_custkey, o_orderkey, o_orderdate FROM orders
       QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
)
def latest_order_per_customer(t: Tables):
    newest = catalog.latest_by(t.scan("orders"), ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey"))
    return newest.select("o_custkey", "o_orderkey", "o_orderdate")


@query("S15", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders)")
def rows_of_latest_version(t: Tables):
    return catalog.latest_version(t.scan("orders"), "o_orderdate").select("o_orderkey", "o_orderdate")


@query("S16", "SELECT * FROM part")
def read_whole_result(t: Tables):
    return readers.scan_path(t.spark, f"{t.sf_dir}/part.parquet")


# -- projections and predicates -----------------------------------------------------------------------


@query(
    "P1",
    "SELECT o_orderkey AS order_id, o_totalprice AS sales, CAST(o_orderdate AS DATE) AS order_date FROM orders",
)
def project_and_rename(t: Tables):
    chosen = P.project(
        t.scan("orders"), {"id": "o_orderkey", "total": "o_totalprice", "order_date": F.to_date("o_orderdate")}
    )
    return P.rename(chosen, {"id": "order_id", "total": "sales"})


@query("P2", "SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def drop_columns(t: Tables):
    return P.drop_cols(t.scan("supplier"), "s_acctbal")


@query("P3", "SELECT c_custkey, 'recommender' AS model, 3 AS model_version, DATE '2024-01-31' AS run_day FROM customer")
def stamp_literals(t: Tables):
    return P.stamp(
        t.scan("customer").select("c_custkey"), model="recommender", model_version=3, run_day=dt.date(2024, 1, 31)
    )


@query(
    "P4",
    "SELECT l_returnflag, round(sum(l_extendedprice / 100 * 10), 2) AS preference FROM lineitem GROUP BY l_returnflag",
)
def sql_statement_stage(t: Tables):
    rated = P.sql_transform(t.scan("lineitem"), "SELECT *, (l_extendedprice / 100) * 10 AS preference FROM __THIS__")
    return P.sql_transform(
        rated, "SELECT l_returnflag, round(sum(preference), 2) AS preference FROM __THIS__ GROUP BY l_returnflag"
    )


@query("P5", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F'")
def delivered_orders(t: Tables):
    return P.where_eq(t.scan("orders"), "o_orderstatus", "F").select("o_orderkey", "o_custkey")


@query(
    "P6",
    """SELECT o_orderpriority, count(*) AS orders FROM orders
       WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority NOT IN ('5-LOW') GROUP BY 1""",
)
def membership_filters(t: Tables):
    kept = P.where_in(t.scan("orders"), "o_orderstatus", ["F", "O"])
    kept = P.where_in(kept, "o_orderpriority", ["5-LOW"], negate=True)
    return kept.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("orders"))


@query(
    "P6",
    """SELECT c_mktsegment, count(*) AS customers FROM customer
       WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) GROUP BY 1""",
)
def membership_by_table(t: Tables):
    big = t.scan("orders").filter("o_totalprice > 400000").select("o_custkey")
    return (
        P.where_in(t.scan("customer"), "c_custkey", big)
        .groupBy("c_mktsegment")
        .agg(F.count(F.lit(1)).alias("customers"))
    )


@query(
    "P7",
    """SELECT o_orderkey, o_orderdate FROM orders
       WHERE CAST(o_orderdate AS DATE) BETWEEN make_date(1997, 1, 1) AND make_date(1998, 8, 30)""",
)
def orders_between_dates(t: Tables):
    return P.where_between(t.scan("orders"), "o_orderdate", dt.date(1997, 1, 1), dt.date(1998, 8, 30)).select(
        "o_orderkey", "o_orderdate"
    )


@query(
    "P8",
    """SELECT o_orderkey, o_orderdate FROM orders WHERE year(o_orderdate) >= 1997
       AND NOT (year(o_orderdate) = 1998 AND month(o_orderdate) = 9)""",
)
def orders_without_month(t: Tables):
    return P.exclude_month(t.scan("orders"), "o_orderdate", 1998, 9, min_year=1997).select("o_orderkey", "o_orderdate")


@query(
    "P9",
    "SELECT d.doc_id, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE quality IS NOT NULL",
)
def rows_without_nulls(t: Tables):
    return P.drop_null(t.scan("documents").join(t.scan("labels"), "doc_id", "left"), ["quality"]).select(
        "doc_id", "quality"
    )


@query(
    "P10",
    """SELECT doc_id, CASE WHEN trim(lang) <> '' THEN lang END AS lang, CASE WHEN trim(text) <> '' THEN length(text) END AS chars
       FROM documents""",
)
def blanks_to_null(t: Tables):
    text = blank_as_null("text")
    return t.scan("documents").select(
        "doc_id", blank_as_null("lang").alias("lang"), F.length(text).cast("long").alias("chars")
    )


@query(
    "P11",
    """SELECT event_type, count(*) AS n FROM events
       WHERE CAST(ts AS DATE) >= (SELECT CAST(max(ts) AS DATE) FROM events) - INTERVAL 7 DAY GROUP BY 1""",
)
def events_of_last_days(t: Tables):
    events = t.scan("events")
    as_of = events.agg(F.to_date(F.max("ts"))).scalar()
    return P.since_days(events, "ts", 7, as_of).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("P12", "SELECT * FROM part WHERE p_partkey = 42")
def product_lookup(t: Tables):
    return P.lookup(t.scan("part"), "p_partkey", 42)


@query("P13", "SELECT p_partkey, p_type FROM part WHERE coalesce(length(p_type), 0) > 0")
def products_with_category(t: Tables):
    return P.non_empty(t.scan("part"), "p_type").select("p_partkey", "p_type")


@query("P14", "SELECT c_custkey, c_name FROM customer WHERE starts_with(c_name, 'Customer#00000001')")
def customers_by_prefix(t: Tables):
    prefix = P.without_last_char("Customer#000000012")
    return P.where_prefix(t.scan("customer"), "c_name", prefix).select("c_custkey", "c_name")


@query(
    "P15",
    """SELECT p_partkey, p_type, p_retailprice, p_size FROM part
       WHERE lower(p_type) = 'economy' AND p_retailprice <> 0 AND p_retailprice BETWEEN 900 AND 1000 AND p_size > 0""",
)
def catalog_facets(t: Tables):
    columns = ("p_type", "p_retailprice", "p_size")
    return P.facet_filter(t.scan("part"), "Economy", 900, 1000, True, columns).select("p_partkey", *columns)


@query(
    "P16",
    """SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'red') OR contains(lower(p_type), 'red')
       OR contains(lower(p_brand), 'red')""",
)
def catalog_text_search(t: Tables):
    return P.text_search(t.scan("part"), ["p_name", "p_type", "p_brand"], "RED").select("p_partkey", "p_name")


@query(
    "P17",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate FROM lineitem""",
)
def numeric_and_date_columns(t: Tables):
    return P.select_types(t.scan("lineitem"), ["number", "datetime"], drop_all_null=True)


@query(
    "P18",
    """SELECT TRY_CAST(o_orderkey AS INTEGER) AS o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate,
              TRY_CAST(o_orderpriority AS INTEGER) AS o_orderpriority FROM orders""",
)
def cast_columns(t: Tables):
    chosen = t.scan("orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    return P.cast_cols(chosen, {"o_orderkey": "int", "o_orderdate": "date", "o_orderpriority": "int"})


# -- joins --------------------------------------------------------------------------------------------


@query(
    "J1 M17 M18",
    with_(
        """SELECT order_status, CAST(year(d) * 10000 + month(d) * 100 + day(d) AS INTEGER) AS date_key, count(*) AS items,
                  round(sum(price), 2) AS price, round(sum(freight_value), 4) AS freight, CAST(sum(hours) AS BIGINT) AS hours
           FROM fact GROUP BY 1, 2""",
        FACT,
    ),
)
def order_item_fact(t: Tables):
    return t.fact().groupBy("order_status", "date_key").agg(
        F.count(F.lit(1)).alias("items"),
        F.round(F.sum("price"), 2).alias("price"),
        F.round(F.sum("freight_value"), 4).alias("freight"),
        F.sum("time_to_delivery_hours").alias("hours"),
    )


@query(
    "J2",
    """SELECT c_custkey AS mql_id, c_mktsegment, s_name AS won_by FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey""",
)
def leads_with_deals(t: Tables):
    leads = t.scan("customer").select(F.col("c_custkey").alias("mql_id"), "c_mktsegment")
    deals = t.scan("supplier").select(F.col("s_suppkey").alias("mql_id"), F.col("s_name").alias("won_by"))
    return J.left_enrich(leads, deals, "mql_id")


@query(
    "J3",
    "SELECT d.doc_id, lang, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
)
def reviews_with_scores(t: Tables):
    return J.left_enrich(t.scan("documents").select("doc_id", "lang"), t.scan("labels"), "doc_id")


@query(
    "J4",
    """SELECT p_partkey AS product_id, p_type AS product_category_name,
              CASE WHEN p_type <> 'PROMO' THEN 'segment of ' || lower(p_type) END AS product_segment FROM part""",
)
def enriched_products(t: Tables):
    products = t.scan("part").select(F.col("p_partkey").alias("product_id"), F.col("p_type").alias("product_category_name"))
    kinds = t.scan("part").select("p_type").distinct()
    translations = kinds.select(
        F.col("p_type").alias("product_category_name"),
        F.concat(F.lower("p_type"), F.lit("_goods")).alias("product_category_name_english"),
    )
    segments = kinds.filter("p_type <> 'PROMO'").select(
        F.concat(F.lower("p_type"), F.lit(" goods")).alias("Category"),
        F.concat(F.lit("segment of "), F.lower("p_type")).alias("product_segment"),
    )
    return J.products_enriched(products, translations, segments).select(
        "product_id", "product_category_name", F.col("Product Segment").alias("product_segment")
    )


@query("J5", "SELECT c_custkey, n_name, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey")
def join_with_prefixed_columns(t: Tables):
    nation = J.prefix_cols(t.scan("nation"), "Mapping")
    joined = t.scan("customer").join(nation, F.col("c_nationkey") == F.col("`Mapping.n_nationkey`"))
    return joined.select(
        "c_custkey",
        F.col("`Mapping.n_name`").alias("n_name"),
        F.col("`Mapping.n_regionkey`").alias("n_regionkey"),
    )


@query(
    "J6",
    "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey",
)
def join_differently_named_keys(t: Tables):
    return J.join_on_expr(t.scan("orders"), t.scan("customer"), "o_custkey", "c_custkey").select("o_orderkey", "c_name")


@query("J7", "SELECT doc_id, lang, quality FROM documents JOIN labels USING (doc_id)")
def join_shared_name(t: Tables):
    return J.join_on(t.scan("documents"), t.scan("labels"), "doc_id").select("doc_id", "lang", "quality")


@query(
    "J8",
    """SELECT conv_id, turn, e.text_length FROM conversations LEFT JOIN
         (SELECT DISTINCT conv_id AS c, text AS x, length(text) AS text_length FROM conversations WHERE role = 'user') e
       ON conv_id = e.c AND text = e.x""",
)
def enrichment_joined_back(t: Tables):
    turns = t.scan("conversations")
    enriched = turns.filter("role = 'user'").select(
        "conv_id", "text", F.length("text").cast("long").alias("text_length")
    )
    return J.join_back(turns, enriched, ["conv_id", "text"]).select("conv_id", "turn", "text_length")


@query(
    "J9",
    """SELECT c_custkey, c_name FROM customer
       WHERE c_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) < 10)""",
)
def customers_with_few_orders(t: Tables):
    few = t.scan("orders").groupBy(F.col("o_custkey").alias("c_custkey")).count().filter("count < 10")
    return J.semi(t.scan("customer"), few, "c_custkey").select("c_custkey", "c_name")


@query("J10", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def orders_without_items(t: Tables):
    items = t.scan("lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return J.anti(t.scan("orders"), items, "o_orderkey").select("o_orderkey")


@query(
    "J11",
    with_(
        """SELECT p_type AS category, count(*) AS reviews, round(avg(review_score), 6) AS average_review
           FROM (SELECT DISTINCT p_type, order_id FROM fact JOIN part ON product_id = p_partkey) v
           JOIN reviews USING (order_id) GROUP BY 1""",
        FACT,
        REVIEWS,
    ),
)
def cross_filtered_reviews(t: Tables):
    fact = t.fact().join(t.products(), "product_id")
    visible = J.cross_filter(fact, t.reviews(), ["category"], "order_id")
    return visible.groupBy("category").agg(
        F.count(F.lit(1)).alias("reviews"), F.round(F.avg("review_score"), 6).alias("average_review")
    )


@query(
    "J12",
    with_(
        """SELECT customer_state, seller_state, p_type AS category, count(*) AS items, round(sum(price), 2) AS sales
           FROM fact LEFT JOIN customers USING (customer_id) LEFT JOIN sellers USING (seller_id)
           LEFT JOIN part ON product_id = p_partkey GROUP BY 1, 2, 3""",
        FACT,
        CUSTOMERS,
        SELLERS,
    ),
)
def star_lookup(t: Tables):
    joined = J.star(
        t.fact(),
        {
            "customer_id": (t.customers(), "customer_id"),
            "seller_id": (t.sellers(), "seller_id"),
            "product_id": (t.products(), "product_id"),
        },
    )
    return joined.groupBy("customer_state", "seller_state", "category").agg(
        F.count(F.lit(1)).alias("items"), F.round(F.sum("price"), 2).alias("sales")
    )


@query(
    "J13",
    with_(
        """SELECT customer_id, customer_zip, round(lat, 6) AS lat, round(lng, 6) AS lng, city
           FROM customers LEFT JOIN (SELECT zip, avg(lat) AS lat, avg(lng) AS lng FROM geo GROUP BY zip) p
             ON customer_zip = p.zip
           LEFT JOIN (SELECT zip, city FROM geo GROUP BY zip, city
                      QUALIFY row_number() OVER (PARTITION BY zip ORDER BY count(*) DESC, city) = 1) c
             ON customer_zip = c.zip""",
        CUSTOMERS,
        """geo AS (SELECT s_nationkey AS zip, s_acctbal / 100 AS lat, s_acctbal / 50 AS lng,
                          'city ' || CAST(floor(s_acctbal / 2000) AS BIGINT) AS city FROM supplier)""",
    ),
)
def customers_with_position(t: Tables):
    geo = t.scan("supplier").select(
        F.col("s_nationkey").alias("zip"),
        (F.col("s_acctbal") / 100).alias("lat"),
        (F.col("s_acctbal") / 50).alias("lng"),
        F.concat(F.lit("city "), F.floor(F.col("s_acctbal") / 2000).cast("string")).alias("city"),
    )
    placed = J.with_geo(t.customers(), geo, "customer_zip", "zip", "lat", "lng", "city")
    return placed.select("customer_id", "customer_zip", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"), "city")


@query(
    "J15",
    """SELECT user_id, product_id, round(score, 4) AS score, p_type AS category, p_brand AS product_segment
       FROM (SELECT user_id, event_id AS product_id, value AS score FROM events WHERE event_type = 'purchase') r
       LEFT JOIN part ON product_id = p_partkey""",
)
def recommendations_with_products(t: Tables):
    recs = t.scan("events").filter("event_type = 'purchase'").select(
        "user_id", F.col("event_id").alias("product_id"), F.round("value", 4).alias("score")
    )
    return J.recs_with_products(recs, t.products()).select(
        "user_id", "product_id", "score", "category", "product_segment"
    )


# -- set operations -----------------------------------------------------------------------------------


@query("U2", "SELECT l_partkey AS id FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A'")
def parts_in_both_flags(t: Tables):
    items = t.scan("lineitem").select(F.col("l_partkey").alias("id"), "l_returnflag")
    return U.common(items.filter("l_returnflag = 'R'"), items.filter("l_returnflag = 'A'"), "id")


@query(
    "U3",
    """SELECT label, count(*) AS n, round(avg(score), 6) AS score FROM (
         SELECT o_totalprice AS score, 'Cold Start' AS label FROM orders WHERE o_orderstatus = 'P'
         UNION ALL SELECT o_totalprice, 'Regular' FROM orders WHERE o_orderstatus <> 'P') s GROUP BY label""",
)
def labelled_stack(t: Tables):
    scores = t.scan("orders").select("o_orderstatus", F.col("o_totalprice").alias("score"))
    both = U.stack(
        {"Cold Start": scores.filter("o_orderstatus = 'P'"), "Regular": scores.filter("o_orderstatus <> 'P'")}
    )
    return both.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("score"))
