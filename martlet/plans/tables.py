"""The given tables under their own names and as the retail model (see SURVEY 7.1)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martlet.operators.calendar import calendar, year_bounds_of
from martlet.operators.joins import order_item_fact
from martlet.operators.measures import StarModel, with_calculated_columns
from martlet.operators.relations import Relation
from martlet.session import ensure_checkpoint_dir

DELIVERED = "F"


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def scan(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def scratch(self, name: str) -> str:
        """A new folder next to the checkpoints, which every executor can reach."""
        ensure_checkpoint_dir(self.spark)
        return f"{self.spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"

    def orders(self) -> DataFrame:
        return self.scan("orders").select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_custkey").alias("customer_id"),
            F.col("o_orderstatus").alias("order_status"),
            F.col("o_orderdate").alias("order_purchase_timestamp"),
            F.col("o_orderdate").alias("order_approved_at"),
        )

    def order_items(self) -> DataFrame:
        return self.scan("lineitem").select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("order_item_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_suppkey").alias("seller_id"),
            F.col("l_shipdate").alias("order_delivered_customer_date"),
            F.col("l_extendedprice").alias("price"),
            (F.col("l_extendedprice") * F.col("l_tax")).alias("freight_value"),
        )

    def fact(self) -> DataFrame:
        """One row per order item."""
        joined = order_item_fact(self.orders(), self.order_items())
        return with_calculated_columns(
            joined, "order_approved_at", "order_delivered_customer_date", "order_purchase_timestamp"
        )

    def delivered(self) -> DataFrame:
        return self.fact().filter(F.col("order_status") == DELIVERED)

    def customers(self) -> DataFrame:
        nation = self.scan("nation").join(
            self.scan("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left"
        )
        return (
            self.scan("customer")
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
            .select(
                F.col("c_custkey").alias("customer_id"),
                F.col("n_name").alias("customer_state"),
                F.col("r_name").alias("customer_region"),
                F.col("c_mktsegment").alias("customer_segment"),
                F.col("c_nationkey").alias("customer_zip"),
            )
        )

    def sellers(self) -> DataFrame:
        return (
            self.scan("supplier")
            .join(self.scan("nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
            .select(F.col("s_suppkey").alias("seller_id"), F.col("n_name").alias("seller_state"))
        )

    def products(self) -> DataFrame:
        return self.scan("part").select(
            F.col("p_partkey").alias("product_id"),
            F.col("p_name").alias("name"),
            F.col("p_type").alias("category"),
            F.col("p_brand").alias("product_segment"),
            F.col("p_retailprice").alias("list_price"),
            F.col("p_size").alias("stock"),
        )

    def reviews(self) -> DataFrame:
        return (
            self.scan("documents")
            .join(self.scan("labels"), "doc_id", "left")
            .select(
                F.col("doc_id").alias("review_id"),
                F.col("doc_id").alias("order_id"),
                F.col("quality").alias("review_score"),
                F.col("toxic").alias("defect_score"),
                F.col("text").alias("review_comment_message"),
            )
        )

    def payments(self) -> DataFrame:
        """Stand-in payments: three events pay for an order."""
        return self.scan("events").select(
            F.expr("event_id div 3").alias("order_id"), F.col("event_type").alias("payment_type"), F.col("value").alias("payment_value")
        )

    def leads(self) -> DataFrame:
        """Stand-in leads: customers that a seller won, many for each seller."""
        return self.scan("customer").select(
            F.col("c_custkey").alias("mql_id"), F.col("c_nationkey").cast("long").alias("lead_seller"), F.col("c_mktsegment").alias("origin")
        )

    def landings(self) -> DataFrame:
        """Stand-in visits of leads, a second step away from the sellers."""
        return self.scan("pages").select(F.col("page_id").alias("visitor"), F.substring_index(F.substring_index("url", "/", 3), "/", -1).alias("landing_host"))

    def relations(self) -> dict[str, Relation]:
        return {
            "payments": Relation(self.payments(), "order_id"),
            "leads": Relation(self.leads(), "lead_seller", target_key="seller_id"),
            "landings": Relation(self.landings(), "visitor", "leads", "mql_id"),
        }

    def model(self, with_calendar: bool = False) -> StarModel:
        return StarModel(
            fact=self.fact(),
            dimensions={
                "customers": (self.customers(), "customer_id", "customer_id"),
                "sellers": (self.sellers(), "seller_id", "seller_id"),
                "products": (self.products(), "product_id", "product_id"),
            },
            reviews=self.reviews(),
            forecast=self.forecast(),
            calendar=self.calendar() if with_calendar else None,
            relations=self.relations(),
        )

    def calendar(self, **options) -> DataFrame:
        return calendar(year_bounds_of(self.scan("orders"), "o_orderdate"), **options)

    def forecast(self) -> DataFrame:
        """Stand-in forecast table: what an order day was worth in total."""
        return (
            self.scan("orders")
            .groupBy(F.to_date("o_orderdate").alias("date"))
            .agg(F.sum("o_totalprice").alias("predicted_sales"))
        )

    def runs(self) -> DataFrame:
        """One run per day with the mean value of every event type as a metric map."""
        daily = (
            self.scan("events")
            .groupBy(F.to_date("ts").alias("day"), "event_type")
            .agg(F.round(F.avg("value"), 6).alias("value"))
        )
        return daily.groupBy("day").agg(
            F.map_from_entries(F.collect_list(F.struct("event_type", "value"))).alias("metrics")
        ).select(
            F.date_format("day", "yyyyMMdd").alias("run_id"),
            F.lit("events").alias("experiment"),
            F.lit("daily_means").alias("run_name"),
            F.lit("Finished").alias("status"),
            F.col("day").cast("timestamp_ntz").alias("start_time"),
            "metrics",
            F.create_map(
                F.lit("dataset_version"),
                F.date_format("day", "yyyy-MM"),
                F.lit("dataset_run_id"),
                F.concat(F.lit("d"), F.date_format("day", "dd")),
            ).alias("tags"),
        )


# The same model in SQL.
FACT = """fact AS (
  SELECT o.o_orderkey AS order_id, o.o_custkey AS customer_id, o.o_orderstatus AS order_status,
         o.o_orderdate AS ts, CAST(o.o_orderdate AS DATE) AS d, l.l_shipdate AS delivered,
         l.l_linenumber AS order_item_id, l.l_partkey AS product_id, l.l_suppkey AS seller_id,
         l.l_extendedprice AS price, l.l_extendedprice * l.l_tax AS freight_value,
         date_diff('hour', o.o_orderdate, l.l_shipdate) AS hours
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)"""
DELIVERED_FACT = "delivered_fact AS (SELECT * FROM fact WHERE order_status = 'F')"
CUSTOMERS = """customers AS (
  SELECT c_custkey AS customer_id, n_name AS customer_state, r_name AS customer_region,
         c_mktsegment AS customer_segment, c_nationkey AS customer_zip
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey)"""
SELLERS = """sellers AS (
  SELECT s_suppkey AS seller_id, n_name AS seller_state FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey)"""
REVIEWS = """reviews AS (
  SELECT d.doc_id AS review_id, d.doc_id AS order_id, l.quality AS review_score, l.toxic AS defect_score, d.text
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
PAYMENTS = "payments AS (SELECT event_id // 3 AS order_id, event_type AS payment_type, value AS payment_value FROM events)"
LEADS = "leads AS (SELECT c_custkey AS mql_id, c_nationkey AS seller_id, c_mktsegment AS origin FROM customer)"
LANDINGS = "landings AS (SELECT page_id AS mql_id, split_part(url, '/', 3) AS landing_host FROM pages)"
RUNS = """runs AS (
  SELECT strftime(CAST(ts AS DATE), '%Y%m%d') AS run_id, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS start_time,
         event_type AS metric_name, round(avg(value), 6) AS value,
         strftime(CAST(ts AS DATE), '%Y-%m') AS dataset_version,
         'd' || strftime(CAST(ts AS DATE), '%d') AS dataset_run_id
  FROM events GROUP BY CAST(ts AS DATE), event_type)"""
