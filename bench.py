"""Time the headline queries and print one JSON line.

BENCH_SF_DIR is the data folder (default /root/testdata/sf0.1), BENCH_CPUS the number of local cores.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "daily_sales_measure",
    "sales_measures_by_dimension",
    "review_measures_by_category",
    "mixed_measures_by_state",
    "sales_on_every_date",
    "sales_over_time_by_day",
    "sales_over_time_by_month_and_category",
    "active_customers_by_day",
    "review_score_over_time",
    "star_lookup",
    "order_item_fact",
    "cross_filtered_reviews",
    "fact_key_statistics",
    "price_density_by_flag",
    "order_value_box_plot",
    "rating_metric_summary",
    "item_popularity_gini",
    "product_pareto",
    "products_for_80_percent",
    "column_profile",
    "calendar_by_fiscal_weeks",
    "orders_on_working_days",
    "interaction_set",
    "time_ordered_split",
    "ranking_metrics",
    "recommendation_diversity",
    "price_adjusted_preference",
    "als_recommendations_stored",
    "similar_items",
    "sales_per_day",
    "many_daily_series",
    "forecast_daily_total",
    "forecast_per_product_and_month",
    "request_batches_by_size",
    "review_batches_by_count",
    "parsed_defect_scores",
    "enriched_conversations",
    "embedding_clusters",
    "drift_score_summary",
    "sudden_drift",
]


def main() -> None:
    from martlet.plans.catalog import QUERIES
    from martlet.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    only = [n for n in os.environ.get("BENCH_ONLY", "").split(",") if n]
    # Start-up of the session is not a query's time.
    nation, region = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region"))
    nation.join(region, nation.n_regionkey == region.r_regionkey).groupBy("r_name").count().collect()
    seconds = {}
    for name in only or HEADLINE:
        start = time.perf_counter()
        QUERIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{seconds[name]:8.3f} {name}", file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
