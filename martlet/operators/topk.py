"""Sorting, limits, paging and sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlet.operators.joins import recs_with_products
from martlet.operators.projections import where_prefix


def sort(df: DataFrame, *keys: Column | str) -> DataFrame:
    return df.orderBy(*keys)


def head(df: DataFrame, n: int, *keys: Column | str) -> DataFrame:
    """First rows by a given order. Each task keeps ``n`` rows only."""
    return df.orderBy(*keys).limit(n)


def top_k(df: DataFrame, by: str, value: Column, k: int, name: str = "value") -> DataFrame:
    """The ``k`` groups with the largest aggregate, ties by key."""
    return df.groupBy(by).agg(value.alias(name)).orderBy(F.desc(name), by).limit(k)


def tail(df: DataFrame, n: int, order: str) -> DataFrame:
    """Last ``n`` rows of a series, in ascending order."""
    return df.orderBy(F.desc(order)).limit(n).orderBy(order)


def drop_last_period(df: DataFrame, column: str) -> DataFrame:
    """Leave out the newest (incomplete) period."""
    return df.filter(F.col(column) < df.agg(F.max(column)).scalar())


def latest_recs(recs: DataFrame, user_prefix: str, n: int = 10) -> DataFrame:
    """Newest recommendations of the customers whose id starts with ``user_prefix``."""
    mine = where_prefix(recs, "customer_id", user_prefix)
    return mine.orderBy(F.desc("recommendation_ts_utc"), F.desc("score"), "customer_id", "product_id").limit(n)


def personal_recs(recs: DataFrame, products: DataFrame, user_prefix: str, n: int = 10) -> DataFrame:
    """Products recommended to a customer; the limit comes before the join, so that is tiny."""
    return recs_with_products(latest_recs(recs, user_prefix, n), products)


def catalog_sort(df: DataFrame, option: str = "newest", tie: str = "product_id", seed: int = 42) -> DataFrame:
    """Shop orderings; missing prices and ratings count as 0 and ``newest`` is a shuffle."""
    orders = {
        "price_asc": [F.coalesce(F.col("price"), F.lit(0)), F.col(tie)],
        "price_desc": [F.desc(F.coalesce(F.col("price"), F.lit(0))), F.col(tie)],
        "rating": [F.desc(F.coalesce(F.col("rating"), F.lit(0))), F.col(tie)],
        "newest": [F.rand(seed)],
    }
    if option != "newest" and option not in orders:
        raise ValueError(f"unknown sort option {option}")
    # Ordering by columns that are absent is only an error for the option that needs them.
    return df.orderBy(*orders[option])


def page(df: DataFrame, number: int, *keys: Column | str, size: int = 12) -> DataFrame:
    """Page ``number`` (from 1) of a sorted listing."""
    return df.orderBy(*keys).offset((number - 1) * size).limit(size)


def page_count(df: DataFrame, size: int = 12) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("pages", F.ceil(F.col("rows") / size))


def random_n(df: DataFrame, n: int = 4, seed: int = 42) -> DataFrame:
    """``n`` random rows; each task keeps its own ``n`` smallest draws."""
    return df.orderBy(F.rand(seed)).limit(n)


def sample(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    return df.sample(fraction=fraction, seed=seed)
