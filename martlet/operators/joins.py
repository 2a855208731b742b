"""Joins of the retail star. The physical strategy is left to Catalyst and AQE, which know the sizes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def order_item_fact(orders: DataFrame, items: DataFrame, key: str = "order_id") -> DataFrame:
    """One row per order item."""
    return orders.join(items, key, "inner")


def left_enrich(base: DataFrame, extra: DataFrame, key: str) -> DataFrame:
    """Left join on one shared key: leads with deals, reviews with scores."""
    return base.join(extra, key, "left")


def prefix_cols(df: DataFrame, prefix: str) -> DataFrame:
    """All columns renamed to ``prefix.column``; refer to them with backticks."""
    return df.select(*[F.col(f"`{c}`").alias(f"{prefix}.{c}") for c in df.columns])


def products_enriched(products: DataFrame, translations: DataFrame, segments: DataFrame) -> DataFrame:
    """Products with their translated category and the segment of that category.

    ``translations`` has (product_category_name, product_category_name_english), ``segments`` has
    (Category, product_segment). Underscores of the translated name become spaces before the second join.
    """
    mapping = prefix_cols(translations, "Mapping")
    english = "`Mapping.product_category_name_english`"
    joined = products.join(
        mapping, products["product_category_name"] == mapping["`Mapping.product_category_name`"], "left"
    )
    cleaned = joined.withColumn("_english", F.regexp_replace(F.col(english), "_", " "))
    with_segment = cleaned.join(segments, cleaned["_english"] == segments["Category"], "left")
    return with_segment.drop("_english", "Mapping.product_category_name_english").withColumnRenamed(
        "product_segment", "Product Segment"
    )


def join_on_expr(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "inner") -> DataFrame:
    """Equi-join of differently named keys; both keys stay in the result."""
    return left.join(right, left[left_key] == right[right_key], how)


def join_on(left: DataFrame, right: DataFrame, keys: str | list[str], how: str = "inner") -> DataFrame:
    return left.join(right, keys, how)


def join_back(df: DataFrame, enriched: DataFrame, keys: list[str]) -> DataFrame:
    """Attach enrichment results without multiplying rows when a key was enriched more than once."""
    return df.join(enriched.dropDuplicates(keys), keys, "left")


def semi(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    return df.join(keys, on, "left_semi")


def anti(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    return df.join(keys, on, "left_anti")


def cross_filter(fact: DataFrame, other: DataFrame, by: list[str], key: str) -> DataFrame:
    """Rows of ``other`` visible from each group of ``fact`` over a many-to-many key.

    The keys of a group are made unique first, so a row of ``other`` appears once per group however many
    fact rows share its key. Fact rows without a row of ``other`` go first, before keys are made unique. Without ``by`` it
    is a plain semi join.
    """
    if not by:
        return other.join(fact.select(key), key, "left_semi")
    fact = fact.join(other.select(key), key, "left_semi")
    return fact.select(*by, key).distinct().join(other, key)


def star(fact: DataFrame, dimensions: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Look up dimensions from the fact: ``{fact_key: (dimension, dimension_key)}``."""
    for fact_key, (dim, dim_key) in dimensions.items():
        right = dim.withColumnRenamed(dim_key, fact_key) if dim_key != fact_key else dim
        fact = fact.join(right, fact_key, "left")
    return fact


def geo_by_zip(geo: DataFrame, zip_col: str, lat: str, lng: str, city: str) -> DataFrame:
    """One row per zip: mean position and most frequent city (ties to the first name)."""
    per_city = geo.groupBy(zip_col, city).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(lat).alias("_lat"), F.sum(lng).alias("_lng")
    )
    points = F.sum("_n")
    return per_city.groupBy(zip_col).agg(
        (F.sum("_lat") / points).alias(lat),
        (F.sum("_lng") / points).alias(lng),
        F.min_by(city, F.struct(-F.col("_n"), F.col(city))).alias(city),
    )


def with_geo(df: DataFrame, geo: DataFrame, df_zip: str, geo_zip: str, lat: str, lng: str, city: str) -> DataFrame:
    """Attach a position per zip; the many points of a zip never multiply rows of ``df``."""
    per_zip = geo_by_zip(geo, geo_zip, lat, lng, city).withColumnRenamed(geo_zip, df_zip)
    return df.join(per_zip, df_zip, "left")


def attach(calendar: DataFrame, other: DataFrame, on: str = "date") -> DataFrame:
    """Natural left join of calendar-shaped tables on their date."""
    return calendar.join(other, on, "left")


def recs_with_products(recs: DataFrame, products: DataFrame) -> DataFrame:
    return recs.join(products, "product_id", "left")


def generate(years: DataFrame, rules: DataFrame) -> DataFrame:
    """Every rule for every year. The rules are folded into one array, so this is an explode and no join;
    both inputs are configuration-sized."""
    folded = rules.agg(F.collect_list(F.struct(*rules.columns)).alias("_rules"))
    return years.withColumn("_rule", F.explode(folded.scalar())).select(*years.columns, "_rule.*")


def top_one(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """First row per key by the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
