"""Catalog listings and version lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martlet.operators.joins import top_one

METADATA_COLUMNS = ("Description", "Hidden", "Data_Category", "Type")


def list_tables(spark: SparkSession, database: str) -> DataFrame:
    """Tables of a database as ``Name`` plus the (empty) metadata columns of a model listing."""
    listing = spark.sql(f"SHOW TABLES IN {database}").filter(~F.col("isTemporary"))
    return listing.select(
        F.col("tableName").alias("Name"), *[F.lit(None).cast(T.StringType()).alias(c) for c in METADATA_COLUMNS]
    )


def pending_tables(wanted: DataFrame, existing: DataFrame, key: str = "Name") -> DataFrame:
    """Names that are wanted but not there yet."""
    return wanted.join(existing.select(key), key, "left_anti")


def latest_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Newest row per key. ``order`` should end in a unique column so that ties are settled."""
    return top_one(df, keys, *order)


def latest_version(df: DataFrame, column: str) -> DataFrame:
    """The rows that carry the highest version number."""
    return df.filter(F.col(column) == df.agg(F.max(column)).scalar())
