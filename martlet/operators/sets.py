"""Set operations."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlet.sources.readers import literal_table


def add_rows(df: DataFrame, rows: list[tuple]) -> DataFrame:
    """Append a few literal rows that follow the schema of ``df``."""
    return df.union(literal_table(df.sparkSession, rows, df.schema))


def common(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def stack(labelled: Mapping[str, DataFrame], label: str = "label") -> DataFrame:
    """Frames of one shape under each other, each row marked with the name of its frame."""
    parts = [df.withColumn(label, F.lit(name)) for name, df in labelled.items()]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def minus(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.join(b.select(key), key, "left_anti")
