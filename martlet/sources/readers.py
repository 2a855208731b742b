"""Scans of files and catalog tables."""

from __future__ import annotations

from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header row. Pass ``schema`` for large inputs: inferring costs a second scan."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def scan_path(spark: SparkSession, path: str, merge_schema: bool = False) -> DataFrame:
    """Parquet scan; ``merge_schema`` also shows columns that later appends have added."""
    return spark.read.option("mergeSchema", merge_schema).parquet(path)


def scan_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def literal_table(spark: SparkSession, rows: list[tuple], schema: list[str] | T.StructType | str) -> DataFrame:
    """A few literal rows. Handed over as Arrow they become part of the plan: no Python worker reads them."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    names = schema if isinstance(schema, list) else schema.fieldNames()
    columns = list(zip(*rows)) if rows else [()] * len(names)
    table = pa.table([pa.array(list(c)) for c in columns], names=list(names))
    if isinstance(schema, list):
        return spark.createDataFrame(table)
    return spark.createDataFrame(table.cast(_arrow_schema(schema)), schema)


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(),
             "boolean": pa.bool_(), "date": pa.date32(), "timestamp": pa.timestamp("us", "UTC"),
             "timestamp_ntz": pa.timestamp("us"), "float": pa.float32()}
    return pa.schema([pa.field(f.name, kinds[f.dataType.simpleString()]) for f in schema.fields])


def table_name_of(file_name: str) -> str:
    """Table name of an ingested file: the stem without its first and last ``_`` token."""
    return "_".join(PurePosixPath(file_name).stem.split("_")[1:-1])


def list_files(spark: SparkSession, directory: str, pattern: str = "*") -> list[str]:
    """Paths in ``directory`` through Spark's own file source, so any supported storage works."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(directory)
    return sorted(row.path for row in files.select("path").collect())


def cast_timestamps(df: DataFrame) -> DataFrame:
    """Cut every timestamp column to millisecond precision, keeping its type."""
    def cut(name: str):
        # Taking off the rest needs no time zone, unlike truncation.
        micros = F.pmod(F.date_part(F.lit("SECONDS"), F.col(name)) * 1_000_000, F.lit(1000)).cast("int")
        return F.timestamp_add("MICROSECOND", -micros, F.col(name))

    stamps = {
        f.name: cut(f.name)
        for f in df.schema.fields
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))
    }
    return df.withColumns(stamps) if stamps else df
