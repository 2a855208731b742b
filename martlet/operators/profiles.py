"""Column profiles as states that merge: a day is profiled once, any span of days is read from the stored states.

A state is one row per part and column: counts, extremes, mean and squared deviations, a sketch of distinct values and one of
quantiles. All columns are taken in one pass with partial aggregates of bounded size, and states add up in any order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martlet.functions.columns import divide_or_null
from martlet.operators.ordering import null_safe_join

#: Size of the sketch of distinct values (two to this power of registers) and of the sketch of quantiles.
DISTINCT_BITS, QUANTILE_SIZE = 14, 1024
#: What they promise: distinct counts within this share (three standard errors), ranks of quantiles within this share.
DISTINCT_ERROR, RANK_ERROR = 0.025, 0.005


def _is_number(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.NumericType)


def _state(field: T.StructField) -> Column:
    v, nothing = F.col(f"`{field.name}`"), F.lit(None)
    number = v.cast("double") if _is_number(field) else nothing.cast("double")
    finite = F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)
    text = nothing.cast("string") if _is_number(field) else v.cast("string")
    hashed = F.when(v.isNotNull(), F.xxhash64(v))
    return F.struct(
        F.lit(field.name).alias("column"),
        F.lit(field.dataType.simpleString()).alias("type"),
        F.count(F.lit(1)).alias("rows"),
        F.count_if(v.isNull()).alias("nulls"),
        F.count(finite).alias("numbers"),
        F.avg(finite).alias("mean"),
        (F.var_pop(finite) * F.count(finite)).alias("deviations"),
        F.min(number).alias("min_number"),
        F.max(number).alias("max_number"),
        F.min(text).alias("min_text"),
        F.max(text).alias("max_text"),
        F.hll_sketch_agg(hashed, DISTINCT_BITS).alias("distinct_sketch"),
        F.kll_sketch_agg_double(finite, F.lit(QUANTILE_SIZE)).alias("quantile_sketch"),
    )


def profile_states(df: DataFrame, part: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """One state per part (the values of the ``part`` columns) and column; all other columns unless some are named.

    Maps and arrays of maps have no order and no hash and are not for profiling. Values that are not finite count for
    distinct values and extremes, not for mean, deviation and quantiles.
    """
    fields = [f for f in df.schema.fields if (f.name in columns if columns is not None else f.name not in part)]
    states = df.groupBy(*part).agg(F.array(*[_state(f) for f in fields]).alias("_states"))
    return states.select(*part, F.inline("_states"))


def merge_states(states: DataFrame, part: Sequence[str] = ()) -> DataFrame:
    """States of coarser parts (one per column without ``part``), from states alone."""
    keys = [*part, "column"]
    centers = states.groupBy(*keys).agg(divide_or_null(F.sum(F.col("mean") * F.col("numbers")), F.sum("numbers")).alias("_center"))
    apart = null_safe_join(states, centers, keys)
    # Deviations around the common mean: those around each mean, and of the means.
    moved = F.col("deviations") + F.col("numbers") * (F.col("mean") - F.col("_center")) * (F.col("mean") - F.col("_center"))
    return apart.groupBy(*keys).agg(
        F.min("type").alias("type"),
        F.sum("rows").alias("rows"),
        F.sum("nulls").alias("nulls"),
        F.sum("numbers").alias("numbers"),
        F.max("_center").alias("mean"),
        F.sum(moved).alias("deviations"),
        F.min("min_number").alias("min_number"),
        F.max("max_number").alias("max_number"),
        F.min("min_text").alias("min_text"),
        F.max("max_text").alias("max_text"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
        F.kll_merge_agg_double("quantile_sketch").alias("quantile_sketch"),
    )


def read_states(states: DataFrame, probabilities: Sequence[float] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """Profiles that people read: distinct values with their bounds, extremes, mean, sample deviation and quantiles."""
    n = F.hll_sketch_estimate("distinct_sketch")
    at = F.array(*[F.lit(float(p)) for p in probabilities])
    rest = [c for c in states.columns if c not in _INNER]
    return states.select(
        *rest,
        n.alias("distinct"),
        F.floor(n * (1 - DISTINCT_ERROR)).alias("distinct_low"),
        F.ceil(n * (1 + DISTINCT_ERROR)).alias("distinct_high"),
        "min_number",
        "max_number",
        "min_text",
        "max_text",
        "mean",
        F.when(F.col("numbers") > 1, F.sqrt(F.col("deviations") / (F.col("numbers") - 1))).alias("stddev"),
        F.when(F.col("numbers") > 0, F.kll_sketch_get_quantile_double("quantile_sketch", at)).alias("quantiles"),
    )


_INNER = ("numbers", "mean", "deviations", "min_number", "max_number", "min_text", "max_text", "distinct_sketch", "quantile_sketch")
