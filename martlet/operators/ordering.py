"""Whole-table order without a single-task window.

Rows are range-partitioned and sorted once, then materialised so that partition numbers and positions
are fixed. The offset of every partition comes from one row per partition, a table whose size depends on
the cluster and not on the data.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from martlet.functions.columns import as_col
from martlet.session import stable

_PART, _POS, _BASE = "_part", "_pos", "_base"
_POSITION_BITS = 33  # monotonically_increasing_id keeps the partition number above these bits


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys match each other, as groups do."""
    tagged = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    condition = reduce(and_, [left[k].eqNullSafe(tagged[f"_r_{k}"]) for k in keys])
    return left.join(tagged, condition, how).drop(*[f"_r_{k}" for k in keys])


def _lay_out(df: DataFrame, keys: list[Column]) -> DataFrame:
    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    marked = ordered.withColumn(_POS, F.monotonically_increasing_id())
    return stable(marked).withColumn(_PART, F.shiftright(_POS, _POSITION_BITS))


def _with_offsets(rows: DataFrame, total: Column) -> DataFrame:
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(_PART).agg(total.alias("_total"))
    offsets = parts.select(_PART, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias(_BASE))
    return rows.join(F.broadcast(offsets), _PART)


def global_row_number(df: DataFrame, *keys: Column | str, name: str = "row_number") -> DataFrame:
    """Number all rows 1..n in the order of ``keys``. End the keys with an id: rows that tie on every
    key cannot be spread over tasks and get an arbitrary order among themselves."""
    rows = _lay_out(df, [as_col(k) for k in keys])
    position = F.col(_POS).bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    numbered = _with_offsets(rows, F.count(F.lit(1)))
    return numbered.withColumn(name, F.col(_BASE) + position + 1).drop(_PART, _POS, _BASE)


def rank_within(df: DataFrame, keys: Sequence[str], *order: Column | str, name: str = "rank") -> DataFrame:
    """Row number within each group, for groups of any size.

    All rows are laid out in one order, so a group is one stretch in each task that has rows of it. A row's rank follows from
    where its stretch begins and from the lengths of the group's stretches before; stretches are told apart by task, so rows
    of one group never meet in one task. For groups known to be small, or when only the first few rows count, a plain window
    is cheaper.
    """
    rows = _lay_out(df, [as_col(k) for k in [*keys, *order]])
    stretches = rows.groupBy(_PART, *keys).agg(F.min(_POS).alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*keys).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first") + 1
    placed = null_safe_join(rows, stretches.select(_PART, *keys, shift.alias("_shift")), [_PART, *keys])
    return placed.withColumn(name, F.col(_POS) + F.col("_shift")).drop(_PART, _POS, "_shift")


def global_running_sum(df: DataFrame, value: str, *keys: Column | str, name: str = "running_sum") -> DataFrame:
    """Running sum of ``value`` over all rows in the order of ``keys``."""
    rows = _lay_out(df, [as_col(k) for k in keys])
    within = Window.partitionBy(_PART).orderBy(_POS).rowsBetween(Window.unboundedPreceding, 0)
    summed = _with_offsets(rows, F.sum(value)).withColumn("_inner", F.sum(value).over(within))
    return summed.withColumn(name, F.col(_BASE) + F.col("_inner")).drop(_PART, _POS, _BASE, "_inner")


def global_forward_fill(df: DataFrame, columns: Sequence[str], *keys: Column | str) -> DataFrame:
    """Nulls of ``columns`` filled with the last known value before them in the order of ``keys``; leading nulls stay.

    Tasks fill their own stretch; what a stretch ends with is one row, carried to the stretches behind it. End the keys
    with an id, as for row numbers.
    """
    rows = _lay_out(df, [as_col(k) for k in keys])
    ends = rows.groupBy(_PART).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(_POS))).alias(f"_end_{i}") for i, c in enumerate(columns)])
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(_PART, *[F.last(f"_end_{i}", ignorenulls=True).over(before).alias(f"_carry_{i}") for i in range(len(columns))])
    upto = Window.partitionBy(_PART).orderBy(_POS).rowsBetween(Window.unboundedPreceding, 0)
    filled = rows.join(F.broadcast(carried), _PART).withColumns(
        {c: F.coalesce(F.last(c, ignorenulls=True).over(upto), F.col(f"_carry_{i}")) for i, c in enumerate(columns)}
    )
    return filled.select(*df.columns)
