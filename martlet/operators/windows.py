"""Ordered analytics. Partitions of a window are bounded by the calendar or by a rank limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from martlet.functions.columns import divide_or_null, percent_of
from martlet.operators.ordering import global_running_sum, rank_within


def pareto(df: DataFrame, by: str) -> DataFrame:
    """Groups ranked by row count with running count and running percent of all rows."""
    counted = df.groupBy(by).agg(F.count(F.lit(1)).alias("count"))
    running = global_running_sum(counted, "count", F.desc("count"), F.col(by), name="cumulative_count")
    total = df.agg(F.count(F.lit(1))).scalar()
    return running.withColumn("cumulative_percentage", percent_of("cumulative_count", total))


def pareto_cut(df: DataFrame, by: str, percent: float = 80.0) -> DataFrame:
    """How many of the largest groups stay within ``percent`` of all rows, and their share of the groups.

    Works on one row per distinct count: of m groups of size v that follow a running count of p,
    floor((limit - p) / v) are still within the limit.
    """
    counted = df.groupBy(by).agg(F.count(F.lit(1)).alias("v"))
    folds = counted.groupBy("v").agg(F.count(F.lit(1)).alias("m"))
    larger = Window.orderBy(F.desc("v")).rowsBetween(Window.unboundedPreceding, -1)
    placed = folds.withColumn("p", F.coalesce(F.sum(F.col("m") * F.col("v")).over(larger), F.lit(0)))
    everything = Window.partitionBy()  # again one row per distinct count
    limit = F.sum(F.col("m") * F.col("v")).over(everything) * (percent / 100.0)
    fitting = F.greatest(F.lit(0), F.least(F.col("m"), F.floor((limit - F.col("p")) / F.col("v"))))
    return placed.withColumn("_fit", fitting).agg(
        F.sum("_fit").alias("groups_within"), F.sum("m").alias("groups")
    ).withColumn(
        "percent_of_groups", percent_of("groups_within", "groups")
    )


def with_previous(df: DataFrame, keys: list[str], ts: str, columns: list[str]) -> DataFrame:
    """Each row with the values of the row before it under the same key."""
    w = Window.partitionBy(*keys).orderBy(ts)
    return df.withColumns({f"previous_{c}": F.lag(c).over(w) for c in columns})


def latest_n(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    """First ``n`` rows per key. Spark trims each task's rows to ``n`` per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)


def period_to_date(df: DataFrame, keys: list[str], date: str, value: str, period: str, name: str) -> DataFrame:
    """Running total within month or year of rows that already are one per key and date."""
    w = (
        Window.partitionBy(*keys, F.trunc(F.col(date), period))
        .orderBy(date)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return df.withColumn(name, F.sum(value).over(w))


def period_over_period(df: DataFrame, keys: list[str], month: str, value: str, months: int = 12) -> DataFrame:
    """Value of the same month ``months`` earlier, by key equality (months without rows stay null)."""
    earlier = df.select(*keys, F.add_months(F.col(month), months).alias(month), F.col(value).alias(f"{value}_before"))
    out = df.join(earlier, [*keys, month], "left")
    return out.withColumn(f"{value}_change", divide_or_null(F.col(value), F.col(f"{value}_before")) - 1)


def fill(df: DataFrame, keys: list[str], order: str, column: str, direction: str = "both") -> DataFrame:
    """Fill nulls from the next row (``backward``), the previous row (``forward``) or both in that order.

    Meant for series: each key has at most one row per calendar step.
    """
    ahead = Window.partitionBy(*keys).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    behind = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    back = F.first(column, ignorenulls=True).over(ahead)
    forth = F.last(column, ignorenulls=True).over(behind)
    filled = {"backward": back, "forward": forth, "both": F.coalesce(back, forth)}[direction]
    return df.withColumn(column, filled)


def rank_recs(recs: DataFrame, user: str = "userId", item: str = "itemId", score: str = "score") -> DataFrame:
    """Position of each recommendation within its user's list, best first; lists may have any length."""
    return rank_within(recs, [user], F.desc(score), F.col(item))
