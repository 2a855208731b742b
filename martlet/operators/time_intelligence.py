"""Current, month-to-date, year-to-date, prior-year and year-over-year versions of any measure.

Period-to-date values are running sums over at most 366 steps per group and year. Measures that count
something once per period (customers, orders with reviews) are first reduced to the step where it first
appears within the period; joining every date to all earlier facts of its period is never needed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from martlet.functions.columns import divide_or_null
from martlet.operators.measures import (
    _REVIEW_PARTS,
    MEASURES,
    Measure,
    StarModel,
    split_by_reviews,
    visible_fact,
    visible_forecast,
)

TIME_CALCULATIONS = ("current", "mtd", "ytd", "py", "yoy", "yoy_pct")
_GRAINS = {"day": "day", "month": "month", "year": "year"}


def _components(m: Measure, model: StarModel, by: list[str], filters, date_role) -> tuple[DataFrame, bool]:
    """Rows (by, date[, entity], s, c) whose sums make up the measure, and whether an entity counts once."""
    one = F.lit(1.0)
    if m.source == "forecast":
        forecast = visible_forecast(model, by, filters).filter(F.col("date").isNotNull())
        return forecast.groupBy(*by, "date").agg(F.sum(m.column).alias("s"), F.count(m.column).alias("c")), False
    if m.source == "reviews":
        others, kept, folded = split_by_reviews(model, by, filters or {})
        total, count = ("_rows", "_rows") if m.kind == "count" else _REVIEW_PARTS[m.column]
        own = [c for c in by if c not in others]
        folded = folded.select("order_id", *own, F.col(total).cast("double").alias("s"), F.col(count).cast("double").alias("c"))
        orders = visible_fact(model, [*others, "date"], kept, date_role).filter(F.col("date").isNotNull())
        return orders.select(*others, "date", "order_id").distinct().join(folded, "order_id").withColumnRenamed("order_id", "entity"), True
    rows = visible_fact(model, [*by, "date"], filters, date_role).filter(F.col("date").isNotNull())
    if m.kind == "distinct":
        entities = rows.filter(F.col(m.column).isNotNull()).select(*by, "date", F.col(m.column).alias("entity"))
        return entities.distinct().withColumns({"s": one, "c": one}), True
    value = one if m.kind == "count" else F.col(m.column).cast("double")
    return rows.groupBy(*by, "date").agg(F.sum(value).alias("s"), F.count(value).alias("c")), False


def _finish(m: Measure, s: Column, c: Column) -> Column:
    """Measure value from its components; blank where nothing contributed."""
    if m.kind == "average":
        return divide_or_null(s, c)
    return F.when(c > 0, s)


def _per_step(rows: DataFrame, once: bool, by: list[str], period: str, step: Column) -> DataFrame:
    """Components per step, every entity at its first step within the period only."""
    start = F.trunc("date", period) if period != "day" else F.col("date")
    keyed = rows.withColumns({"_period": start, "_step": step})
    if once:
        # A hot entity is one row per task after the partial aggregate.
        keyed = keyed.groupBy(*by, "_period", "entity").agg(
            F.min("_step").alias("_step"), F.max("s").alias("s"), F.max("c").alias("c")
        )
    return keyed.groupBy(*by, "_period", "_step").agg(F.sum("s").alias("s"), F.sum("c").alias("c"))


def _to_date(rows: DataFrame, once: bool, by: list[str], period: str, grain: str, step: Column) -> DataFrame:
    """Running components within a period, carried over steps without rows up to the end of the period."""
    if (period, grain) in {("month", "month"), ("month", "year"), ("year", "year")}:
        # A step at least as long as the period: its last period-to-date is the value of its last period.
        last = F.last_day(step) if grain == "month" else F.make_date(F.year(step), F.lit(12), F.lit(31))
        shrunk = rows.filter(F.trunc("date", period) == F.trunc(last, period))
        return _per_step(shrunk, once, by, grain, step).drop("_period")
    steps = _per_step(rows, once, by, period, step)
    w = Window.partitionBy(*by, "_period").orderBy("_step")
    unit = F.expr("interval 1 day") if grain == "day" else F.expr("interval 1 month")
    end = F.last_day("_step") if period == "month" else F.make_date(F.year("_step"), F.lit(12), F.lit(31))
    following = F.lead("_step").over(w)
    until = F.coalesce(
        F.date_sub(following, 1) if grain == "day" else F.add_months(following, -1),
        end if grain == "day" else F.trunc(end, "month"),
    )
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    running = steps.select(
        *by,
        "_step",
        F.sum("s").over(upto).alias("s"),
        F.sum("c").over(upto).alias("c"),
        until.alias("_until"),
    )
    return running.withColumn("_step", F.explode(F.sequence("_step", "_until", unit))).drop("_until")


def _a_year_later(step: Column, grain: str) -> Column:
    """Steps whose counterpart last year is ``step``. At day grain 29 February is nobody's counterpart and
    28 February may be the counterpart of two days."""
    later = F.add_months(step, 12)
    if grain != "day":
        return F.array(later)
    return F.filter(F.array(later, F.date_add(later, 1)), lambda d: F.add_months(d, -12) == step)


def _on_every_step(lined_up: DataFrame, rows: DataFrame, by: list[str], grain: str) -> DataFrame:
    """``lined_up`` with all steps of all groups, from the year of the first row to that of the last."""
    span = rows.agg(F.sequence(F.trunc(F.min("date"), "year"), F.make_date(F.year(F.max("date")), F.lit(12), F.lit(31)), F.expr(f"interval 1 {grain}")).alias("_step"))
    if not by:
        every = span.select(F.explode("_step").alias("_step"))
        return every.join(lined_up, "_step", "left")
    every = lined_up.select(*by).distinct().withColumn("_step", F.explode(span.scalar()))
    named = every.withColumnsRenamed({c: f"_g_{c}" for c in by}).withColumnRenamed("_step", "_every")
    same = F.col("_step") == F.col("_every")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    joined = named.join(lined_up, same, "left")
    return joined.select(*[F.col(f"_g_{c}").alias(c) for c in by], F.col("_every").alias("_step"), *[c for c in lined_up.columns if c not in by and c != "_step"])


def time_calculations(
    model: StarModel,
    measure: str,
    grain: str = "day",
    by: Sequence[str] = (),
    filters: Mapping[str, Sequence[Any] | Column] | None = None,
    date_role: str | None = None,
) -> DataFrame:
    """All time calculations of one measure: one row per group and step (``period``) with any value.

    The calendar ends with the year of the last fact, so prior-year values do not run past it. A measure whose blank is
    zero has all steps of all groups, with 0 where nothing was sold (the share of a year before without sales stays blank).
    """
    m, by = MEASURES[measure], list(by)
    step = F.trunc("date", _GRAINS[grain]) if grain != "day" else F.col("date")
    rows, once = _components(m, model, by, filters, date_role)
    current = _per_step(rows, once, by, grain, step).drop("_period")
    parts = {
        "current": current,
        "mtd": _to_date(rows, once, by, "month", grain, step),
        "ytd": _to_date(rows, once, by, "year", grain, step),
        "py": current.withColumn("_step", F.explode(_a_year_later(F.col("_step"), grain))),
    }
    # Each part supplies its own column; one grouping lines all of them up.
    slots = None
    for name, part in parts.items():
        own = _finish(m, F.col("s"), F.col("c"))
        columns = [(own if n == name else F.lit(None).cast("double")).alias(n) for n in parts]
        slot = part.select(*by, "_step", *columns)
        slots = slot if slots is None else slots.unionByName(slot)
    lined_up = slots.groupBy(*by, "_step").agg(*[F.max(n).alias(n) for n in parts])
    last_year = rows.agg(F.year(F.max("date"))).scalar()
    zero = F.lit(0.0)
    if m.blank_is_zero:
        lined_up = _on_every_step(lined_up, rows, by, grain).fillna(0.0, list(parts))
    kept = lined_up.filter(F.coalesce(*parts).isNotNull() & (F.year("_step") <= last_year))
    yoy = F.when(
        F.col("current").isNotNull() | F.col("py").isNotNull(),
        F.coalesce("current", zero) - F.coalesce("py", zero),
    )
    return (
        kept.withColumnRenamed("_step", "period")
        .withColumn("yoy", yoy)
        .withColumn("yoy_pct", divide_or_null("yoy", "py"))
        .select(*by, "period", *TIME_CALCULATIONS)
    )


def time_calculation(model: StarModel, measure: str, item: str, grain: str = "day", **options) -> DataFrame:
    """A single item of the calculation group as (groups, period, value)."""
    if item not in TIME_CALCULATIONS:
        raise ValueError(f"unknown time calculation {item}")
    by = list(options.get("by", ()))
    out = time_calculations(model, measure, grain, **options)
    return out.select(*by, "period", F.col(item).alias("value")).filter("value is not null")
