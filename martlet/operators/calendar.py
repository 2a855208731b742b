"""The calendar dimension: Gregorian, fiscal and fiscal-weekly columns as closed-form expressions.

Every column is computed from the date of its own row, so a calendar of any length is one projection;
only fiscal-week periods are looked up, in tables of a few rows per year.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from martlet.functions.columns import date_key
from martlet.operators.holidays import MONDAY_TO_FRIDAY, holidays
from martlet.sources.readers import literal_table

CALENDAR_KINDS = ("Calendar", "FiscalGregorian", "FiscalWeekly")
# Weeks in the three months of a quarter.
QUARTER_PATTERNS = {"445": (4, 4, 5), "454": (4, 5, 4), "544": (5, 4, 4)}


def year_bounds(spark: SparkSession, first_year: int, last_year: int, as_of: dt.date) -> DataFrame:
    """One row (first_year, last_year, as_of) that configures a calendar."""
    return spark.range(0, 1, 1, 1).select(
        F.lit(first_year).alias("first_year"), F.lit(last_year).alias("last_year"), F.lit(as_of).alias("as_of")
    )


def year_bounds_of(df: DataFrame, ts: str) -> DataFrame:
    """The same row taken from the first and last timestamp of a table; the newest day is "today"."""
    return df.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi")).select(
        F.year("lo").alias("first_year"), F.year("hi").alias("last_year"), F.to_date("hi").alias("as_of")
    )


def date_series(first: Column, last: Column) -> Column:
    """Generator of all days from ``first`` to ``last``."""
    return F.explode(F.sequence(first, last, F.expr("interval 1 day")))


def padded_years(bounds: DataFrame) -> DataFrame:
    """Years of the calendar with one more on either side, for holidays that move across New Year."""
    return bounds.select(F.explode(F.sequence(F.col("first_year") - 1, F.col("last_year") + 1)).alias("year"))


def weekday_number(date: Column, first_dow: int = 0) -> Column:
    """1 to 7, counted from the first day of the week (0 = Sunday)."""
    return F.pmod(F.dayofweek(date) - 1 - first_dow, F.lit(7)) + 1


def week_number(date: Column, first_dow: int = 0) -> Column:
    """Week of the year; week 1 is the one that contains 1 January."""
    january_first = F.trunc(date, "year")
    return F.floor((F.dayofyear(date) + weekday_number(january_first, first_dow) - 2) / 7).cast("int") + 1


def year_week_number(date: Column, first_dow: int = 0) -> Column:
    """Running number of weeks since the last days of 1900."""
    start = dt.date(1900, 12, 30) + dt.timedelta(days=first_dow)
    return F.floor(F.datediff(date, F.lit(start)) / 7).cast("int")


def day_number_365(date: Column) -> Column:
    """Serial day number with all leap days since 1900 taken out, so that years differ by exactly 365.

    Serial 0 is 1899-12-30. A leap day counts as passed from 29 February of its year on.
    """
    passed = F.year(date) - F.when(F.month(date) * 100 + F.dayofmonth(date) < 229, 1).otherwise(0)
    leap_days = F.floor(passed / 4) - F.floor(passed / 100) + F.floor(passed / 400)
    before_1900 = 1899 // 4 - 1899 // 100 + 1899 // 400
    return (F.datediff(date, F.lit(dt.date(1899, 12, 30))) - (leap_days - before_1900)).cast("int")


def previous_by_months(date: Column, months: int) -> Column:
    """Same day some months earlier; a month end maps to the month end, a missing day to the last one."""
    moved = F.add_months(date, -months)
    return F.when(date == F.last_day(date), F.last_day(moved)).otherwise(moved)


def calendar_fields(df: DataFrame, first_dow: int = 0) -> DataFrame:
    """Key, numbers and labels of year, quarter, month, week and day."""
    d = F.col("date")
    year, quarter, month = F.year(d), F.quarter(d), F.month(d)
    week = week_number(d, first_dow)
    week_label = F.concat(F.lit("W"), F.lpad(week.cast("string"), 2, "0"))
    quarter_label = F.concat(F.lit("Q"), quarter.cast("string"), F.lit(" "))
    month_label = F.date_format(d, "MMM")
    return df.withColumns(
        {
            "date_key": date_key(d),
            "day_of_month": F.dayofmonth(d),
            "weekday_number": weekday_number(d, first_dow),
            "week_day": F.date_format(d, "EEE"),
            "sequential_365_day_number": day_number_365(d),
            "year_number": year,
            "year": year.cast("string"),
            "quarter_number": quarter,
            "quarter": quarter_label,
            "year_quarter_number": year * 4 - 1 + quarter,
            "quarter_year": F.concat(quarter_label, year.cast("string")),
            "month_number": month,
            "month": month_label,
            "year_month_number": year * 12 - 1 + month,
            "month_year": F.concat(month_label, F.lit(" "), year.cast("string")),
            "week_number": week,
            "week": week_label,
            "year_week_number": year_week_number(d, first_dow),
            "week_year": F.concat(week_label, F.lit("-"), year.cast("string")),
            "week_year_order": year * 100 + week,
        }
    )


def relative_positions(df: DataFrame, as_of: Column, first_dow: int = 0, prefix: str = "") -> DataFrame:
    """Distance in weeks, months, quarters and years from the reference day."""
    d = F.col("date")

    def months(x: Column) -> Column:
        return F.year(x) * 12 + F.month(x)

    def quarters(x: Column) -> Column:
        return F.year(x) * 4 + F.quarter(x)

    return df.withColumns(
        {
            f"{prefix}relative_week_pos": year_week_number(d, first_dow) - year_week_number(as_of, first_dow),
            f"{prefix}relative_month_pos": months(d) - months(as_of),
            f"{prefix}relative_quarter_pos": quarters(d) - quarters(as_of),
            f"{prefix}relative_year_pos": F.year(d) - F.year(as_of),
        }
    )


def period_bounds(df: DataFrame) -> DataFrame:
    """First and last day, length and day number of month, quarter and year."""
    d = F.col("date")
    month, quarter, year = (F.trunc(d, p) for p in ("month", "quarter", "year"))
    quarter_end = F.date_sub(F.add_months(quarter, 3), 1)
    year_end = F.date_sub(F.add_months(year, 12), 1)
    return df.withColumns(
        {
            "start_of_month": month,
            "end_of_month": F.last_day(d),
            "start_of_quarter": quarter,
            "end_of_quarter": quarter_end,
            "start_of_year": year,
            "end_of_year": year_end,
            "month_days": F.dayofmonth(F.last_day(d)),
            "quarter_days": F.datediff(quarter_end, quarter) + 1,
            "year_days": F.dayofyear(year_end),
            "day_of_month_number": F.dayofmonth(d),
            "day_of_quarter_number": F.datediff(d, quarter) + 1,
            "day_of_year_number": F.dayofyear(d),
        }
    )


def previous_dates(df: DataFrame) -> DataFrame:
    d = F.col("date")
    return df.withColumns(
        {
            "date_previous_week": F.date_sub(d, 7),
            "date_previous_month": previous_by_months(d, 1),
            "date_previous_quarter": previous_by_months(d, 3),
            "date_previous_year": previous_by_months(d, 12),
        }
    )


def working_day(df: DataFrame, working_days: Sequence[int] = MONDAY_TO_FRIDAY) -> DataFrame:
    """Flag and label of working days: the right weekday and no holiday."""
    flag = (F.dayofweek("date") - 1).isin(*working_days) & F.col("holiday_name").isNull()
    label = F.when(flag, "Working day").otherwise("Non-working day")
    return df.withColumns({"is_working_day": flag, "day_type": label})


def fiscal_calendar(df: DataFrame, first_month: int = 1, label_rule: int = 1, first_dow: int = 0) -> DataFrame:
    """Fiscal years that start on the first of ``first_month``.

    ``label_rule`` 1 names the year after the calendar year of its last day, 0 after that of its first.
    """
    d = F.col("date")
    shift = first_month - 1
    # Moving the date back by the shift turns fiscal arithmetic into Gregorian arithmetic.
    start_year = F.year(F.add_months(d, -shift))
    lead = label_rule if first_month > 1 else 0
    year = start_year + lead
    month = F.pmod(F.month(d) - first_month, F.lit(12)) + 1
    quarter = F.ceil(month / 3).cast("int")
    start = F.make_date(start_year, F.lit(first_month), F.lit(1))
    end = F.date_sub(F.add_months(start, 12), 1)
    quarter_start = F.add_months(start, (quarter - 1) * 3)
    quarter_end = F.date_sub(F.add_months(quarter_start, 3), 1)
    week = year_week_number(d, first_dow) - year_week_number(start, first_dow) + 1
    label = year.cast("string")
    quarter_label = F.concat(F.lit("FQ"), quarter.cast("string"), F.lit(" "))
    week_label = F.concat(F.lit("FW"), F.lpad(week.cast("string"), 2, "0"))
    return df.withColumns(
        {
            "fiscal_year": F.concat(F.lit("F "), label),
            "fiscal_year_number": year,
            "fiscal_quarter_number": quarter,
            "fiscal_quarter": quarter_label,
            "fiscal_year_quarter_number": year * 4 - 1 + quarter,
            "fiscal_quarter_year": F.concat(quarter_label, label),
            "fiscal_month_number": month,
            "fiscal_month": F.date_format(d, "MMM"),
            "fiscal_year_month_number": year * 12 - 1 + month,
            "fiscal_month_year": F.concat(F.date_format(d, "MMM"), F.lit(" "), F.year(d).cast("string")),
            "fiscal_week_number": week,
            "fiscal_week": week_label,
            "fiscal_year_week_number": year_week_number(d, first_dow),
            "fiscal_week_year": F.concat(week_label, F.lit("-"), label),
            "fiscal_week_year_order": year * 100 + week,
            "fiscal_day_of_year_number": F.datediff(d, start) + 1,
            "fiscal_start_of_quarter": quarter_start,
            "fiscal_end_of_quarter": quarter_end,
            "fiscal_quarter_days": F.datediff(quarter_end, quarter_start) + 1,
            "fiscal_day_of_quarter_number": F.datediff(d, quarter_start) + 1,
            "fiscal_start_of_year": start,
            "fiscal_end_of_year": end,
            "fiscal_year_days": F.datediff(end, start) + 1,
        }
    )


def fiscal_relative_positions(
    df: DataFrame, as_of: Column, first_month: int = 1, first_dow: int = 0
) -> DataFrame:
    """Distance from the reference day in weeks, fiscal months, quarters and years."""
    shift = first_month - 1

    def fiscal_months(x: Column) -> Column:
        moved = F.add_months(F.trunc(x, "month"), -shift)
        return F.year(moved) * 12 + F.month(moved) - 1

    here, there = fiscal_months(F.col("date")), fiscal_months(as_of)
    return df.withColumns(
        {
            "fiscal_relative_week_pos": year_week_number(F.col("date"), first_dow) - year_week_number(as_of, first_dow),
            "fiscal_relative_month_pos": here - there,
            "fiscal_relative_quarter_pos": (F.floor(here / 3) - F.floor(there / 3)).cast("int"),
            "fiscal_relative_year_pos": (F.floor(here / 12) - F.floor(there / 12)).cast("int"),
        }
    )


def fiscal_week_relative_positions(weeks: DataFrame, as_of: Column) -> DataFrame:
    """Distance of each day from the reference day in fiscal weeks, months, quarters and years; null when
    the reference day lies outside of the weekly years."""
    levels = {
        "week": "fw_year_week_number",
        "month": "fw_year_month_number",
        "quarter": "fw_year_quarter_number",
        "year": "fw_year_number",
    }
    now = weeks.filter(F.col("date") == as_of).agg(
        F.struct(*[F.max(column).alias(level) for level, column in levels.items()]).alias("now")
    )
    placed = weeks.withColumn("_now", now.scalar())
    return placed.withColumns(
        {f"fw_relative_{level}_pos": F.col(column) - F.col(f"_now.{level}") for level, column in levels.items()}
    ).drop("_now")


def _fiscal_year_start(year: Column, first_month: int, week_rule: str, first_dow: int) -> Column:
    """First day of a fiscal year made of whole weeks."""
    anchor = F.make_date(year, F.lit(first_month), F.lit(1))
    back = weekday_number(anchor, first_dow) - 1
    if week_rule == "Last":
        return F.date_sub(anchor, back)
    if week_rule == "Nearest":
        return F.when(back >= 4, F.date_add(anchor, 7 - back)).otherwise(F.date_sub(anchor, back))
    raise ValueError(f"unknown week rule {week_rule!r}")


def weekly_periods(
    bounds: DataFrame, first_month: int = 1, label_rule: int = 1, week_rule: str = "Last", first_dow: int = 0
) -> DataFrame:
    """Fiscal years of whole weeks as (fw_year_number, fw_start_of_year, fw_end_of_year)."""
    extra = 1 if first_month > 1 else 0
    years = bounds.select(
        F.explode(F.sequence(F.col("first_year") - extra, F.col("last_year") + extra)).alias("fw_year_number")
    )
    starts_in = F.col("fw_year_number") - extra * label_rule
    return years.select(
        "fw_year_number",
        _fiscal_year_start(starts_in, first_month, week_rule, first_dow).alias("fw_start_of_year"),
        F.date_sub(_fiscal_year_start(starts_in + 1, first_month, week_rule, first_dow), 1).alias("fw_end_of_year"),
    )


def custom_periods(
    spark: SparkSession, periods: list[tuple[int, dt.date, dt.date]], first_dow: int = 0, check: bool = True
) -> DataFrame:
    """Explicit fiscal years. The first one must start on the first day of the week unless unchecked."""
    if check and periods and (min(p[1] for p in periods).isoweekday() % 7) != first_dow:
        raise ValueError("custom fiscal periods do not start on the first day of the week")
    return literal_table(spark, periods, "fw_year_number int, fw_start_of_year date, fw_end_of_year date")


def fiscal_weeks(periods: DataFrame, pattern: str = "445", first_dow: int = 0) -> DataFrame:
    """Days of weekly fiscal years with their week, 4-week period, month and quarter.

    A 53rd week belongs to the last month and quarter and forms period 14 of its own. Spans and previous periods follow
    from the start of the year, the week and the pattern; nothing is joined.
    """
    if pattern not in QUARTER_PATTERNS:
        raise ValueError(f"unsupported quarter pattern {pattern!r}")
    in_first, in_second, _ = QUARTER_PATTERNS[pattern]
    # One row a year; the year before is the only thing that a day's own year does not tell.
    earlier = F.lag(F.struct("fw_year_number", F.col("fw_start_of_year").alias("start"), F.col("fw_end_of_year").alias("end"))).over(Window.orderBy("fw_year_number"))
    known = periods.withColumn("_before", earlier).withColumn("_before", F.when(F.col("_before.fw_year_number") == F.col("fw_year_number") - 1, F.col("_before")))
    days = known.withColumn("date", date_series(F.col("fw_start_of_year"), F.col("fw_end_of_year")))
    d, year = F.col("date"), F.col("fw_year_number")
    day_of_year = F.datediff(d, "fw_start_of_year") + 1
    week = F.ceil(day_of_year / 7).cast("int")
    regular = F.least(week, F.lit(52))
    quarter = F.ceil(regular / 13).cast("int")
    in_quarter = week - (quarter - 1) * 13
    month = (quarter - 1) * 3 + F.when(in_quarter <= in_first, 1).when(in_quarter <= in_first + in_second, 2).otherwise(3)
    period = F.when(week > 52, 14).otherwise(F.ceil(week / 4).cast("int"))
    week_start = F.date_sub(d, weekday_number(d, first_dow) - 1)

    def two_digits(c: Column) -> Column:
        return F.lpad(c.cast("string"), 2, "0")

    based = days.withColumns(
        {
            "fw_quarter_number": quarter,
            "fw_year_quarter_number": year * 4 - 1 + quarter,
            "fw_month_number": month,
            "fw_year_month_number": year * 12 - 1 + month,
            "fw_week_number": week,
            "fw_period_number": period,
            "fw_year_week_number": year_week_number(d, first_dow) + 1,
            "fw_start_of_week": week_start,
            "fw_end_of_week": F.date_add(week_start, 6),
            "fw_day_of_year_number": day_of_year,
            "fw_year_days": F.datediff("fw_end_of_year", "fw_start_of_year") + 1,
        }
    ).withColumns(
        {
            "fw_year": F.concat(F.lit("FW  "), year.cast("string")),
            "fw_quarter": F.concat(F.lit("FW Q"), F.col("fw_quarter_number").cast("string")),
            "fw_month": F.concat(F.lit("FW P"), two_digits(F.col("fw_month_number"))),
            "fw_week": F.concat(F.lit("FW W"), two_digits(F.col("fw_week_number"))),
            "fw_period": F.concat(F.lit("FW P"), two_digits(F.col("fw_period_number"))),
        }
    )
    labelled = based.withColumns(
        {
            f"{c}_year": F.concat(F.col(c), F.lit(" "), year.cast("string"))
            for c in ("fw_quarter", "fw_month", "fw_week")
        }
    )
    return _fiscal_previous_dates(_with_fiscal_spans(labelled, pattern), pattern)


def _span(level: str, number: str, start: str, end: str, pattern: str) -> tuple[str, str]:
    """First and last day of a fiscal month or quarter of the year from ``start`` to ``end``, as expressions. The last one
    takes the 53rd week; a year that ends early cuts what does not fit."""
    if level == "quarter":
        first, weeks, last = f"13 * ({number} - 1)", "13", f"{number} = 4"
    else:
        one, two, three = QUARTER_PATTERNS[pattern]
        place, quarter = f"({number} - 1) % 3", f"cast(({number} - 1) div 3 as int)"
        first = f"13 * {quarter} + element_at(array(0, {one}, {one + two}), {place} + 1)"
        weeks, last = f"element_at(array({one}, {two}, {three}), {place} + 1)", f"{number} = 12"
    begins = f"date_add({start}, 7 * ({first}))"
    return begins, f"if({last}, {end}, least(date_add({begins}, 7 * {weeks} - 1), {end}))"


def _with_fiscal_spans(df: DataFrame, pattern: str) -> DataFrame:
    """Bounds of the fiscal month and quarter of each day."""
    bounds, lengths = {}, {}
    for level in ("month", "quarter"):
        start, end = _span(level, f"fw_{level}_number", "fw_start_of_year", "fw_end_of_year", pattern)
        bounds |= {f"fw_start_of_{level}": F.expr(start), f"fw_end_of_{level}": F.expr(end)}
        lengths[f"fw_{level}_days"] = F.expr(f"datediff(fw_end_of_{level}, fw_start_of_{level}) + 1")
        lengths[f"fw_day_of_{level}_number"] = F.expr(f"datediff(date, fw_start_of_{level}) + 1")
    return df.withColumns(bounds).withColumns(lengths)


def _fiscal_previous_dates(df: DataFrame, pattern: str) -> DataFrame:
    """Counterpart of each day in the previous fiscal week, month, quarter and year, from the bounds of its year and of the
    year before (``_before``, null where there is none).

    The last day of a period maps to the last day of the one before; other days keep their number in the
    period as far as the earlier one is long enough.
    """
    previous = {"fw_date_previous_week": F.expr("date_sub(date, 7)")}
    for level, most in (("month", 12), ("quarter", 4), ("year", 1)):
        first, last, inside = "_before.start", "_before.end", "false"
        if level != "year":
            inside = f"fw_{level}_number > 1"
            there = f"if({inside}, fw_{level}_number - 1, {most})"
            first, last = _span(level, there, f"if({inside}, fw_start_of_year, _before.start)", f"if({inside}, fw_end_of_year, _before.end)", pattern)
        day = f"fw_day_of_{level}_number"
        counterpart = f"if({day} = fw_{level}_days, {last}, least(date_add({first}, {day} - 1), {last}))"
        # A year before that ends early may not have its last month or quarter.
        previous[f"fw_date_previous_{level}"] = F.expr(f"if({inside} or {first} <= _before.end, {counterpart}, null)")
    return df.withColumns(previous).drop("_before")


def calendar(
    bounds: DataFrame,
    kind: str = "Calendar",
    country: str = "PT",
    first_dow: int = 0,
    first_month: int = 1,
    label_rule: int = 1,
    week_rule: str = "Last",
    pattern: str = "445",
    working_days: Sequence[int] = MONDAY_TO_FRIDAY,
    fiscal: bool = False,
    periods: DataFrame | None = None,
) -> DataFrame:
    """The full calendar for a bounds row. ``kind`` chooses which year number must lie within the bounds;
    ``fiscal`` adds the fiscal and fiscal-week columns to the result; ``periods`` replaces the weekly rule."""
    if kind not in CALENDAR_KINDS:
        raise ValueError(f"unknown calendar range {kind!r}")
    start = F.make_date(F.col("first_year") - 1, F.lit(1), F.lit(1))
    end = F.make_date(F.col("last_year") + 1, F.lit(12), F.lit(31))
    days = bounds.select("first_year", "last_year", "as_of", date_series(start, end).alias("date"))
    named = holidays(padded_years(bounds), country, working_days).select("date", "holiday_name")
    out = days.join(named, "date", "left")
    out = calendar_fields(out, first_dow)
    out = relative_positions(out, F.col("as_of"), first_dow)
    out = working_day(previous_dates(period_bounds(out)), working_days)
    plain = [c for c in out.columns if c not in ("first_year", "last_year", "as_of")]
    in_range = F.col("year_number")
    if fiscal or kind == "FiscalGregorian":
        out = fiscal_calendar(out, first_month, label_rule, first_dow)
        out = fiscal_relative_positions(out, F.col("as_of"), first_month, first_dow)
        in_range = F.col("fiscal_year_number") if kind == "FiscalGregorian" else in_range
    if fiscal or kind == "FiscalWeekly":
        if periods is None:
            periods = weekly_periods(bounds, first_month, label_rule, week_rule, first_dow)
        weeks = fiscal_weeks(periods, pattern, first_dow)
        today = bounds.select("as_of").scalar()
        out = out.join(fiscal_week_relative_positions(weeks, today), "date", "left")
        in_range = F.col("fw_year_number") if kind == "FiscalWeekly" else in_range
    kept = out.filter(in_range.between(F.col("first_year"), F.col("last_year")))
    return kept.drop("first_year", "last_year", "as_of") if fiscal else kept.select(*plain)
