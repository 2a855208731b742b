"""Public holidays by rule: fixed days, nth weekdays, Easter and midsummer offsets, observed substitutes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martlet.operators.joins import generate, top_one
from martlet.sources.readers import literal_table

MONDAY_TO_FRIDAY = (1, 2, 3, 4, 5)  # 0 = Sunday

RULE_SCHEMA = (
    "country string, kind string, month int, day int, weekday int, nth int, offset_days int, "
    "holiday_name string, substitute int, priority int, first_year int, last_year int"
)


SUBSTITUTE = 7  # place of the substitute code in a rule


def _rule(kind, name, month=0, day=0, weekday=0, nth=0, offset=0, substitute=0, priority=100, since=0, until=0):
    return (kind, month, day, weekday, nth, offset, name, substitute, priority, since, until)


def _on(month, day, name, **more):
    return _rule("fixed", name, month=month, day=day, **more)


def _nth(month, weekday, nth, name, **more):
    return _rule("weekday", name, month=month, weekday=weekday, nth=nth, **more)


def _easter(offset, name, priority=50):
    return _rule("easter", name, offset=offset, priority=priority)


def _midsummer(offset, name, priority=50):
    return _rule("midsummer", name, offset=offset, priority=priority)


# Holiday rules by ISO country code. Weekdays count from 0 = Sunday, nth -1 is the last one.
# substitute: 0 none, 1 next working day, 2 the working day after that, -1 Friday or Monday next to a weekend.
# A lower priority number wins when two holidays share a date.
HOLIDAY_RULES = {
    "US": [
        _on(1, 1, "New Year's Day"),
        _nth(1, 1, 3, "Martin Luther King, Jr."),
        _nth(2, 1, 3, "Presidents' Day"),
        _nth(5, 1, -1, "Memorial Day"),
        _on(6, 19, "Juneteenth", substitute=-1, since=2021),
        _on(7, 4, "Independence Day"),
        _nth(9, 1, 1, "Labor Day"),
        _nth(10, 1, 2, "Columbus Day"),
        _on(11, 11, "Veterans Day"),
        _nth(11, 4, 4, "Thanksgiving Day"),
        _nth(11, 4, 4, "Black Friday", offset=1),
        _on(12, 25, "Christmas Day"),
    ],
    "AT": [
        _on(1, 1, "New Year's Day"),
        _on(1, 6, "Epiphany"),
        _easter(1, "Easter Monday"),
        _on(5, 1, "Labour Day"),
        _easter(39, "Ascension Day"),
        _easter(50, "Whit Monday"),
        _easter(60, "Corpus Christi"),
        _on(8, 15, "Assumption Day"),
        _on(10, 26, "National Day"),
        _on(11, 1, "All Saints' Day"),
        _on(12, 8, "Immaculate Conception Day"),
        _on(12, 25, "Christmas Day"),
        _on(12, 26, "St. Stephen's Day"),
    ],
    "AU": [
        _on(1, 1, "New Year's Day", substitute=1),
        _on(1, 26, "Australia Day", substitute=1),
        _easter(-2, "Good Friday"),
        _easter(1, "Easter Monday"),
        _on(4, 25, "Anzac Day", substitute=1),
        _on(12, 25, "Christmas Day", substitute=2),
        _on(12, 26, "Boxing Day", substitute=1),
    ],
    "BE": [
        _on(1, 1, "New Year's Day"),
        _easter(1, "Easter Monday"),
        _easter(39, "Ascension Day"),
        _easter(50, "Whit Monday"),
        _on(5, 1, "Labour Day"),
        _on(7, 21, "Belgian National DayDay"),
        _on(8, 15, "Assumption Day"),
        _on(11, 1, "All Saints' Day"),
        _on(11, 11, "Armistice Day"),
        _on(12, 25, "Christmas Day"),
    ],
    "CA": [
        _on(1, 1, "New Year's Day"),
        _easter(-2, "Good Friday"),
        _on(7, 1, "Canada Day"),
        _nth(9, 1, 1, "Labour Day"),
        _nth(10, 1, 2, "Thanksgiving"),
        _on(12, 25, "Christmas Day"),
    ],
    "DE": [
        _on(1, 1, "New Year's Day"),
        _easter(-2, "Good Friday"),
        _easter(1, "Easter Monday"),
        _on(5, 1, "Labour Day"),
        _easter(39, "Ascension Day"),
        _easter(50, "Whit Monday"),
        _on(10, 3, "German Unity Day"),
        _on(12, 25, "Christmas Day"),
        _on(12, 26, "St. Stephen's Day"),
    ],
    "ES": [
        _on(1, 1, "New Year's Day"),
        _on(1, 6, "Epiphany"),
        _easter(-3, "Maundy Thursday"),
        _easter(-2, "Good Friday"),
        _easter(1, "Easter Monday"),
        _on(5, 1, "Labour Day"),
        _on(8, 15, "Assumption Day"),
        _on(10, 12, "Fiesta Navional de España"),
        _on(11, 1, "All Saints' Day"),
        _on(12, 6, "Constitution Day"),
        _on(12, 8, "Immaculate Conception"),
        _on(12, 25, "Christmas Day"),
    ],
    "FR": [
        _on(1, 1, "New Year's Day"),
        _easter(1, "Easter Monday"),
        _on(5, 1, "Labour Day"),
        _on(5, 8, "Victor in Europe Day"),
        _easter(39, "Ascension Day"),
        _easter(50, "Whit Monday"),
        _on(7, 14, "Bastille Day"),
        _on(8, 15, "Assumption Day"),
        _on(11, 1, "All Saints' Day"),
        _on(11, 11, "Armistice Day"),
        _on(12, 25, "Christmas Day"),
    ],
    "GB": [
        _on(1, 1, "New Year's Day", substitute=1),
        _easter(-2, "Good Friday"),
        _easter(1, "Easter Monday"),
        _nth(5, 1, 1, "May Day Bank Holiday"),
        _nth(5, 1, -1, "Spring Bank Holiday"),
        _nth(8, 1, -1, "Late Summer Bank Holiday"),
        _on(12, 25, "Christmas Day", substitute=2),
        _on(12, 26, "Boxing Day", substitute=1),
    ],
    "IT": [
        _on(1, 1, "New Year's Day"),
        _on(1, 6, "Epiphany"),
        _easter(1, "Easter Monday", priority=100),
        _on(4, 25, "Liberation Day"),
        _on(5, 1, "Labour Day"),
        _on(6, 2, "Republic Day"),
        _on(8, 15, "Assumption Day"),
        _on(11, 1, "All Saints' Day"),
        _on(12, 8, "Immaculate Conception"),
        _on(12, 25, "Christmas Day"),
        _on(12, 26, "St. Stephen's Day"),
    ],
    "NL": [
        _on(1, 1, "New Year's Day"),
        _easter(1, "Easter Monday"),
        _easter(39, "Ascension Day"),
        _easter(50, "Whit Monday"),
        _on(4, 27, "King's Day"),
        _on(5, 5, "Liberation Day"),
        _on(12, 25, "Christmas Day"),
        _on(12, 26, "St. Stephen's Day"),
    ],
    "NO": [
        _on(1, 1, "New Year's Day"),
        _easter(-3, "Maundy Thursday", priority=100),
        _easter(-2, "Good Friday"),
        _easter(1, "Easter Monday"),
        _easter(39, "Ascension Day"),
        _easter(50, "Whit Monday"),
        _on(5, 1, "Labour Day"),
        _on(5, 17, "Constitution Day"),
        _on(12, 25, "Christmas Day"),
        _on(12, 26, "Boxing Day"),
        _on(12, 24, "Christmas Eve", priority=50),
        _on(12, 31, "New Year's Eve", priority=50),
    ],
    "PT": [
        _on(1, 1, "New Year's Day"),
        _easter(-2, "Good Friday"),
        _easter(60, "Corpus Christi"),
        _on(4, 25, "Freedom Day"),
        _on(5, 1, "Labour Day"),
        _on(6, 10, "Portugal Day"),
        _on(8, 15, "Assumption Day"),
        _on(10, 5, "Republic Day"),
        _on(11, 1, "All Saints' Day"),
        _on(12, 1, "Restoration of Independence"),
        _on(12, 8, "Immaculate Conception"),
        _on(12, 25, "Christmas Day"),
    ],
    "SE": [
        _on(1, 1, "New Year's Day"),
        _on(1, 6, "Epiphany"),
        _easter(-2, "Good Friday"),
        _easter(1, "Easter Monday"),
        _easter(39, "Ascension Day"),
        _on(5, 1, "Labour Day"),
        _on(6, 6, "National Day"),
        _on(12, 25, "Christmas Day"),
        _on(12, 26, "Boxing Day"),
        _on(12, 24, "Christmas Eve", priority=50),
        _on(12, 31, "New Year's Eve", priority=50),
        _midsummer(-1, "Midsummer Eve"),
    ],
}


def holiday_rules(spark: SparkSession, country: str | None = None) -> DataFrame:
    """Rules of one country, of all (``None``) or of none (``""``). An unsupported code is an error."""
    if country and country not in HOLIDAY_RULES:
        raise ValueError(f"no holiday rules for country {country!r}")
    chosen = HOLIDAY_RULES if country is None else {country: HOLIDAY_RULES[country]} if country else {}
    rows = [(code, *rule) for code, rules in chosen.items() for rule in rules]
    return literal_table(spark, rows, RULE_SCHEMA)


def easter(year: Column) -> Column:
    """Gregorian Easter Sunday (anonymous Gregorian computus)."""
    golden, century, of_century = F.pmod(year, F.lit(19)), F.floor(year / 100), F.pmod(year, F.lit(100))
    leap_centuries, century_rest = F.floor(century / 4), F.pmod(century, F.lit(4))
    moon_shift = F.floor((century - F.floor((century + 8) / 25) + 1) / 3)
    epact = F.pmod(golden * 19 + century - leap_centuries - moon_shift + 15, F.lit(30))
    weekday = F.pmod(
        century_rest * 2 + F.floor(of_century / 4) * 2 + 32 - epact - F.pmod(of_century, F.lit(4)), F.lit(7)
    )
    late = F.floor((golden + epact * 11 + weekday * 22) / 451)
    days = epact + weekday - late * 7 + 114
    return F.make_date(
        year.cast("int"), F.floor(days / 31).cast("int"), (F.pmod(days, F.lit(31)) + 1).cast("int")
    )


def midsummer(year: Column) -> Column:
    """Saturday between 20 and 26 June."""
    june20 = F.make_date(year.cast("int"), F.lit(6), F.lit(20))
    return F.date_add(june20, 7 - F.dayofweek(june20))


def nth_weekday(year: Column, month: Column, weekday: Column, nth: Column, offset_days: Column) -> Column:
    """The nth (from the end when negative) given weekday of a month, moved by some days."""
    first = F.make_date(year.cast("int"), month, F.lit(1))
    last = F.last_day(first)
    forward = F.pmod(weekday - (F.dayofweek(first) - 1), F.lit(7)) + (nth - 1) * 7
    backward = F.pmod((F.dayofweek(last) - 1) - weekday, F.lit(7)) - (nth + 1) * 7
    day = F.when(nth > 0, F.date_add(first, forward)).otherwise(F.date_sub(last, backward))
    return F.date_add(day, offset_days)


def valid_rules(dated: DataFrame) -> DataFrame:
    """Rules in the years they were in force; 0 means no bound."""
    return dated.filter(
        ((F.col("first_year") == 0) | (F.col("first_year") <= F.col("year")))
        & ((F.col("last_year") == 0) | (F.col("last_year") >= F.col("year")))
    )


def raw_holidays(years: DataFrame, rules: DataFrame) -> DataFrame:
    """Every rule in every year as a date; dates may repeat."""
    year = F.col("year")
    date = (
        F.when(F.col("kind") == "fixed", F.make_date(year.cast("int"), F.col("month"), F.col("day")))
        .when(F.col("kind") == "easter", F.date_add(easter(year), F.col("offset_days")))
        .when(F.col("kind") == "midsummer", F.date_add(midsummer(year), F.col("offset_days")))
        .when(
            F.col("kind") == "weekday",
            nth_weekday(year, F.col("month"), F.col("weekday"), F.col("nth"), F.col("offset_days")),
        )
        .otherwise(F.raise_error(F.lit("wrong kind of holiday rule")).cast("date"))
    )
    return valid_rules(generate(years.select("year"), rules)).withColumn("date", date)


def one_holiday_per_date(holidays: DataFrame) -> DataFrame:
    """Settle dates with several holidays by priority, then name."""
    return top_one(holidays, ["country", "date"], F.col("priority"), F.col("holiday_name"))


def substitute_holidays(
    holidays: DataFrame, rules_per_year: int, working_days: Sequence[int] = MONDAY_TO_FRIDAY
) -> DataFrame:
    """Observed days of holidays that fall on non-working days or on another holiday.

    The observed day is the first working day, from the day the rule points at, that is no other holiday.
    ``rules_per_year`` bounds the search: that many holidays cannot block more working days than that.
    """
    weekday = F.dayofweek("date") - 1
    to_next_working = F.least(*[F.pmod(F.lit(d) - weekday, F.lit(7)) for d in working_days])
    is_off = ~weekday.isin(*working_days)
    shift = (
        F.when((F.col("substitute") == -1) & (weekday == 0), F.lit(1))
        .when((F.col("substitute") == -1) & (weekday == 6), F.lit(-1))
        .when((F.col("substitute") > 0) & is_off, to_next_working + F.col("substitute") - 1)
        .otherwise(F.lit(0))
    )
    start = F.date_add(F.col("date"), shift)
    span = 7 * (rules_per_year + 2)
    candidates = (
        holidays.filter(F.col("substitute") != 0)
        .select("country", "date", "holiday_name", "priority", F.explode(F.sequence(start, F.date_add(start, span))).alias("observed"))
        .filter((F.dayofweek("observed") - 1).isin(*working_days))
    )
    taken = holidays.select("country", F.col("date").alias("observed"), F.col("holiday_name").alias("_other"))
    blocked = candidates.join(taken, ["country", "observed"]).filter(
        (F.col("_other") != F.col("holiday_name")) | (F.col("observed") != F.col("date"))
    )
    free = candidates.join(
        blocked.select("country", "date", "holiday_name", "observed").distinct(),
        ["country", "date", "holiday_name", "observed"],
        "left_anti",
    )
    first_free = free.groupBy("country", "date", "holiday_name", "priority").agg(F.min("observed").alias("observed"))
    moved = first_free.filter(F.col("observed") != F.col("date"))
    chosen = top_one(moved, ["country", "observed"], F.col("priority"), F.col("holiday_name"))
    return chosen.select(
        "country",
        F.col("observed").alias("date"),
        F.concat(F.lit("(in lieu of "), F.col("holiday_name"), F.lit(")")).alias("holiday_name"),
    )


def all_holidays(generated: DataFrame, substitutes: DataFrame) -> DataFrame:
    columns = ["country", "date", "holiday_name"]
    return generated.select(*columns).unionByName(substitutes.select(*columns))


def holidays(
    years: DataFrame, country: str | None = "PT", working_days: Sequence[int] = MONDAY_TO_FRIDAY
) -> DataFrame:
    """Holidays and observed substitutes (country, date, holiday_name) of the given years (column ``year``)."""
    rules = holiday_rules(years.sparkSession, country)
    raw = raw_holidays(years, rules)
    generated = one_holiday_per_date(raw)
    chosen = HOLIDAY_RULES.values() if country is None else [HOLIDAY_RULES.get(country, [])]
    if not any(rule[SUBSTITUTE] for of_country in chosen for rule in of_country):
        return generated.select("country", "date", "holiday_name")
    return all_holidays(generated, substitute_holidays(raw, max(map(len, chosen)), working_days))
