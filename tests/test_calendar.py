from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from martlet.operators import calendar as C
from martlet.operators import holidays as H

D = dt.date
EASTER = {
    2015: D(2015, 4, 5), 2016: D(2016, 3, 27), 2017: D(2017, 4, 16), 2018: D(2018, 4, 1), 2019: D(2019, 4, 21),
    2020: D(2020, 4, 12), 2021: D(2021, 4, 4), 2022: D(2022, 4, 17), 2023: D(2023, 4, 9), 2024: D(2024, 3, 31),
    2025: D(2025, 4, 20), 2026: D(2026, 4, 5),
}


@pytest.fixture(scope="module")
def bounds(spark):
    return C.year_bounds(spark, 2016, 2026, D(2024, 2, 29))


@pytest.fixture(scope="module")
def by_date(bounds):
    return {r.date: r for r in C.calendar(bounds).collect()}


def test_easter(frame):
    rows = frame([(y,) for y in EASTER], "year int").select("year", H.easter(F.col("year")).alias("e")).collect()
    assert {r.year: r.e for r in rows} == EASTER


def test_calendar_spans_whole_years(by_date):
    assert min(by_date) == D(2016, 1, 1) and max(by_date) == D(2026, 12, 31)
    assert len(by_date) == (D(2027, 1, 1) - D(2016, 1, 1)).days


def test_labels_and_keys(by_date):
    r = by_date[D(2018, 9, 3)]
    assert (r.date_key, r.quarter_year, r.month_year, r.week_day) == (20180903, "Q3 2018", "Sep 2018", "Mon")
    assert (r.year_quarter_number, r.year_month_number) == (2018 * 4 + 2, 2018 * 12 + 8)
    assert (r.week, r.week_year) == ("W36", "W36-2018")


def test_week_numbers_start_on_sunday(by_date):
    assert by_date[D(2018, 1, 6)].week_number == 1  # Saturday
    assert by_date[D(2018, 1, 7)].week_number == 2
    assert by_date[D(2016, 12, 31)].week_number == 53
    assert by_date[D(2017, 1, 1)].week_number == 1
    assert by_date[D(2018, 1, 7)].weekday_number == 1


def test_365_day_number_skips_leap_days(by_date):
    n = {d: r.sequential_365_day_number for d, r in by_date.items()}
    assert n[D(2017, 3, 1)] - n[D(2016, 3, 1)] == 365
    assert n[D(2016, 2, 29)] == n[D(2016, 2, 28)]
    assert n[D(2021, 1, 1)] - n[D(2020, 1, 1)] == 365


def test_previous_dates(by_date):
    assert by_date[D(2018, 3, 31)].date_previous_month == D(2018, 2, 28)
    assert by_date[D(2018, 3, 29)].date_previous_month == D(2018, 2, 28)
    assert by_date[D(2018, 2, 28)].date_previous_month == D(2018, 1, 31)  # end maps to end
    assert by_date[D(2017, 2, 28)].date_previous_year == D(2016, 2, 29)
    assert by_date[D(2018, 5, 31)].date_previous_quarter == D(2018, 2, 28)
    assert by_date[D(2018, 5, 31)].date_previous_week == D(2018, 5, 24)


def test_relative_positions(by_date):
    now, later, before = by_date[D(2024, 2, 29)], by_date[D(2024, 3, 3)], by_date[D(2023, 12, 31)]
    assert now.relative_week_pos == now.relative_month_pos == now.relative_quarter_pos == now.relative_year_pos == 0
    assert (later.relative_week_pos, later.relative_month_pos) == (1, 1)
    assert (before.relative_quarter_pos, before.relative_year_pos) == (-1, -1)


def test_working_days(by_date):
    assert by_date[D(2018, 4, 25)].holiday_name == "Freedom Day" and not by_date[D(2018, 4, 25)].is_working_day
    assert by_date[D(2018, 3, 30)].holiday_name == "Good Friday"
    assert by_date[D(2018, 4, 26)].is_working_day
    assert by_date[D(2018, 4, 28)].day_type == "Non-working day"


def _holidays(spark, country, first, last):
    years = spark.createDataFrame([(y,) for y in range(first, last + 1)], "year int")
    return {(r.date, r.holiday_name) for r in H.holidays(years, country).collect()}


def test_substitutes_follow_known_calendars(spark):
    gb = _holidays(spark, "GB", 2020, 2023)
    assert (D(2021, 12, 27), "(in lieu of Boxing Day)") in gb  # 26 December 2021 was a Sunday
    assert (D(2021, 12, 28), "(in lieu of Christmas Day)") in gb
    assert (D(2022, 12, 27), "(in lieu of Christmas Day)") in gb
    assert (D(2022, 1, 3), "(in lieu of New Year's Day)") in gb
    assert (D(2020, 12, 28), "(in lieu of Boxing Day)") in gb
    assert not any(d.year == 2023 and d.month == 12 and "in lieu" in n for d, n in gb)
    au = _holidays(spark, "AU", 2011, 2011)
    assert (D(2011, 4, 26), "(in lieu of Anzac Day)") in au  # 25 April 2011 was Easter Monday
    us = _holidays(spark, "US", 2020, 2021)
    assert (D(2021, 6, 18), "(in lieu of Juneteenth)") in us
    assert not any(n == "Juneteenth" and d.year == 2020 for d, n in us)
    assert (D(2021, 11, 26), "Black Friday") in us and (D(2021, 5, 31), "Memorial Day") in us


def test_conflicts_are_settled_by_priority(spark):
    # 25 April 2011: Anzac Day (100) and Easter Monday (50).
    au = _holidays(spark, "AU", 2011, 2011)
    assert (D(2011, 4, 25), "Easter Monday") in au and (D(2011, 4, 25), "Anzac Day") not in au


def test_midsummer_and_no_country(spark):
    assert (D(2023, 6, 23), "Midsummer Eve") in _holidays(spark, "SE", 2023, 2023)
    assert _holidays(spark, "", 2023, 2023) == set()
    with pytest.raises(ValueError):
        H.holiday_rules(spark, "XX")


def test_fiscal_year_from_july(bounds):
    rows = {r.date: r for r in C.calendar(bounds, fiscal=True, first_month=7).collect()}
    r = rows[D(2018, 7, 1)]
    assert (r.fiscal_year_number, r.fiscal_month_number, r.fiscal_quarter_number, r.fiscal_day_of_year_number) == (2019, 1, 1, 1)
    assert rows[D(2019, 6, 30)].fiscal_year_number == 2019 and rows[D(2019, 6, 30)].fiscal_month_number == 12
    by_first = {r.date: r for r in C.calendar(bounds, fiscal=True, first_month=7, label_rule=0).collect()}
    assert by_first[D(2018, 7, 1)].fiscal_year_number == 2018 and by_first[D(2018, 6, 30)].fiscal_year_number == 2017


def test_fiscal_weeks_against_brute_force(bounds):
    for pattern, rule in (("445", "Last"), ("544", "Nearest")):
        rows = C.fiscal_weeks(C.weekly_periods(bounds, week_rule=rule), pattern).collect()
        days = {r.date: r for r in rows}
        assert len(days) == len(rows)
        months: dict = {}
        for r in rows:
            months.setdefault(r.fw_year_month_number, []).append(r)
        for r in rows:
            assert (r.date.isoweekday() % 7 == 0) == (r.fw_start_of_week == r.date)
            earlier = months.get(r.fw_year_month_number - 1)
            if earlier:
                last = r.fw_day_of_month_number == r.fw_month_days
                want = max(e.date for e in earlier if last or e.fw_day_of_month_number <= r.fw_day_of_month_number)
                assert r.fw_date_previous_month == want
            else:
                assert r.fw_date_previous_month is None
        assert {r.fw_period_number for r in rows if r.fw_week_number == 53} <= {14}


def test_custom_periods_must_start_with_the_week(spark):
    with pytest.raises(ValueError):
        C.custom_periods(spark, [(2016, D(2015, 6, 29), D(2016, 7, 2))])
    periods = C.custom_periods(spark, [(2016, D(2015, 6, 28), D(2016, 7, 2)), (2017, D(2016, 7, 3), D(2017, 7, 1))])
    weeks = C.fiscal_weeks(periods)
    assert weeks.count() == (D(2017, 7, 1) - D(2015, 6, 28)).days + 1


def test_bad_settings(bounds):
    with pytest.raises(ValueError):
        C.fiscal_weeks(C.weekly_periods(bounds), "555")
    with pytest.raises(ValueError):
        C.weekly_periods(bounds, week_rule="Next")
    with pytest.raises(ValueError):
        C.calendar(bounds, kind="Lunar")


def test_fiscal_weeks_join_nothing_and_reach_over_short_years(spark):
    """The year 2021 ends after 40 weeks, 2022 is missing."""
    periods = [(2020, dt.date(2019, 12, 29), dt.date(2021, 1, 2)), (2021, dt.date(2021, 1, 3), dt.date(2021, 10, 9)), (2023, dt.date(2023, 1, 1), dt.date(2023, 12, 30))]
    weeks = C.fiscal_weeks(C.custom_periods(spark, periods), "454")
    assert "Join" not in weeks._jdf.queryExecution().optimizedPlan().toString()
    rows = {r.date: r for r in weeks.collect()}
    spans = {}
    for r in rows.values():
        for level in ("month", "quarter", "year"):
            key = (level, r[f"fw_year_{level}_number"] if level != "year" else r.fw_year_number)
            low, high = spans.get(key, (r.date, r.date))
            spans[key] = (min(low, r.date), max(high, r.date))
    for r in rows.values():
        for level in ("month", "quarter", "year"):
            number = r[f"fw_year_{level}_number"] if level != "year" else r.fw_year_number
            low, high = spans[level, number]
            assert (r[f"fw_start_of_{level}"], r[f"fw_end_of_{level}"]) == (low, high)
            earlier = spans.get((level, number - 1))
            if earlier is None:
                assert r[f"fw_date_previous_{level}"] is None
            elif r.date == high:
                assert r[f"fw_date_previous_{level}"] == earlier[1]
            else:
                assert r[f"fw_date_previous_{level}"] == min(earlier[0] + (r.date - low), earlier[1])
