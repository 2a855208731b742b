"""Queries over the calendar: every one spans the years of the orders and carries their sales along."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from martlet.operators import calendar as C
from martlet.operators import holidays as H
from martlet.operators.joins import attach, generate, top_one
from martlet.plans.registry import query, with_
from martlet.plans.tables import Tables

BOUNDS = """bounds AS (SELECT CAST(year(min(o_orderdate)) AS INTEGER) AS y0, CAST(year(max(o_orderdate)) AS INTEGER) AS y1,
                      CAST(max(o_orderdate) AS DATE) AS as_of FROM orders)"""
DAYS = """days AS (SELECT CAST(unnest(generate_series(make_date(y0, 1, 1), make_date(y1, 12, 31), INTERVAL 1 DAY)) AS DATE) AS date
                   FROM bounds)"""
YEARS = "years AS (SELECT CAST(unnest(generate_series(y0, y1)) AS INTEGER) AS year FROM bounds)"
SOLD = "sold AS (SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS orders FROM orders GROUP BY 1)"


def _sold(t: Tables):
    return t.scan("orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.count(F.lit(1)).alias("orders"))


def _with_sold(t: Tables, calendar):
    return attach(calendar, _sold(t)).withColumn("orders", F.coalesce("orders", F.lit(0)))


@query("C1 J14", with_("SELECT date, coalesce(orders, 0) AS orders FROM days LEFT JOIN sold USING (date)", BOUNDS, DAYS, SOLD))
def calendar_days(t: Tables):
    return _with_sold(t, t.calendar()).select("date", "orders")


@query(
    "C2",
    with_(
        """SELECT date, coalesce(orders, 0) AS orders, CAST(strftime(date, '%Y%m%d') AS INTEGER) AS date_key,
                  CAST(day(date) AS INTEGER) AS day_of_month, strftime(date, '%a') AS week_day,
                  CAST(year(date) AS INTEGER) AS year_number, strftime(date, '%Y') AS year,
                  CAST(quarter(date) AS INTEGER) AS quarter_number, 'Q' || quarter(date) || ' ' AS quarter,
                  'Q' || quarter(date) || ' ' || year(date) AS quarter_year, CAST(month(date) AS INTEGER) AS month_number,
                  strftime(date, '%b') AS month, strftime(date, '%b %Y') AS month_year
           FROM days LEFT JOIN sold USING (date)""",
        BOUNDS,
        DAYS,
        SOLD,
    ),
)
def calendar_labels(t: Tables):
    return _with_sold(t, t.calendar()).select(
        "date", "orders", "date_key", "day_of_month", "week_day", "year_number", "year", "quarter_number", "quarter",
        "quarter_year", "month_number", "month", "month_year",
    )


@query(
    "C3 C4 C5",
    with_(
        """, j AS (SELECT date, (SELECT count(*) FROM generate_series(CAST(date_trunc('year', date) AS TIMESTAMP) + INTERVAL 1 DAY, CAST(date AS TIMESTAMP), INTERVAL 1 DAY) g(x)
                                 WHERE dayofweek(x) = 0) + 1 AS week FROM days)
           SELECT date, CAST(dayofweek(date) + 1 AS INTEGER) AS weekday_number, CAST(week AS INTEGER) AS week_number,
                  'W' || lpad(CAST(week AS VARCHAR), 2, '0') AS week, 'W' || lpad(CAST(week AS VARCHAR), 2, '0') || '-' || year(date) AS week_year,
                  CAST(year(date) * 100 + week AS INTEGER) AS week_year_order,
                  CAST(year(date) * 4 - 1 + quarter(date) AS INTEGER) AS year_quarter_number,
                  CAST(year(date) * 12 - 1 + month(date) AS INTEGER) AS year_month_number,
                  CAST(floor(date_diff('day', DATE '1900-12-30', date) / 7) AS INTEGER) AS year_week_number FROM j""",
        BOUNDS,
        DAYS,
    ).replace(") , j AS", "), j AS"),
)
def calendar_sequence_keys(t: Tables):
    return t.calendar().select(
        "date", "weekday_number", "week_number", "week", "week_year", "week_year_order", "year_quarter_number",
        "year_month_number", "year_week_number",
    )


@query(
    "C4 C5",
    with_(
        """SELECT date, CAST(isodow(date) AS INTEGER) AS weekday_number,
                  CAST((SELECT count(*) FROM generate_series(CAST(date_trunc('year', date) AS TIMESTAMP) + INTERVAL 1 DAY, CAST(date AS TIMESTAMP), INTERVAL 1 DAY) g(x)
                   WHERE dayofweek(x) = 1) + 1 AS INTEGER) AS week_number FROM days""",
        BOUNDS,
        DAYS,
    ),
)
def calendar_weeks_from_monday(t: Tables):
    return t.calendar(first_dow=1).select("date", "weekday_number", "week_number")


@query(
    "C7",
    with_(
        """SELECT date, CAST(date_diff('day', DATE '1899-12-30', date)
                  - (SELECT count(*) FROM generate_series(1900, 2100) g(y)
                     WHERE ((y % 4 = 0 AND y % 100 <> 0) OR y % 400 = 0) AND make_date(y, 2, 28) + INTERVAL 1 DAY <= date) AS INTEGER)
                  AS sequential_365_day_number FROM days""",
        BOUNDS,
        DAYS,
    ),
)
def calendar_365_day_number(t: Tables):
    return t.calendar().select("date", "sequential_365_day_number")


@query(
    "C8",
    with_(
        """SELECT date, min(date) OVER m AS start_of_month, max(date) OVER m AS end_of_month, min(date) OVER q AS start_of_quarter,
                  max(date) OVER q AS end_of_quarter, min(date) OVER y AS start_of_year, max(date) OVER y AS end_of_year,
                  CAST(count(*) OVER m AS INTEGER) AS month_days, CAST(count(*) OVER q AS INTEGER) AS quarter_days,
                  CAST(count(*) OVER y AS INTEGER) AS year_days,
                  CAST(date - min(date) OVER m + 1 AS INTEGER) AS day_of_month_number,
                  CAST(date - min(date) OVER q + 1 AS INTEGER) AS day_of_quarter_number,
                  CAST(date - min(date) OVER y + 1 AS INTEGER) AS day_of_year_number
           FROM days WINDOW m AS (PARTITION BY date_trunc('month', date)), q AS (PARTITION BY date_trunc('quarter', date)),
                            y AS (PARTITION BY year(date))""",
        BOUNDS,
        DAYS,
    ),
)
def calendar_period_bounds(t: Tables):
    return t.calendar().select(
        "date", "start_of_month", "end_of_month", "start_of_quarter", "end_of_quarter", "start_of_year", "end_of_year",
        "month_days", "quarter_days", "year_days", "day_of_month_number", "day_of_quarter_number", "day_of_year_number",
    )


def _previous_sql(alias: str, months: int) -> str:
    """Largest earlier date by the stated rule, by brute force."""
    return f"""(SELECT max(b.date) FROM wide b WHERE year(b.date) * 12 + month(b.date) = year(a.date) * 12 + month(a.date) - {months}
                AND (day(b.date) <= day(a.date) OR a.date = last_day(a.date))) AS {alias}"""


@query(
    "C9",
    with_(
        f"""SELECT date, CAST(date - INTERVAL 7 DAY AS DATE) AS date_previous_week, {_previous_sql('date_previous_month', 1)},
                   {_previous_sql('date_previous_quarter', 3)}, {_previous_sql('date_previous_year', 12)} FROM days a""",
        BOUNDS,
        DAYS,
        """wide AS (SELECT CAST(unnest(generate_series(make_date(y0 - 1, 1, 1), make_date(y1, 12, 31), INTERVAL 1 DAY)) AS DATE) AS date
                    FROM bounds)""",
    ),
)
def calendar_previous_dates(t: Tables):
    return t.calendar().select(
        "date", "date_previous_week", "date_previous_month", "date_previous_quarter", "date_previous_year"
    )


@query(
    "C10",
    with_(
        """SELECT date, CAST(date_diff('day', CAST(as_of - dayofweek(as_of) AS DATE), CAST(date - dayofweek(date) AS DATE)) / 7 AS INTEGER) AS relative_week_pos,
                  CAST(date_diff('month', as_of, date) AS INTEGER) AS relative_month_pos,
                  CAST(date_diff('quarter', as_of, date) AS INTEGER) AS relative_quarter_pos,
                  CAST(date_diff('year', as_of, date) AS INTEGER) AS relative_year_pos
           FROM (SELECT date, as_of, CAST(dayofweek(date) AS INTEGER) AS w FROM days, bounds)""",
        BOUNDS,
        DAYS,
    ).replace("as_of - dayofweek(as_of)", "as_of - CAST(dayofweek(as_of) AS INTEGER)").replace("date - dayofweek(date)", "date - w"),
)
def calendar_relative_positions(t: Tables):
    return t.calendar().select(
        "date", "relative_week_pos", "relative_month_pos", "relative_quarter_pos", "relative_year_pos"
    )


# Gauss's rule for Easter with its two exceptions; Spark uses another method.
EASTER = """easter AS (
  SELECT year, CAST(CASE
      WHEN d = 29 AND e = 6 THEN make_date(year, 4, 19)
      WHEN d = 28 AND e = 6 AND (11 * m + 11) % 30 < 19 THEN make_date(year, 4, 18)
      ELSE make_date(year, 3, 22) + CAST(d + e AS INTEGER) END AS DATE) AS easter
  FROM (SELECT year, m, d, (2 * (year % 4) + 4 * (year % 7) + 6 * d + n) % 7 AS e
        FROM (SELECT year, m, n, (19 * (year % 19) + m) % 30 AS d
              FROM (SELECT year, (15 - (13 + 8 * (year // 100)) // 25 + year // 100 - year // 400) % 30 AS m,
                           (4 + year // 100 - year // 400) % 7 AS n FROM years))))"""
PT_HOLIDAYS = """pt AS (
  SELECT date, min_by(name, priority * 1000 + ascii(name)) AS holiday_name FROM (
    SELECT make_date(year, m, d) AS date, name, 100 AS priority FROM years, (VALUES (1, 1, 'New Year''s Day'), (4, 25, 'Freedom Day'),
      (5, 1, 'Labour Day'), (6, 10, 'Portugal Day'), (8, 15, 'Assumption Day'), (10, 5, 'Republic Day'), (11, 1, 'All Saints'' Day'),
      (12, 1, 'Restoration of Independence'), (12, 8, 'Immaculate Conception'), (12, 25, 'Christmas Day')) f(m, d, name)
    UNION ALL SELECT easter - 2, 'Good Friday', 50 FROM easter
    UNION ALL SELECT easter + 60, 'Corpus Christi', 50 FROM easter) GROUP BY date)"""


@query(
    "C6 C20 J14",
    with_(
        """SELECT date, coalesce(orders, 0) AS orders, holiday_name, dayofweek(date) BETWEEN 1 AND 5 AND holiday_name IS NULL AS is_working_day,
                  CASE WHEN dayofweek(date) BETWEEN 1 AND 5 AND holiday_name IS NULL THEN 'Working day' ELSE 'Non-working day' END AS day_type
           FROM days LEFT JOIN pt USING (date) LEFT JOIN sold USING (date)""",
        BOUNDS,
        DAYS,
        YEARS,
        SOLD,
        EASTER,
        PT_HOLIDAYS,
    ),
)
def orders_on_working_days(t: Tables):
    return _with_sold(t, t.calendar()).select("date", "orders", "holiday_name", "is_working_day", "day_type")


def _order_years(t: Tables):
    return t.scan("orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("orders"))


YEARLY = "yearly AS (SELECT year(o_orderdate) AS year, count(*) AS orders FROM orders GROUP BY 1)"


@query(
    "C16",
    with_("SELECT CAST(year AS INTEGER) AS year, orders, easter FROM easter JOIN yearly USING (year)", BOUNDS, YEARS, EASTER, YEARLY),
)
def easter_dates(t: Tables):
    return _order_years(t).withColumn("easter", H.easter(F.col("year")))


@query(
    "C17",
    with_(
        """SELECT CAST(year AS INTEGER) AS year, orders, CAST((SELECT x FROM generate_series(make_timestamp(year, 6, 20, 0, 0, 0.0), make_timestamp(year, 6, 26, 0, 0, 0.0), INTERVAL 1 DAY) g(x)
                 WHERE dayofweek(x) = 6) AS DATE) AS midsummer FROM yearly""",
        YEARLY,
    ),
)
def midsummer_dates(t: Tables):
    return _order_years(t).withColumn("midsummer", H.midsummer(F.col("year")))


@query(
    "C18 C15",
    with_(
        """, us AS (SELECT * FROM (VALUES ('Martin Luther King, Jr.', 1, 1, 3), ('Presidents'' Day', 2, 1, 3), ('Memorial Day', 5, 1, -1),
                        ('Labor Day', 9, 1, 1), ('Columbus Day', 10, 1, 2), ('Thanksgiving Day', 11, 4, 4)) v(holiday_name, m, dow, nth)),
             hits AS (SELECT date, holiday_name, nth, row_number() OVER (PARTITION BY holiday_name, year(date) ORDER BY date) AS up,
                             row_number() OVER (PARTITION BY holiday_name, year(date) ORDER BY date DESC) AS down
                      FROM days JOIN us ON month(date) = m AND dayofweek(date) = dow)
           SELECT date, holiday_name FROM hits WHERE (nth > 0 AND up = nth) OR (nth < 0 AND down = -nth)""",
        BOUNDS,
        DAYS,
    ).replace(") , us AS", "), us AS"),
)
def nth_weekday_holidays(t: Tables):
    rules = H.holiday_rules(t.spark, "US").filter("kind = 'weekday' and offset_days = 0")
    return H.raw_holidays(_order_years(t), rules).select("date", "holiday_name")


@query(
    "C19 J16",
    with_(
        """SELECT CAST(year AS INTEGER) AS year, count(*) AS rules FROM yearly, (VALUES ('a', 0, 0), ('b', 1998, 0), ('c', 0, 1996), ('d', 1997, 1999)) r(n, f, l)
           WHERE (f = 0 OR f <= year) AND (l = 0 OR l >= year) GROUP BY 1""",
        YEARLY,
    ),
)
def rules_in_force_per_year(t: Tables):
    spec = H.literal_table(
        t.spark, [("a", 0, 0), ("b", 1998, 0), ("c", 0, 1996), ("d", 1997, 1999)], "n string, first_year int, last_year int"
    )
    in_force = H.valid_rules(generate(_order_years(t).select("year"), spec))
    return in_force.groupBy("year").agg(F.count(F.lit(1)).alias("rules"))


@query(
    "C21 U4",
    with_(
        """, y AS (SELECT CAST(unnest(generate_series(y0 - 1, y1 + 1)) AS INTEGER) AS year FROM bounds),
             base AS (SELECT date, dayofweek(date) AS w FROM (SELECT make_date(year, 12, 25) AS date FROM y)),
             xmas AS (SELECT date, date + CAST(CASE w WHEN 6 THEN 3 WHEN 0 THEN 2 ELSE 0 END AS INTEGER) AS observed FROM base),
             box AS (SELECT date + 1 AS date, (date + 1) + CAST(CASE w WHEN 5 THEN 2 WHEN 6 THEN 1 ELSE 0 END AS INTEGER) AS observed FROM base),
             ny AS (SELECT make_date(year, 1, 1) AS date, make_date(year, 1, 1) + CAST(CASE dayofweek(make_date(year, 1, 1)) WHEN 6 THEN 2 WHEN 0 THEN 1 ELSE 0 END AS INTEGER) AS observed FROM y),
             all_days AS (SELECT date, 'Christmas Day' AS holiday_name FROM xmas UNION ALL SELECT observed, '(in lieu of Christmas Day)' FROM xmas WHERE observed <> date
                      UNION ALL SELECT date, 'Boxing Day' FROM box UNION ALL SELECT observed, '(in lieu of Boxing Day)' FROM box WHERE observed <> date
                      UNION ALL SELECT date, 'New Year''s Day' FROM ny UNION ALL SELECT observed, '(in lieu of New Year''s Day)' FROM ny WHERE observed <> date)
           SELECT date, holiday_name FROM all_days JOIN bounds ON year(date) BETWEEN y0 AND y1""",
        BOUNDS,
    ).replace(") , y AS", "), y AS"),
)
def substitute_holidays_gb(t: Tables):
    bounds = C.year_bounds_of(t.scan("orders"), "o_orderdate")
    found = H.holidays(C.padded_years(bounds), "GB")
    fixed = found.filter(
        F.col("holiday_name").contains("Christmas")
        | F.col("holiday_name").contains("Boxing")
        | F.col("holiday_name").contains("New Year")
    )
    return fixed.join(_order_years(t), F.year("date") == F.col("year"), "left_semi").select("date", "holiday_name")


@query("C15 C21 U4")
def holidays_of_all_countries(t: Tables):
    found = H.holidays(C.padded_years(C.year_bounds_of(t.scan("orders"), "o_orderdate")), None)
    return attach(found, _sold(t))


@query(
    "C11",
    with_(
        """, f AS (SELECT date, as_of, CAST(date - INTERVAL 6 MONTH AS DATE) AS s FROM (SELECT date, as_of FROM days, bounds)),
             g AS (SELECT date, CAST(year(date) + CASE WHEN month(date) >= 7 THEN 1 ELSE 0 END AS INTEGER) AS fy,
                          CAST(CASE WHEN month(date) >= 7 THEN month(date) - 6 ELSE month(date) + 6 END AS INTEGER) AS fm FROM days)
           SELECT date, coalesce(orders, 0) AS orders, 'F ' || fy AS fiscal_year, fy AS fiscal_year_number,
                  CAST(ceil(fm / 3) AS INTEGER) AS fiscal_quarter_number, 'FQ' || CAST(ceil(fm / 3) AS INTEGER) || ' ' || fy AS fiscal_quarter_year,
                  fm AS fiscal_month_number, CAST(fy * 12 - 1 + fm AS INTEGER) AS fiscal_year_month_number,
                  CAST(date - make_date(fy - 1, 7, 1) + 1 AS INTEGER) AS fiscal_day_of_year_number,
                  make_date(fy - 1, 7, 1) AS fiscal_start_of_year, make_date(fy, 6, 30) AS fiscal_end_of_year,
                  CAST(floor(date_diff('day', DATE '1900-12-30', date) / 7) - floor(date_diff('day', DATE '1900-12-30', make_date(fy - 1, 7, 1)) / 7) + 1 AS INTEGER) AS fiscal_week_number
           FROM g LEFT JOIN sold USING (date)""",
        BOUNDS,
        DAYS,
        SOLD,
    ).replace(") , f AS", "), f AS"),
)
def fiscal_calendar_from_july(t: Tables):
    out = t.calendar(fiscal=True, first_month=7, label_rule=1)
    return _with_sold(t, out).select(
        "date", "orders", "fiscal_year", "fiscal_year_number", "fiscal_quarter_number", "fiscal_quarter_year",
        "fiscal_month_number", "fiscal_year_month_number", "fiscal_day_of_year_number", "fiscal_start_of_year",
        "fiscal_end_of_year", "fiscal_week_number",
    )


def _fiscal_week_sql(pattern: tuple[int, int, int], nearest: bool) -> str:
    """Weekly fiscal years by numbering the Sundays between year starts."""
    a, b, _ = pattern
    start = "CAST(make_date(y, 1, 1) - CAST(dayofweek(make_date(y, 1, 1)) AS INTEGER) AS DATE)"
    if nearest:
        start = f"CAST(CASE WHEN dayofweek(make_date(y, 1, 1)) >= 4 THEN {start} + 7 ELSE {start} END AS DATE)"
    return with_(
        f""", s AS (SELECT y, {start} AS first_day FROM (SELECT CAST(unnest(generate_series(y0, y1 + 1)) AS INTEGER) AS y FROM bounds)),
             p AS (SELECT y, first_day, lead(first_day) OVER (ORDER BY y) - 1 AS last_day FROM s),
             d AS (SELECT y, first_day, last_day, CAST(unnest(generate_series(first_day, last_day, INTERVAL 1 DAY)) AS DATE) AS date
                   FROM p WHERE last_day IS NOT NULL),
             w AS (SELECT *, CAST(date_diff('day', first_day, date) // 7 + 1 AS INTEGER) AS week FROM d),
             q AS (SELECT *, CASE WHEN week > 39 THEN 4 WHEN week > 26 THEN 3 WHEN week > 13 THEN 2 ELSE 1 END AS quarter FROM w),
             m AS (SELECT *, (quarter - 1) * 3 + CASE WHEN week - 13 * (quarter - 1) <= {a} THEN 1
                             WHEN week - 13 * (quarter - 1) <= {a + b} THEN 2 ELSE 3 END AS month FROM q)
           SELECT date, coalesce(orders, 0) AS orders, y AS fw_year_number, first_day AS fw_start_of_year, CAST(last_day AS DATE) AS fw_end_of_year,
                  week AS fw_week_number, CAST(quarter AS INTEGER) AS fw_quarter_number, CAST(month AS INTEGER) AS fw_month_number,
                  CAST(CASE WHEN week = 53 THEN 14 ELSE ceil(week / 4) END AS INTEGER) AS fw_period_number,
                  min(date) OVER (PARTITION BY y, month) AS fw_start_of_month, max(date) OVER (PARTITION BY y, month) AS fw_end_of_month,
                  min(date) OVER (PARTITION BY y, quarter) AS fw_start_of_quarter,
                  CAST(count(*) OVER (PARTITION BY y, quarter) AS INTEGER) AS fw_quarter_days, 'FW W' || lpad(CAST(week AS VARCHAR), 2, '0') AS fw_week
           FROM m LEFT JOIN sold USING (date)""",
        BOUNDS,
        SOLD,
    ).replace(") , s AS", "), s AS")


FW_COLUMNS = [
    "date", "orders", "fw_year_number", "fw_start_of_year", "fw_end_of_year", "fw_week_number", "fw_quarter_number",
    "fw_month_number", "fw_period_number", "fw_start_of_month", "fw_end_of_month", "fw_start_of_quarter",
    "fw_quarter_days", "fw_week",
]


def _fiscal_weeks(t: Tables, pattern: str, week_rule: str):
    bounds = C.year_bounds_of(t.scan("orders"), "o_orderdate")
    weeks = C.fiscal_weeks(C.weekly_periods(bounds, week_rule=week_rule), pattern)
    return _with_sold(t, weeks).select(*FW_COLUMNS)


@query("C12", _fiscal_week_sql((4, 4, 5), nearest=False))
def fiscal_weeks_445_last(t: Tables):
    return _fiscal_weeks(t, "445", "Last")


@query("C12", _fiscal_week_sql((4, 5, 4), nearest=True))
def fiscal_weeks_454_nearest(t: Tables):
    return _fiscal_weeks(t, "454", "Nearest")


CUSTOM = [
    (1996, dt.date(1995, 7, 2), dt.date(1996, 6, 29)),
    (1997, dt.date(1996, 6, 30), dt.date(1997, 6, 28)),
    (1998, dt.date(1997, 6, 29), dt.date(1998, 6, 27)),
]


@query(
    "C13",
    """SELECT CAST(y AS INTEGER) AS fw_year_number, count(o_orderkey) AS orders, count(DISTINCT CAST(o_orderdate AS DATE)) AS days
       FROM (VALUES (1996, DATE '1995-07-02', DATE '1996-06-29'), (1997, DATE '1996-06-30', DATE '1997-06-28'),
                    (1998, DATE '1997-06-29', DATE '1998-06-27')) p(y, a, b)
       LEFT JOIN orders ON CAST(o_orderdate AS DATE) BETWEEN a AND b GROUP BY 1""",
)
def orders_in_custom_periods(t: Tables):
    weeks = C.fiscal_weeks(C.custom_periods(t.spark, CUSTOM))
    joined = attach(weeks, _sold(t))
    return joined.groupBy("fw_year_number").agg(F.sum("orders").alias("orders"), F.count("orders").alias("days"))


@query(
    "C14",
    with_(
        """SELECT kind, count(*) AS days, min(date) AS first_day, max(date) AS last_day FROM (
             SELECT 'Calendar' AS kind, date FROM days
             UNION ALL SELECT 'FiscalGregorian', CAST(unnest(generate_series(make_date(y0 - 1, 7, 1), make_date(y1, 6, 30), INTERVAL 1 DAY)) AS DATE) FROM bounds)
           GROUP BY kind""",
        BOUNDS,
        DAYS,
    ),
)
def calendar_ranges(t: Tables):
    kinds = [t.calendar(kind=k, first_month=7).withColumn("kind", F.lit(k)) for k in ("Calendar", "FiscalGregorian")]
    both = kinds[0].unionByName(kinds[1])
    return both.groupBy("kind").agg(
        F.count(F.lit(1)).alias("days"), F.min("date").alias("first_day"), F.max("date").alias("last_day")
    )


@query("C14 C12", _fiscal_week_sql((4, 4, 5), nearest=False))
def calendar_by_fiscal_weeks(t: Tables):
    return _with_sold(t, t.calendar(kind="FiscalWeekly", fiscal=True)).select(*FW_COLUMNS)


@query(
    "C10 C11",
    with_(
        """, k AS (SELECT date, as_of, year(date + INTERVAL 6 MONTH) AS fy, year(as_of + INTERVAL 6 MONTH) AS cy,
                    CASE WHEN month(date) >= 7 THEN month(date) - 6 ELSE month(date) + 6 END AS fm,
                    CASE WHEN month(as_of) >= 7 THEN month(as_of) - 6 ELSE month(as_of) + 6 END AS cm
                  FROM (SELECT date, as_of FROM days, bounds))
           SELECT date, CAST((fy - cy) * 12 + fm - cm AS INTEGER) AS fiscal_relative_month_pos,
                  CAST((fy - cy) * 4 + ceil(fm / 3) - ceil(cm / 3) AS INTEGER) AS fiscal_relative_quarter_pos,
                  CAST(fy - cy AS INTEGER) AS fiscal_relative_year_pos FROM k""",
        BOUNDS,
        DAYS,
    ).replace(") , k AS", "), k AS"),
)
def fiscal_relative_positions(t: Tables):
    return t.calendar(fiscal=True, first_month=7).select(
        "date", "fiscal_relative_month_pos", "fiscal_relative_quarter_pos", "fiscal_relative_year_pos"
    )


@query(
    "W8 C20",
    with_(
        """SELECT year, min_by(holiday_name, date) AS holiday_name, min(date) AS date FROM
             (SELECT CAST(year(date) AS INTEGER) AS year, date, holiday_name FROM pt) GROUP BY year""",
        BOUNDS,
        YEARS,
        EASTER,
        PT_HOLIDAYS,
    ),
)
def first_holiday_per_year(t: Tables):
    years = _order_years(t)
    settled = H.one_holiday_per_date(H.raw_holidays(years, H.holiday_rules(t.spark, "PT")))
    return top_one(settled, ["year"], F.col("date")).select("year", "holiday_name", "date")
