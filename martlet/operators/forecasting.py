"""Resampling and forecasting of sales series, one or many at a time.

A series is a key (possibly none) with at most one row per calendar step, so the rows of one key are
bounded by the calendar. Keys are what gets distributed.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from martlet.functions.columns import date_key, divide_or_null, sample_skewness, week_end_sunday
from martlet.operators.aggregates import exact_quantiles
from martlet.operators.ordering import global_forward_fill
from martlet.operators.projections import exclude_month, where_between, where_eq
from martlet.operators.windows import fill

HORIZONS = {"day": 31, "week": 4, "month": 1}
SEASONS = {"day": 7, "week": 52, "month": 12}


def sales_series(
    fact: DataFrame,
    ts: str,
    status: str,
    low: dt.date | None = None,
    high: dt.date | None = None,
    incomplete: tuple[int, int] | None = None,
    price: str = "price",
    keys: Sequence[str] = (),
) -> DataFrame:
    """Sales rows (keys, date, sales) of orders with one status, cut to a window or freed of a month."""
    rows = where_eq(fact, "order_status", status)
    if low is not None and high is not None:
        rows = where_between(rows, ts, low, high)
    if incomplete is not None:
        rows = exclude_month(rows, ts, *incomplete, min_year=low.year if low and not high else None)
    return rows.select(*keys, F.to_date(ts).alias("date"), F.col(price).alias("sales"))


def _label(freq: str) -> Column:
    return {"day": F.col("date"), "week": week_end_sunday("date"), "month": F.last_day("date")}[freq]


def _gap(freq: str, following: Column) -> Column:
    """Labels from a row's own date up to the step before ``following``."""
    date = F.col("date")
    if freq == "month":
        last = F.coalesce(F.add_months(F.trunc(following, "month"), -1), F.trunc(date, "month"))
        months = F.sequence(F.trunc(date, "month"), last, F.expr("interval 1 month"))
        return F.transform(months, lambda m: F.last_day(m))
    days = {"day": 1, "week": 7}[freq]
    return F.sequence(date, F.coalesce(F.date_sub(following, days), date), F.expr(f"interval {days} days"))


def resample(df: DataFrame, freq: str, keys: Sequence[str] = (), value: str = "sales") -> DataFrame:
    """Sum per day, week (labelled by its Sunday) or month (labelled by its end); empty steps are 0.

    Every row is followed by the empty steps up to the next one, so the rows are read once and never joined
    to a list of dates. The window sees one series at a time, already summed per step.
    """
    summed = df.groupBy(*keys, _label(freq).alias("date")).agg(F.sum(value).alias(value))
    following = F.lead("date").over(Window.partitionBy(*keys).orderBy("date"))
    spread = summed.withColumn("_next", following).select(
        *keys, value, F.posexplode(_gap(freq, F.col("_next"))).alias("_pos", "date")
    )
    own = F.when(F.col("_pos") == 0, F.coalesce(value, F.lit(0.0))).otherwise(0.0)
    return spread.select(*keys, "date", own.alias(value))


def resample_day(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return resample(df, "day", keys)


def resample_week(df: DataFrame, keys: Sequence[str] = (), drop_last: bool = True) -> DataFrame:
    """Weekly sums; the last week is incomplete and left out."""
    weekly = resample(df, "week", keys)
    if not drop_last:
        return weekly
    last = F.max("date").over(Window.partitionBy(*keys))  # a series at a time
    return weekly.withColumn("_last", last).filter(F.col("date") < F.col("_last")).drop("_last")


def resample_month(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return resample(df, "month", keys)


def fill_then_resample(df: DataFrame, keys: Sequence[str] = (), value: str = "sales") -> DataFrame:
    """Fill missing values from the next, then the previous row, and only then sum per day.

    ``df`` must already be one row per key and date. Without a key the series is a single, calendar-sized one.
    """
    return resample(fill(df, list(keys), "date", value), "day", keys, value)


def holdout(df: DataFrame, horizon: int, keys: Sequence[str] = ()) -> DataFrame:
    """Mark the last ``horizon`` rows of each series as test (column ``split``)."""
    newest = Window.partitionBy(*keys).orderBy(F.desc("date"))
    return df.withColumn("split", F.when(F.row_number().over(newest) <= horizon, "test").otherwise("train"))


def holdout_share(df: DataFrame, share: float = 0.2) -> DataFrame:
    """The same with ``int(n * share)`` test rows of a single series."""
    # One calendar-sized series.
    horizon = F.floor(F.count(F.lit(1)).over(Window.partitionBy()) * share)
    newest = Window.orderBy(F.desc("date"))
    return df.withColumn("split", F.when(F.row_number().over(newest) <= horizon, "test").otherwise("train"))


def fit_fill_values(train: DataFrame, columns: Sequence[str] | None = None) -> dict[str, object]:
    """Fill value per column: the mean for numbers of skew up to 1, the median above, the mode otherwise."""
    fields = [f for f in train.schema.fields if columns is None or f.name in columns]
    numbers = [f.name for f in fields if isinstance(f.dataType, T.NumericType)]
    others = [f.name for f in fields if isinstance(f.dataType, (T.StringType, T.BooleanType))]
    values: dict[str, object] = {}
    if numbers:
        facts = train.agg(
            *[sample_skewness(F.col(c).cast("double")).alias(f"skew_{c}") for c in numbers],
            *[F.avg(c).alias(f"mean_{c}") for c in numbers],
        ).first()
        for c in numbers:
            skew = facts[f"skew_{c}"]
            if skew is not None and skew > 1:
                values[c] = exact_quantiles(train, c, [0.5]).first()["q0"]
            else:
                values[c] = facts[f"mean_{c}"]
    for c in others:
        top = train.filter(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).first()
        values[c] = top[c] if top else None
    return values


_DATES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def impute_by_skew(train: DataFrame, df: DataFrame, columns: Sequence[str] | None = None, order: Sequence[Column | str] = ()) -> DataFrame:
    """Fill ``df`` with values learnt on ``train``; columns without any known value are left alone.

    Dates and times take the last known value before them in the ``order`` of rows (any number of rows, no single-task
    window), and where there is none the most frequent one of ``train``; without an order they are left alone.
    """
    dates = [f.name for f in df.schema.fields if isinstance(f.dataType, _DATES) and (columns is None or f.name in columns)] if order else []
    learnt = None if columns is None else [c for c in columns if c not in dates]
    known = {c: F.lit(v) for c, v in fit_fill_values(train, learnt).items() if v is not None}
    if dates:
        df = global_forward_fill(df, dates, *order)
        known |= {c: train.filter(F.col(c).isNotNull()).groupBy(c).count().agg(F.max_by(c, F.struct("count", -F.unix_seconds(F.col(c).cast("timestamp"))))).scalar() for c in dates}
    return df.withColumns({c: F.coalesce(F.col(c), v) for c, v in known.items()}) if known else df


def forward_fill_dates(df: DataFrame, order: str, column: str, keys: Sequence[str] = ()) -> DataFrame:
    return fill(df, list(keys), order, column, "forward")


def mape(df: DataFrame, actual: str = "sales", predicted: str = "predicted_sales", by: Sequence[str] = ()) -> DataFrame:
    """Mean absolute percentage error; rows with an actual of 0 are skipped."""
    error = F.abs(divide_or_null(F.col(actual) - F.col(predicted), F.col(actual)))
    return df.groupBy(*by).agg(F.avg(error).alias("mape"), F.count(error).alias("n"))


def seasonal_naive(df: DataFrame, season: int, keys: Sequence[str] = ()) -> DataFrame:
    """Each step predicted by the value one season earlier."""
    w = Window.partitionBy(*keys).orderBy("date")
    return df.withColumn("predicted_sales", F.lag("sales", season).over(w))


# -- automatic forecast: small linear models, all series of one length at a time -------------------------
#
# A model takes a matrix (series, steps), the number of steps ahead and the season, and gives (series, steps ahead), or
# nothing where series of that length are too short for it.

#: Numbers in the windows of the series that are handled together.
WINDOW_CELLS = 4_000_000
#: Added to normal equations of series between -1 and 1, so that flat series have a solution: the shortest one.
RIDGE = 1e-9


def _naive(y: np.ndarray, h: int, season: int) -> np.ndarray | None:
    """The last season over and over."""
    if y.shape[1] < season:
        return None
    return y[:, -season + np.arange(h) % season]


def _last(y: np.ndarray, h: int, season: int) -> np.ndarray | None:
    return np.repeat(y[:, -1:], h, axis=1) if y.shape[1] else None


def _average(y: np.ndarray, h: int, season: int) -> np.ndarray | None:
    return np.repeat(y[:, -season:].mean(1, keepdims=True), h, axis=1) if y.shape[1] else None


def _on_time(y: np.ndarray, h: int, season: int | None) -> np.ndarray:
    """Least squares on time and, with a season, the place in it. The design is the same for all series of a length, so one
    pseudo-inverse serves them all."""
    steps = y.shape[1]
    t = np.arange(steps + h)
    columns = [np.ones(len(t)), t / max(steps, 1)]
    columns += [(t % season == s).astype(float) for s in range(1, season or 1)]
    x = np.stack(columns, axis=1)
    return y @ np.linalg.pinv(x[:steps]).T @ x[steps:].T


def _trend(y: np.ndarray, h: int, season: int) -> np.ndarray | None:
    return _on_time(y, h, None) if y.shape[1] >= 2 else None


def _trend_season(y: np.ndarray, h: int, season: int) -> np.ndarray | None:
    return _on_time(y, h, season) if 1 < season and y.shape[1] >= 2 * season else None


def _autoregression(y: np.ndarray, h: int, season: int) -> np.ndarray | None:
    """Least squares on the last season of lags, applied step by step. Normal equations are summed over the windows of each
    series and solved for many series at once."""
    lags = max(2, season)
    if y.shape[1] < 3 * lags:
        return None
    out = np.empty((len(y), h))
    some = max(1, WINDOW_CELLS // ((y.shape[1] - lags) * (lags + 2)))
    for start in range(0, len(y), some):
        part = y[start : start + some]
        scale = np.maximum(np.abs(part).max(1, keepdims=True), 1e-300)
        part = part / scale
        windows = np.lib.stride_tricks.sliding_window_view(part, lags + 1, axis=1)
        x = np.concatenate([windows[..., :lags], np.ones((*windows.shape[:2], 1))], axis=2)
        turned = x.transpose(0, 2, 1)
        coef = np.linalg.solve(turned @ x + RIDGE * np.eye(lags + 1), turned @ windows[..., lags:])[..., 0]
        recent = part[:, -lags:]
        for step in range(h):
            ahead = (recent * coef[:, :-1]).sum(1) + coef[:, -1]
            out[start : start + some, step] = ahead * scale[:, 0]
            recent = np.concatenate([recent[:, 1:], ahead[:, None]], axis=1)
    return out


CANDIDATES = {
    "seasonal_naive": _naive,
    "last_value": _last,
    "moving_average": _average,
    "trend": _trend,
    "trend_season": _trend_season,
    "autoregression": _autoregression,
}


def _errors(actual: np.ndarray, predicted: np.ndarray) -> np.ndarray:
    """Mean absolute percentage error of each series; infinite where no actual differs from 0."""
    known = actual != 0
    share = np.where(known, np.abs(np.where(known, actual - predicted, 0.0) / np.where(known, actual, 1.0)), 0.0)
    count = known.sum(1)
    return np.where(count > 0, share.sum(1) / np.maximum(count, 1), np.inf)


def fit_length(y: np.ndarray, horizon: int, season: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(forecasts, number of the chosen candidate, its error) of series of one length, the rows of ``y``.

    Candidates are compared on the last ``horizon`` steps; those that the shorter series does not allow are out. The first
    one wins ties, and series too short to hold anything out take the last value.
    """
    models = list(CANDIDATES.values())
    held = y.shape[1] > horizon
    errors = np.full((len(y), len(models)), np.inf)
    possible = np.zeros(len(models), bool)
    if held:
        for i, model in enumerate(models):
            guess = model(y[:, :-horizon], horizon, season)
            if guess is not None:
                possible[i], errors[:, i] = True, _errors(y[:, -horizon:], guess)
    order = np.where(possible, errors, np.nan)
    last = list(CANDIDATES).index("last_value")
    best = np.nanargmin(order, axis=1) if possible.any() else np.full(len(y), last)
    out = np.empty((len(y), horizon))
    for i in np.unique(best):
        own = best == i
        out[own] = models[i](y[own], horizon, season)
    return out, best, errors[np.arange(len(y)), best]


def _fitter(horizon: int, season: int):
    """Vectorised over series: every element of the input is one series of at most calendar length."""
    names = list(CANDIDATES)

    @F.pandas_udf("predicted array<double>, model string, mape double")
    def fit(series: pd.Series) -> pd.DataFrame:
        lengths = series.map(len).to_numpy()
        out = pd.DataFrame({"predicted": [None] * len(series), "model": None, "mape": None})
        for length in np.unique(lengths):
            at = np.flatnonzero(lengths == length)
            predicted, best, error = fit_length(np.stack(series.iloc[at].to_list()).astype(float), horizon, season)
            out.loc[at, "predicted"] = pd.Series(list(predicted), index=at)
            out.loc[at, "model"] = [names[i] for i in best]
            out.loc[at, "mape"] = [e if np.isfinite(e) else None for e in error]
        return out

    return fit


def forecast(
    series: DataFrame,
    freq: str = "day",
    horizon: int | None = None,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Forecast every resampled series ``horizon`` steps ahead: (keys, date, predicted_sales, model, mape).

    The candidate with the smallest error on the last ``horizon`` known steps is fitted on everything. Each
    series becomes one array in Spark, so Python sees batches of many series, and fits those of one length together.
    """
    horizon = horizon or HORIZONS[freq]
    step = F.struct("date", F.col("sales").cast("double").alias("sales"))
    packed = series.groupBy(*keys).agg(F.array_sort(F.collect_list(step)).alias("_steps"))
    fitted = packed.select(
        *keys,
        F.element_at("_steps", -1)["date"].alias("_last"),
        _fitter(horizon, SEASONS[freq])(F.transform("_steps", lambda e: e["sales"])).alias("_fit"),
    )
    ahead = F.col("_pos") + 1
    date = {
        "day": F.date_add("_last", ahead),
        "week": F.date_add("_last", ahead * 7),
        "month": F.last_day(F.add_months("_last", ahead)),
    }[freq]
    return fitted.select(
        *keys, "_last", F.posexplode("_fit.predicted").alias("_pos", "predicted_sales"), "_fit.model", "_fit.mape"
    ).select(*keys, date.alias("date"), "predicted_sales", "model", "mape")


def forecast_rows(predictions: DataFrame, prediction_ts) -> DataFrame:
    """Predictions in the shape of the result table."""
    return predictions.select(
        "date", "predicted_sales", F.lit(prediction_ts).alias("prediction_ts"), date_key("date").alias("datekey")
    )


def future_dates(df: DataFrame, horizon: int, keys: Sequence[str] = ()) -> DataFrame:
    """The ``horizon`` days after the last known one of each series."""
    last = df.groupBy(*keys).agg(F.max("date").alias("_last"))
    days = F.sequence(F.date_add("_last", 1), F.date_add("_last", horizon), F.expr("interval 1 day"))
    return last.select(*keys, F.explode(days).alias("date"))


def compare(actual: DataFrame, predicted: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Actual and predicted values side by side; dates known to one side only are kept."""
    return actual.join(predicted, [*keys, "date"], "full")
