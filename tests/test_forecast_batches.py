"""Models fitted for all series of one length at once, against each series by itself; dates carried over partitions."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from martlet.operators import forecasting as X
from martlet.operators.ordering import global_forward_fill


def alone(name, y, h, season):
    """The same model of one series by plain least squares."""
    if name == "last_value":
        return np.full(h, y[-1])
    if name == "moving_average":
        return np.full(h, y[-season:].mean())
    if name == "seasonal_naive":
        return np.array([y[len(y) - season + i % season] for i in range(h)]) if len(y) >= season else None
    if name in ("trend", "trend_season"):
        if len(y) < 2 or (name == "trend_season" and len(y) < 2 * season):
            return None
        t = np.arange(len(y) + h)
        x = [np.ones(len(t)), t / len(y)] + [(t % season == s).astype(float) for s in range(1, season if name == "trend_season" else 1)]
        x = np.stack(x, 1)
        return x[len(y) :] @ np.linalg.lstsq(x[: len(y)], y, rcond=None)[0]
    lags = max(2, season)
    if len(y) < 3 * lags:
        return None
    x = np.array([[*y[i : i + lags], 1.0] for i in range(len(y) - lags)])
    coef, out = np.linalg.lstsq(x, y[lags:], rcond=None)[0], list(y)
    for _ in range(h):
        out.append(float(np.dot(out[-lags:], coef[:-1]) + coef[-1]))
    return np.array(out[len(y) :])


@pytest.mark.parametrize("season, length, h", [(7, 60, 10), (4, 13, 3), (12, 80, 1), (52, 40, 4), (7, 3, 2), (2, 1, 1)])
def test_every_model_equals_the_loop(season, length, h, monkeypatch):
    monkeypatch.setattr(X, "WINDOW_CELLS", 2000)  # several parts
    rng = np.random.default_rng(season)
    y = 50 + rng.normal(size=(17, length)) * 10 + 5 * np.sin(np.arange(length) * 2 * np.pi / season)
    for name, model in X.CANDIDATES.items():
        got = model(y, h, season)
        if got is None:
            assert alone(name, y[0], h, season) is None or name == "autoregression"
            continue
        np.testing.assert_allclose(got, np.stack([alone(name, row, h, season) for row in y]), rtol=1e-5, atol=1e-6)


def test_lags_reach_a_whole_season():
    """A pattern of 20 steps needs 20 lags; nothing is cut at a smaller number."""
    pattern = np.random.default_rng(1).normal(size=20) + 10
    y = np.tile(pattern, 6)[None]
    np.testing.assert_allclose(X._autoregression(y, 20, 20)[0], pattern, rtol=1e-6)


def test_the_choice_is_the_smallest_error_and_the_first_on_ties(spark, frame):
    day = dt.date(2020, 1, 1)
    rows = [(k, day + dt.timedelta(days=i), float(v)) for k, values in {"flat": [5] * 40, "line": range(1, 41), "one": [3], "zero": [0] * 12}.items() for i, v in enumerate(values)]
    got = {}
    for r in X.forecast(frame(rows, "k string, date date, sales double"), "day", 3, ["k"]).collect():
        got.setdefault(r.k, []).append(r)
    assert {k: v[0].model for k, v in got.items()} == {"flat": "seasonal_naive", "line": "trend", "one": "last_value", "zero": "seasonal_naive"}
    assert [round(r.predicted_sales, 6) for r in sorted(got["line"], key=lambda r: r.date)] == [41.0, 42.0, 43.0]
    assert got["one"][0].mape is None and got["zero"][0].mape is None and [r.predicted_sales for r in got["one"]] == [3.0] * 3
    assert max(r.date for r in got["one"]) == day + dt.timedelta(days=3)


def test_values_are_carried_over_partitions(spark):
    rows = spark.range(4000).select("id", F.when((F.col("id") % 97 == 5) | (F.col("id") == 3000), F.col("id")).alias("x"), F.when(F.col("id") == 10, F.lit("a")).alias("y"), F.lit(1).alias("z"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = global_forward_fill(rows.repartition(11), ["x", "y"], "id")
        assert out.select(F.spark_partition_id()).distinct().count() > 1
        got = {r.id: (r.x, r.y, r.z) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    last = None
    for i in range(4000):
        last = i if i % 97 == 5 or i == 3000 else last
        assert got[i] == (last, "a" if i >= 10 else None, 1)


def test_dates_are_part_of_imputation(frame):
    d = dt.date
    rows = [(1, None, 1.0), (2, d(2020, 1, 5), None), (3, None, 3.0), (4, d(2020, 1, 1), None), (5, d(2020, 1, 1), 2.0), (6, None, 2.0)]
    df = frame(rows, "id int, day date, x double")
    got = {r.id: (r.day, r.x) for r in X.impute_by_skew(df, df, order=["id"]).collect()}
    assert [got[i][0] for i in range(1, 7)] == [d(2020, 1, 1), d(2020, 1, 5), d(2020, 1, 5), d(2020, 1, 1), d(2020, 1, 1), d(2020, 1, 1)]
    assert got[2][1] == 2.0
    untouched = {r.id: r.day for r in X.impute_by_skew(df, df).collect()}
    assert untouched[1] is None and untouched[3] is None
