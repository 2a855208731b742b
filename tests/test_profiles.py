"""Profiles by merging states, against the whole."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from martlet.operators import profiles as P
from martlet.plans.catalog import QUERIES

SCHEMA = "day int, x double, n long, kind string, flag boolean, `a b` int"


@pytest.fixture
def rows(frame):
    rng = random.Random(1)
    made = [(i % 6, rng.gauss(1e6, 3) if i % 11 else None, rng.randrange(3000), rng.choice("abcde") if i % 5 else None, i % 2 == 0, i) for i in range(8000)]
    return frame(made + [(6, float("nan"), 1, "z", None, 5), (7, None, None, None, None, None), (None, float("inf"), 2, "a", True, 1)], SCHEMA)


def read(df):
    return {r["column"]: r for r in P.read_states(df).collect()}


def test_merged_states_equal_the_whole(rows):
    whole = read(P.profile_states(rows, columns=["x", "n", "kind", "flag", "a b"]))
    merged = read(P.merge_states(P.profile_states(rows, ["day"])))
    assert set(whole) == set(merged) == {"x", "n", "kind", "flag", "a b"}
    for c, w in whole.items():
        m = merged[c]
        assert (m.rows, m.nulls, m.min_number, m.min_text, m.max_text) == (w.rows, w.nulls, w.min_number, w.min_text, w.max_text)
        if w.mean is not None:
            assert m.mean == pytest.approx(w.mean, rel=1e-12) and m.stddev == pytest.approx(w.stddev, rel=1e-6)
        exact = rows.agg(F.countDistinct(F.col(f"`{c}`"))).first()[0]
        assert m.distinct_low <= exact <= m.distinct_high and w.distinct_low <= exact <= w.distinct_high


def test_quantiles_keep_their_rank(rows):
    merged = read(P.merge_states(P.profile_states(rows, ["day"])))
    values = sorted(r.n for r in rows.select("n").collect() if r.n is not None)
    for p, q in zip((0.05, 0.25, 0.5, 0.75, 0.95), merged["n"].quantiles):
        under, upto = sum(v < q for v in values) / len(values), sum(v <= q for v in values) / len(values)
        assert under - P.RANK_ERROR <= p <= upto + P.RANK_ERROR


def test_days_merge_in_steps_without_old_rows(rows, tmp_path):
    path = str(tmp_path / "states")
    for day in range(6):
        P.profile_states(rows.filter(F.col("day") == day), ["day"]).write.mode("append").parquet(path)
    stored = rows.sparkSession.read.parquet(path)
    halves = P.merge_states(stored.withColumn("half", F.col("day") % 2), ["half"])
    twice, once = read(P.merge_states(halves)), read(P.merge_states(stored))
    for c in once:
        assert twice[c].rows == once[c].rows and twice[c].min_text == once[c].min_text
        assert twice[c].stddev == pytest.approx(once[c].stddev, rel=1e-9) if once[c].stddev else True


def test_parts_without_values(rows, frame):
    parts = {r.day: r for r in P.read_states(P.profile_states(rows, ["day"], ["x"])).collect()}
    assert (parts[7].rows, parts[7].nulls, parts[7].distinct, parts[7].mean, parts[7].quantiles) == (1, 1, 0, None, None)
    assert parts[6].mean is None and parts[None].max_number == float("inf")
    empty = read(P.profile_states(frame([], SCHEMA)))
    assert empty["n"].rows == 0 and empty["n"].distinct == 0 and empty["n"].quantiles is None


def test_the_merged_profile_is_checked_without_multiplying_rows(spark):
    plan = QUERIES["column_profile_merged"].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    # Exact counts and ranks used to make a row per row and column, and a map in each.
    assert "Expand" not in plan and "map_from_arrays" not in plan
