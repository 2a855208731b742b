from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from martlet.operators import drift as D
from martlet.operators import enrichment as E
from martlet.operators import forecasting as X
from martlet.operators import segments as S


# Lambdas travel with the job; a named function of this module would have to be importable by the workers.
shout = lambda texts: [t.upper() for t in texts]
fail = lambda texts: 1 / 0


def test_greedy_batches_limits():
    sizes = [20_000, 30_000, 1, 50_000, 10]
    batches = [[len(t) for _, t in b] for b in E.greedy_batches((i, "x" * n) for i, n in enumerate(sizes))]
    assert batches == [[20_000], [30_000, 1], [50_000], [10]]
    assert [len(b) for b in E.greedy_batches(((i, "x") for i in range(2000)))] == [900, 900, 200]


def test_batch_by_size_keeps_every_text(frame):
    rows = [(i, "x" * n) for i, n in enumerate([20_000, 30_000, 1, 46_000, 0, 5])] + [(9, "  "), (10, None)]
    df = frame(rows, "id int, text string")
    out = E.batch_by_size(E.texts_to_enrich(df, "id", "text"), "id", "text", partitions=2).collect()
    assert sorted(i for r in out for i in r.ids) == [0, 1, 2, 3, 5]
    assert all(r.n_items <= 900 and (r.n_chars <= 45_000 or r.n_items == 1) for r in out)


def test_batch_by_count_is_full_but_for_the_last(frame):
    out = E.batch_by_count(frame([(i, f"t{i}") for i in range(47)], "id int, text string"), "id", "text", 20)
    sizes = [len(r["items"]) for r in out.orderBy("batch_no").collect()]
    assert sizes == [20, 20, 7]


def test_enrichment_and_errors(frame):
    df = frame([(1, "a"), (1, "b"), (2, " "), (3, None)], "id int, text string")
    good = E.add_enrichment(df, E.enrich(df, "id", "text", shout, "en"), "id", "text")
    assert sorted((r.id, r.en or "") for r in good.collect()) == [(1, "A"), (1, "B"), (2, ""), (3, "")]
    bad = E.enrich(df, "id", "text", fail, "en", retries=1, wait=0.0).collect()
    assert len(bad) == 2 and all(r.en is None and "ZeroDivisionError" in r.en_error for r in bad)


def test_a_run_that_follows_repeats_only_what_failed(spark, frame, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def service(broken):
        def answer(texts):
            calls.add(len(texts))
            if broken & set(texts):
                raise ValueError("busy")
            return [t.upper() for t in texts]

        return answer

    path, once = str(tmp_path / "answers"), {"retries": 0, "wait": 0.0, "max_items": 1}
    df = frame([(1, "a"), (1, "a"), (2, "b"), (None, "c"), (3, "a"), (4, " ")], "id int, text string")
    first = E.enrich_stored(df, "id", "text", service({"b"}), "up", path, waves=3, **once).collect()
    assert {(r.id, r.text): (r.up, r.up_error, r.attempts) for r in first} == {
        (1, "a"): ("A", None, 1), (2, "b"): (None, "ValueError: busy", 1), (None, "c"): ("C", None, 1), (3, "a"): ("A", None, 1)
    }
    assert calls.value == 4
    more = df.union(frame([(5, "d")], "id int, text string"))
    second = E.enrich_stored(more, "id", "text", service(set()), "up", path, **once).collect()
    assert calls.value == 6 and {(r.id, r.up, r.attempts) for r in second} == {(1, "A", 1), (2, "B", 2), (None, "C", 1), (3, "A", 1), (5, "D", 1)}


def test_requests_are_spread_by_bytes(frame):
    df = frame([(i, f"text {i}") for i in range(50)], "id int, text string")
    plan = E.enrich(df, "id", "text", shout, "en")._jdf.queryExecution().optimizedPlan().toString()
    assert "RebalancePartitions" in plan


def test_several_columns_all_survive(frame):
    df = frame([(1, "a", "x"), (2, None, "y")], "id int, t string, m string")
    out = E.enrich_columns(df, "id", ["t", "m"], shout).orderBy("id").collect()
    assert [(r.t_en, r.m_en) for r in out] == [("A", "X"), (None, "Y")]


def test_parse_scores(frame):
    items = [{"id": 1, "text": "a"}, {"id": 2, "text": "b"}]
    schema = "batch_no int, items array<struct<id:int,text:string>>, reply string"
    rows = [(0, items, "[0.5, 1.0]"), (1, items, None), (2, items, " null "), (3, items, "[0.5]"), (4, items, "sorry"), (5, items, "[null]")]
    accepted, rejected = E.parse_scores(frame(rows, schema))
    assert sorted(r.defect_score for r in accepted.collect() if r.defect_score is not None) == [0.5, 1.0]
    assert accepted.count() == 8
    assert sorted(r.batch_no for r in rejected.collect()) == [3, 4]


def test_chat_payload(frame):
    df = frame([(1, 'say "hi"'), (2, "b")], "id int, text string")
    row = E.chat_payload(E.batch_by_count(df, "id", "text"), "sys", "Score these.").first()
    assert [m.role for m in row.messages] == ["system", "user"]
    assert row.messages[1].content == 'Score these. Reviews: ["say \\"hi\\"","b"]'


def test_segment_stage_can_be_saved(frame, tmp_path):
    df = frame([(0, "b"), (0, "a"), (1, "c")], "cluster int, category string")
    stage = S.SegmentTransformer(
        groupCol="cluster", valueCol="category", pluralCol="categories", outputCol="segment",
        template="name {categories_str}", namer="martlet.plans.texts:mark_english",
    )
    Pipeline(stages=[stage]).fit(df).write().overwrite().save(str(tmp_path / "stage"))
    out = PipelineModel.load(str(tmp_path / "stage")).transform(df)
    assert {r.cluster: r.segment for r in out.collect()} == {0: "en:name a, b", 1: "en:name c"}
    mapped = S.segment_map(out, "categories", "category", "segment")
    assert {r.category for r in mapped.collect()} == {"a", "b", "c"}


def test_clusters(frame):
    rng = np.random.default_rng(0)
    rows = [(i, [float(v) for v in rng.normal(size=3) * 0.05 + np.eye(3)[i % 3]]) for i in range(60)]
    _, out = S.cluster(frame(rows, "id int, v array<double>"), "v", k=3)
    groups = {(r.id % 3, r.cluster) for r in out.collect()}
    assert len(groups) == 3


DAYS = [("2018-01-01", 5.0), ("2018-01-01", 1.0), ("2018-01-04", 2.0), ("2018-01-07", 3.0), ("2018-01-08", 4.0), ("2018-02-03", 9.0)]


@pytest.fixture
def series(frame):
    return frame(DAYS, "d string, sales double").select(F.to_date("d").alias("date"), "sales")


def _pairs(df):
    return {r.date: r.sales for r in df.collect()}


def test_resampling(series):
    daily = _pairs(X.resample_day(series))
    assert len(daily) == 34 and daily[dt.date(2018, 1, 1)] == 6.0 and daily[dt.date(2018, 1, 2)] == 0.0
    weekly = _pairs(X.resample_week(series))
    assert weekly[dt.date(2018, 1, 7)] == 11.0 and weekly[dt.date(2018, 1, 14)] == 4.0
    assert max(weekly) == dt.date(2018, 1, 28)  # the week of 4 February is left out
    assert _pairs(X.resample_month(series)) == {dt.date(2018, 1, 31): 15.0, dt.date(2018, 2, 28): 9.0}


def test_resampling_by_key(frame):
    rows = [("a", "2018-01-01", 1.0), ("a", "2018-01-03", 1.0), ("b", "2018-03-01", 2.0)]
    df = frame(rows, "k string, d string, sales double").select("k", F.to_date("d").alias("date"), "sales")
    assert X.resample_day(df, ["k"]).count() == 4


def test_impute_by_skew(frame):
    train = frame([(1.0, 1.0, "x"), (1.0, 2.0, "x"), (1.0, 3.0, "y"), (50.0, 4.0, None), (None, None, "x")], "s double, m double, c string")
    values = X.fit_fill_values(train)
    assert values == {"s": 1.0, "m": 2.5, "c": "x"}
    assert X.impute_by_skew(train, train).filter("s is null or m is null or c is null").count() == 0


def test_mape_skips_zero(frame):
    r = X.mape(frame([(10.0, 9.0), (0.0, 5.0), (20.0, 30.0)], "sales double, predicted_sales double")).first()
    assert r.mape == pytest.approx((0.1 + 0.5) / 2) and r.n == 2


def test_forecast_finds_the_season(spark):
    start = dt.date(2018, 1, 1)
    rows = [("a", start + dt.timedelta(days=i), float(10 + 5 * (i % 7))) for i in range(140)]
    rows += [("b", start + dt.timedelta(days=i), float(100 + i)) for i in range(140)]
    df = spark.createDataFrame(rows, "k string, date date, sales double")
    out = X.forecast(df, "day", 14, ["k"]).collect()
    assert len(out) == 28
    for r in out:
        i = (r.date - start).days
        assert r.predicted_sales == pytest.approx(10 + 5 * (i % 7) if r.k == "a" else 100 + i, rel=1e-6)
    assert X.forecast(df.filter("k = 'a'").drop("k"), "week").columns == ["date", "predicted_sales", "model", "mape"]


def test_future_dates(series):
    got = sorted(r.date for r in X.future_dates(series, 3).collect())
    assert got == [dt.date(2018, 2, d) for d in (4, 5, 6)]


@pytest.fixture
def runs(spark):
    def run(i, metrics, status="Finished", name="als_model_evaluation"):
        at = dt.datetime(2024, 1, i)
        return (f"r{i}", "exp", name, status, at, metrics, {"dataset_version": f"v{i}"})

    rows = [
        run(1, {"rmse": 1.0, "MAP_k1": 0.5}),
        run(2, {"rmse": 1.0, "MAP_k1": 0.5, "zero": 0.0}),
        run(3, {"rmse": 1.3, "MAP_k1": 0.35, "zero": 1.0}),
        run(4, {"rmse": 9.0}, status="Failed"),
        run(5, {"rmse": 9.0}, name="other"),
    ]
    schema = "run_id string, experiment string, run_name string, status string, start_time timestamp_ntz, metrics map<string,double>, tags map<string,string>"
    return D.metric_history(spark.createDataFrame(rows, schema))


def test_recent_runs_skip_unfinished_and_other_names(runs):
    got = {(r.run_id, r.recency) for r in D.recent_runs(runs, "exp", 2, "als_model_evaluation").collect()}
    assert got == {("r3", 1), ("r2", 2)}


def test_sudden_drift_directions_and_severity(runs):
    found = D.sudden_drift(runs, "exp", ["rmse", "MAP_k1", "zero"], 0.1, "als_model_evaluation").collect()
    assert {r.metric_name: r.severity for r in found} == {"rmse": "HIGH", "MAP_k1": "MEDIUM"}
    up = {r.metric_name: r for r in found}["rmse"]
    assert up.drift_score == pytest.approx(0.3) and up.reference_dataset_version == "v2" and up.current_dataset_run_id == "unknown"


def test_alert_records(runs):
    found = D.sudden_drift(runs, "exp", ["rmse"], 0.1, "als_model_evaluation")
    record = D.alerts(found, F.lit(dt.datetime(2024, 2, 1)))
    assert record.columns == [f.name for f in D.ALERT_SCHEMA.fields]
    text = D.alert_text(record).first().alert_text
    assert text.startswith("DriftAlert[HIGH] - rmse") and "(vs 1.0000, +30.0%)" in text


def test_relative_change_of_zero_reference(frame):
    out = D.differences(frame([(1.0, 0.0)], "current_value double, reference_value double")).first()
    assert out.abs_diff == 1.0 and out.rel_change is None


def test_presets():
    assert D.TRAINING_MONITOR.threshold == 0.1 and D.DATASET_MONITOR.threshold == 0.00001
    assert D.INFERENCE_MONITOR.metrics == ("catalog_coverage_percent", "recommendation_gini")


def test_monitor_end_to_end(runs):
    monitor = D.Monitor("exp", ("rmse", "MAP_k1"), 0.1, run_name="als_model_evaluation")
    assert {r.metric_name for r in monitor.check(runs, F.lit(dt.datetime(2024, 2, 1))).collect()} == {"rmse", "MAP_k1"}
    summary = {r.metric_name: r for r in monitor.summary(runs).collect()}
    assert summary["rmse"].drift_max == pytest.approx(0.3) and summary["rmse"].above_threshold
    assert monitor.score_pivot(runs).count() == 2
