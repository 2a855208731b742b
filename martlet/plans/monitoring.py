"""Queries over drift monitoring. Runs are days of events; a run's metrics are mean values per event type."""

from __future__ import annotations

from pyspark.sql import functions as F

from martlet.operators import drift as D
from martlet.plans.registry import query, with_
from martlet.plans.tables import RUNS, Tables
from martlet.sources.readers import scan_path
from martlet.sources.writers import append_path

WATCHED = ("click", "purchase", "view", "error")
DIRECTIONS = {"error": False}
THRESHOLD = 0.05
MONITOR = D.Monitor("events", WATCHED, THRESHOLD, run_name="daily_means")

RECENT = """recent AS (SELECT run_id, start_time, row_number() OVER (ORDER BY start_time DESC) AS recency FROM (SELECT DISTINCT run_id, start_time FROM runs))"""
PAIRED = """paired AS (
  SELECT c.metric_name, c.value AS current_value, p.value AS reference_value, c.value - p.value AS drift_score, c.run_id, c.start_time,
         c.dataset_version AS cv, c.dataset_run_id AS cr, p.dataset_version AS pv, p.dataset_run_id AS pr, c.metric_name <> 'error' AS higher_better
  FROM runs c JOIN recent rc ON c.run_id = rc.run_id AND rc.recency = 1 JOIN recent rp ON rp.recency = 2
  JOIN runs p ON p.run_id = rp.run_id AND p.metric_name = c.metric_name WHERE c.metric_name IN ('click', 'purchase', 'view', 'error'))"""
DRIFTS = f"""drifts AS (SELECT *, CASE WHEN abs(drift_score) > 2 * {THRESHOLD}::DOUBLE THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM paired
  WHERE (higher_better AND drift_score <= -{THRESHOLD}::DOUBLE) OR (NOT higher_better AND drift_score >= {THRESHOLD}::DOUBLE))"""
# Alerts of every day, as a table of stored alerts would hold them.
STORED = f"""stored AS (
  SELECT metric_name, start_time AS timestamp, current_value, reference_value, drift_score, 'sudden' AS drift_type,
         CASE WHEN abs(drift_score) > 2 * {THRESHOLD}::DOUBLE THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM (
    SELECT metric_name, start_time, value AS current_value, lag(value) OVER w AS reference_value, value - lag(value) OVER w AS drift_score
    FROM runs WINDOW w AS (PARTITION BY metric_name ORDER BY start_time))
  WHERE CASE WHEN metric_name = 'error' THEN drift_score >= {THRESHOLD}::DOUBLE ELSE drift_score <= -{THRESHOLD}::DOUBLE END)"""
AS_OF = "(SELECT max(start_time) FROM runs)"


def _stored(t: Tables):
    scores = D.with_direction(D.drift_scores(D.metric_history(t.runs())), DIRECTIONS)
    bad = scores.filter(D.is_drift(F.col("drift_score"), F.col("higher_better"), THRESHOLD))
    return bad.withColumns(
        {
            "drift_type": F.lit("sudden"),
            "severity": D.severity(F.col("drift_score"), THRESHOLD),
            "current_dataset_version": F.col("dataset_version"),
            "reference_dataset_version": F.col("dataset_version"),
        }
    )


def _as_of(t: Tables):
    return t.runs().agg(F.to_date(F.max("start_time"))).scalar()


def _rounded(df, *columns: str):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query(
    "D1 S15",
    with_(
        """SELECT r.run_id, metric_name, value, CAST(recency AS INTEGER) AS recency FROM runs r JOIN recent c ON r.run_id = c.run_id WHERE recency <= 4""",
        RUNS,
        RECENT,
    ),
)
def recent_run_metrics(t: Tables):
    recent = D.recent_runs(D.metric_history(t.runs()), "events", 4, "daily_means")
    return recent.select("run_id", "metric_name", "value", "recency")


@query("D2", with_("SELECT run_id, metric_name, metric_name <> 'error' AS higher_better FROM runs", RUNS))
def metric_directions(t: Tables):
    return D.with_direction(D.metric_history(t.runs()), DIRECTIONS).select("run_id", "metric_name", "higher_better")


@query(
    "D3",
    with_(
        """SELECT metric_name, round(drift_score, 6) AS abs_diff, round(drift_score / reference_value, 6) AS rel_change FROM paired""",
        RUNS,
        RECENT,
        PAIRED,
    ),
)
def metric_differences(t: Tables):
    recent = D.recent_runs(D.metric_history(t.runs(), WATCHED), "events", 2)
    paired = recent.groupBy("metric_name").agg(
        F.max(F.when(F.col("recency") == 1, F.col("value"))).alias("current_value"),
        F.max(F.when(F.col("recency") == 2, F.col("value"))).alias("reference_value"),
    )
    return _rounded(D.differences(paired).select("metric_name", "abs_diff", "rel_change"), "abs_diff", "rel_change")


@query(
    "D4 D5",
    with_(
        """SELECT metric_name, current_value, reference_value, round(drift_score, 6) AS drift_score, severity, run_id FROM drifts""",
        RUNS,
        RECENT,
        PAIRED,
        DRIFTS,
    ),
)
def sudden_drift(t: Tables):
    found = D.sudden_drift(D.metric_history(t.runs()), "events", WATCHED, THRESHOLD, directions=DIRECTIONS)
    return _rounded(
        found.select("metric_name", "current_value", "reference_value", "drift_score", "severity", "run_id"), "drift_score"
    )


@query(
    "D6",
    with_(
        """SELECT metric_name, current_value, reference_value, round(drift_score, 6) AS drift_score, 'sudden' AS drift_type, severity,
                  start_time AS timestamp, run_id, 2 AS window_size, 'abs_diff' AS statistical_test, cv AS current_dataset_version,
                  cr AS current_dataset_run_id, pv AS reference_dataset_version, pr AS reference_dataset_run_id, metric_name AS name_in_json
           FROM drifts""",
        RUNS,
        RECENT,
        PAIRED,
        DRIFTS,
    ),
)
def alert_records(t: Tables):
    runs = D.metric_history(t.runs())
    found = D.sudden_drift(runs, "events", WATCHED, THRESHOLD, directions=DIRECTIONS)
    records = D.alerts(found, F.to_timestamp_ntz("run_id", F.lit("yyyyMMdd")))
    named = records.withColumn("name_in_json", F.get_json_object("alert_json", "$.metric_name")).drop("alert_json")
    return _rounded(named, "drift_score")


@query(
    "S6 D6",
    with_(
        """SELECT metric_name, round(drift_score, 6) AS drift_score, severity, start_time AS timestamp, run_id, cv AS current_dataset_version FROM drifts""",
        RUNS,
        RECENT,
        PAIRED,
        DRIFTS,
    ),
)
def alerts_appended(t: Tables):
    found = D.sudden_drift(D.metric_history(t.runs()), "events", WATCHED, THRESHOLD, directions=DIRECTIONS)
    path = t.scratch("alerts")
    append_path(D.alerts(found, F.to_timestamp_ntz("run_id", F.lit("yyyyMMdd"))), path)
    stored = scan_path(t.spark, path)
    return _rounded(
        stored.select("metric_name", "drift_score", "severity", "timestamp", "run_id", "current_dataset_version"), "drift_score"
    )


@query(
    "D7 P11",
    with_(
        f"""SELECT metric_name, timestamp, severity FROM stored WHERE metric_name = 'view' AND drift_type = 'sudden'
            AND timestamp >= {AS_OF} - INTERVAL 14 DAY""",
        RUNS,
        STORED,
    ),
)
def existing_alerts(t: Tables):
    out = D.existing_alerts(_stored(t), "view", "sudden", 14, _as_of(t))
    return out.select("metric_name", "timestamp", "severity")


@query(
    "D8",
    with_(
        f"""SELECT metric_name, timestamp, current_value, reference_value, round(drift_score, 6) AS drift_score, drift_type, severity,
                   strftime(timestamp, '%Y-%m') AS current_dataset_version, strftime(timestamp, '%Y-%m') AS reference_dataset_version
            FROM stored WHERE timestamp >= {AS_OF} - INTERVAL 20 DAY""",
        RUNS,
        STORED,
    ),
)
def metric_trends(t: Tables):
    return _rounded(D.metric_trends(_stored(t), 20, _as_of(t)), "drift_score")


@query(
    "D8",
    with_(f"SELECT timestamp, metric_name FROM stored WHERE timestamp >= {AS_OF} - INTERVAL 30 DAY", RUNS, STORED),
)
def drift_history(t: Tables):
    return D.drift_history(_stored(t), 30, _as_of(t)).select("timestamp", "metric_name")


@query(
    "D9",
    with_("SELECT run_id, metric_name, value, start_time, dataset_version, dataset_run_id FROM runs", RUNS),
)
def metric_history(t: Tables):
    return D.metric_history(t.runs()).select(
        "run_id", "metric_name", "value", "start_time", "dataset_version", "dataset_run_id"
    )


@query(
    "D10 W4",
    with_(
        """SELECT start_time AS timestamp, metric_name, value AS current_value, lag(value) OVER w AS reference_value,
                  round(value - lag(value) OVER w, 6) AS drift_score, run_id
           FROM runs WINDOW w AS (PARTITION BY metric_name ORDER BY start_time) QUALIFY lag(value) OVER w IS NOT NULL""",
        RUNS,
    ),
)
def drift_scores_over_time(t: Tables):
    scores = D.drift_scores(D.metric_history(t.runs()))
    chosen = scores.select("timestamp", "metric_name", "current_value", "reference_value", "drift_score", "run_id")
    return _rounded(chosen, "drift_score")


@query(
    "D13",
    with_(
        r"""SELECT metric_name, 'DriftAlert[' || severity || '] - ' || metric_name || chr(10) || '  Type: sudden' || chr(10) || '  Current: '
              || printf('%.4f', current_value) || ' (vs ' || printf('%.4f', reference_value) || ', '
              || printf('%+.1f', (current_value - reference_value) * 100 / reference_value) || '%)' || chr(10) || '  Score: ' || printf('%.4f', drift_score)
              || chr(10) || '  Dataset: ' || cv || ' (current) vs ' || pv || ' (reference)' || chr(10) || '  Time: ' || strftime(start_time, '%Y-%m-%d %H:%M:%S')
              AS alert_text FROM drifts""",
        RUNS,
        RECENT,
        PAIRED,
        DRIFTS,
    ),
)
def alert_texts(t: Tables):
    runs = D.metric_history(t.runs())
    found = D.sudden_drift(runs, "events", WATCHED, THRESHOLD, directions=DIRECTIONS)
    records = D.alerts(found, F.to_timestamp_ntz("run_id", F.lit("yyyyMMdd")))
    return D.alert_text(records).select("metric_name", "alert_text")


WATCHED_SCORES = """watched AS (
  SELECT start_time AS timestamp, metric_name, value - lag(value) OVER w AS drift_score
  FROM runs WHERE metric_name IN ('click', 'purchase', 'view', 'error')
  WINDOW w AS (PARTITION BY metric_name ORDER BY start_time) QUALIFY lag(value) OVER w IS NOT NULL)"""


@query(
    "D14 D11",
    with_(
        f"""SELECT metric_name, round(avg(drift_score), 4) AS drift_mean, round(stddev(drift_score), 4) AS drift_std,
                   round(max(drift_score), 4) AS drift_max, round(min(drift_score), 4) AS drift_min, 'abs_diff' AS statistical_test,
                   {THRESHOLD}::DOUBLE AS threshold, round(max(drift_score), 4) > {THRESHOLD}::DOUBLE AS above_threshold
            FROM watched GROUP BY 1""",
        RUNS,
        WATCHED_SCORES,
    ),
)
def monitor_summary(t: Tables):
    return MONITOR.summary(D.metric_history(t.runs()))


@query(
    "D14 D12",
    with_(
        "SELECT timestamp, "
        + ", ".join(f"round(max(drift_score) FILTER (WHERE metric_name = '{m}'), 6) AS {m}" for m in WATCHED)
        + " FROM watched GROUP BY 1",
        RUNS,
        WATCHED_SCORES,
    ),
)
def monitor_score_pivot(t: Tables):
    return _rounded(MONITOR.score_pivot(D.metric_history(t.runs())), *WATCHED)


@query(
    "D14 D6",
    with_(
        f"""SELECT metric_name, round(drift_score, 6) AS drift_score, CASE WHEN abs(drift_score) > 2 * {THRESHOLD}::DOUBLE THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
                   start_time AS timestamp, run_id FROM paired WHERE drift_score <= -{THRESHOLD}::DOUBLE""",
        RUNS,
        RECENT,
        PAIRED,
    ),
)
def monitor_check(t: Tables):
    """With the usual directions a rising error mean counts as good."""
    found = MONITOR.check(D.metric_history(t.runs()), F.to_timestamp_ntz("run_id", F.lit("yyyyMMdd")))
    return _rounded(found.select("metric_name", "drift_score", "severity", "timestamp", "run_id"), "drift_score")
