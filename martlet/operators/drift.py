"""Monitoring of run metrics: history, comparison of runs, alerts and summaries.

Runs are a long table: run_id, experiment, run_name, status, start_time, metric_name, value,
dataset_version, dataset_run_id.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from martlet.functions.columns import divide_or_null
from martlet.operators.aggregates import drift_summary, pivot_scores
from martlet.operators.projections import since_days

RANKING_METRICS = ("MAP_k1", "MAP_k5", "MAP_k10", "NDCG_k1", "NDCG_k5", "NDCG_k10", "mae", "rmse")

# Metrics for which a rise is bad. Any other metric is better when higher.
LOWER_BETTER = ("mae", "rmse")

_TEXT = T.StringType()
ALERT_SCHEMA = T.StructType(
    [
        T.StructField("metric_name", _TEXT, False),
        T.StructField("current_value", T.DoubleType(), False),
        T.StructField("reference_value", T.DoubleType(), False),
        T.StructField("drift_score", T.DoubleType(), False),
        T.StructField("drift_type", _TEXT, False),
        T.StructField("severity", _TEXT, False),
        T.StructField("timestamp", T.TimestampType(), False),
        T.StructField("run_id", _TEXT, False),
        T.StructField("window_size", T.IntegerType(), False),
        T.StructField("statistical_test", _TEXT, False),
        T.StructField("current_dataset_version", _TEXT, False),
        T.StructField("current_dataset_run_id", _TEXT, False),
        T.StructField("reference_dataset_version", _TEXT, False),
        T.StructField("reference_dataset_run_id", _TEXT, False),
        T.StructField("alert_json", _TEXT, False),
    ]
)


def metric_history(runs: DataFrame, metrics: Sequence[str] | None = None) -> DataFrame:
    """Long form of runs that hold their metrics in a map; missing lineage tags become ``unknown``."""
    tag = lambda name: F.coalesce(F.try_element_at("tags", F.lit(name)), F.lit("unknown"))
    long = runs.select(
        "run_id",
        "experiment",
        "run_name",
        "status",
        "start_time",
        F.explode("metrics").alias("metric_name", "value"),
        tag("dataset_version").alias("dataset_version"),
        tag("dataset_run_id").alias("dataset_run_id"),
    )
    return long.filter(F.col("metric_name").isin(*metrics)) if metrics else long


def finished(runs: DataFrame, experiment: str, run_name: str | None = None) -> DataFrame:
    kept = runs.filter((F.col("experiment") == experiment) & (F.lower("status") == "finished"))
    return kept if run_name is None else kept.filter(F.col("run_name") == run_name)


def recent_runs(runs: DataFrame, experiment: str, n: int, run_name: str | None = None) -> DataFrame:
    """All metric rows of the ``n`` newest finished runs, with the run's place ``recency`` (1 = newest)."""
    kept = finished(runs, experiment, run_name)
    newest = (
        kept.groupBy("run_id").agg(F.max("start_time").alias("_t")).orderBy(F.desc("_t"), F.desc("run_id")).limit(n)
    )
    placed = newest.withColumn("recency", F.row_number().over(Window.orderBy(F.desc("_t"), F.desc("run_id"))))
    return kept.join(placed.select("run_id", "recency"), "run_id")


def with_direction(df: DataFrame, directions: Mapping[str, bool] | None = None) -> DataFrame:
    """Add ``higher_better`` per metric from ``{metric: higher is better}``; unknown metrics count as such."""
    known = dict.fromkeys(LOWER_BETTER, False) if directions is None else dict(directions)
    if not known:
        return df.withColumn("higher_better", F.lit(True))
    pairs = [part for name, flag in known.items() for part in (F.lit(name), F.lit(flag))]
    return df.withColumn(
        "higher_better", F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("metric_name")), F.lit(True))
    )


def differences(df: DataFrame, current: str = "current_value", reference: str = "reference_value") -> DataFrame:
    gap = F.col(current) - F.col(reference)
    return df.withColumns({"abs_diff": gap, "rel_change": divide_or_null(gap, reference)})


def severity(score: Column, threshold: float) -> Column:
    return F.when(F.abs(score) > 2 * threshold, "HIGH").otherwise("MEDIUM")


def is_drift(score: Column, higher_better: Column, threshold: float) -> Column:
    """A change of at least the threshold in the bad direction."""
    return F.when(higher_better, score <= -threshold).otherwise(score >= threshold)


def sudden_drift(
    runs: DataFrame,
    experiment: str,
    metrics: Sequence[str],
    threshold: float,
    run_name: str | None = None,
    directions: Mapping[str, bool] | None = None,
) -> DataFrame:
    """Metrics that got worse from the last but one to the newest run. Both runs must have the metric."""
    two = recent_runs(runs, experiment, 2, run_name).filter(F.col("metric_name").isin(*metrics))

    def of(place: int, column: str) -> Column:
        return F.max(F.when(F.col("recency") == place, F.col(column)))

    paired = two.groupBy("metric_name").agg(
        of(1, "value").alias("current_value"),
        of(2, "value").alias("reference_value"),
        of(1, "run_id").alias("run_id"),
        of(1, "dataset_version").alias("current_dataset_version"),
        of(1, "dataset_run_id").alias("current_dataset_run_id"),
        of(2, "dataset_version").alias("reference_dataset_version"),
        of(2, "dataset_run_id").alias("reference_dataset_run_id"),
    )
    scored = differences(with_direction(paired, directions)).withColumn("drift_score", F.col("abs_diff"))
    bad = scored.filter(is_drift(F.col("drift_score"), F.col("higher_better"), threshold))
    return bad.withColumn("severity", severity(F.col("drift_score"), threshold))


def alerts(drifts: DataFrame, ts: Column, drift_type: str = "sudden", test: str = "abs_diff", window_size: int = 2) -> DataFrame:
    """Alert records with dataset lineage and a JSON copy of themselves."""
    columns = {
        "drift_type": F.lit(drift_type),
        "timestamp": ts,
        "window_size": F.lit(window_size),
        "statistical_test": F.lit(test),
    }
    names = [f.name for f in ALERT_SCHEMA.fields if f.name != "alert_json"]
    record = drifts.withColumns(columns).select(*names)
    return record.withColumn("alert_json", F.to_json(F.struct(*names)))


def existing_alerts(stored: DataFrame, metric: str, drift_type: str, days: int, as_of: Column) -> DataFrame:
    same = stored.filter((F.col("metric_name") == metric) & (F.col("drift_type") == drift_type))
    return since_days(same, "timestamp", days, as_of).orderBy(F.desc("timestamp"))


def drift_history(stored: DataFrame, days: int, as_of: Column) -> DataFrame:
    return since_days(stored, "timestamp", days, as_of).orderBy(F.desc("timestamp"))


def metric_trends(stored: DataFrame, days: int, as_of: Column) -> DataFrame:
    return (
        since_days(stored, "timestamp", days, as_of)
        .select(
            "metric_name",
            "timestamp",
            "current_value",
            "reference_value",
            "drift_score",
            "drift_type",
            "severity",
            "current_dataset_version",
            "reference_dataset_version",
        )
        .orderBy("metric_name", "timestamp")
    )


def drift_scores(history: DataFrame, test: str = "abs_diff") -> DataFrame:
    """Change of every metric from run to run. A metric's runs are few, however large its data.

    ``test`` is ``abs_diff`` (the difference) or ``rel_change`` (the difference by the size of the earlier value, null
    where that is 0).
    """
    if test not in ("abs_diff", "rel_change"):
        raise ValueError(f"unknown test {test}")
    w = Window.partitionBy("metric_name").orderBy("start_time", "run_id")
    compared = history.withColumns(
        {"current_value": F.col("value"), "reference_value": F.lag("value").over(w), "_n": F.row_number().over(w)}
    ).filter("_n > 1")
    difference = F.col("current_value") - F.col("reference_value")
    return compared.select(
        F.col("start_time").alias("timestamp"),
        "metric_name",
        (difference if test == "abs_diff" else F.try_divide(difference, F.abs("reference_value"))).alias("drift_score"),
        F.lit(test).alias("statistical_test"),
        "current_value",
        "reference_value",
        "dataset_version",
        "run_id",
    )


def alert_text(df: DataFrame) -> DataFrame:
    """Readable text per alert."""
    change = divide_or_null((F.col("current_value") - F.col("reference_value")) * 100, "reference_value")
    number = lambda c: F.format_string("%.4f", F.col(c))
    text = F.concat(
        F.lit("DriftAlert["), F.col("severity"), F.lit("] - "), F.col("metric_name"),
        F.lit("\n  Type: "), F.col("drift_type"),
        F.lit("\n  Current: "), number("current_value"),
        F.lit(" (vs "), number("reference_value"),
        F.lit(", "), F.when(change.isNotNull(), F.format_string("%+.1f%%", change)).otherwise("n/a"), F.lit(")"),
        F.lit("\n  Score: "), number("drift_score"),
        F.lit("\n  Dataset: "), F.col("current_dataset_version"),
        F.lit(" (current) vs "), F.col("reference_dataset_version"), F.lit(" (reference)"),
        F.lit("\n  Time: "), F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"),
    )
    return df.withColumn("alert_text", text)


@dataclass(frozen=True)
class Monitor:
    """What to watch in one experiment."""

    experiment: str
    metrics: tuple[str, ...]
    threshold: float
    window_size: int = 4
    run_name: str | None = None
    directions: Mapping[str, bool] | None = None  # metric: whether higher is better; unset as in with_direction

    def check(self, runs: DataFrame, ts: Column) -> DataFrame:
        """Alerts for the newest run."""
        found = sudden_drift(
            runs, self.experiment, self.metrics, self.threshold, self.run_name, directions=self.directions
        )
        return alerts(found, ts)

    def history(self, runs: DataFrame, days: int = 30) -> DataFrame:
        """Metric rows of all finished runs within ``days`` days before the newest one."""
        own = finished(runs, self.experiment, self.run_name)
        newest = own.agg(F.max("start_time").alias("_newest"))
        recent = own.join(newest, F.col("start_time") >= F.col("_newest") - F.expr(f"INTERVAL {int(days)} DAYS")).drop("_newest")
        return recent.filter(F.col("metric_name").isin(*self.metrics))

    def summary(self, runs: DataFrame, days: int = 30) -> DataFrame:
        return drift_summary(drift_scores(self.history(runs, days)), self.threshold)

    def score_pivot(self, runs: DataFrame, days: int = 30) -> DataFrame:
        return pivot_scores(drift_scores(self.history(runs, days)), list(self.metrics))


# The three monitors in use.
DATASET_MONITOR = Monitor(
    "Product_RecSys_Datasets", ("avg_interactions_per_user", "avg_interactions_per_item"), 0.00001
)
TRAINING_MONITOR = Monitor("Product_RecSys_Training", RANKING_METRICS, 0.1, run_name="als_model_evaluation")
INFERENCE_MONITOR = Monitor(
    "Product_RecSys_Inference", ("catalog_coverage_percent", "recommendation_gini"), 0.01
)
