"""Training, tuning and applying the recommender, and judging its output."""

from __future__ import annotations

import math
import random
from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder, TrainValidationSplit
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from martlet.functions.columns import divide_or_null, percent_of
from martlet.operators.aggregates import popularity_stats
from martlet.operators.topitems import best_by_blocks
from martlet.session import ensure_checkpoint_dir, stable, stored, tidied
from martlet.sources.readers import literal_table

#: Ratings of one factor block, and how many blocks there are at least and at most.
BLOCK_RATINGS, MIN_BLOCKS, MAX_BLOCKS = 2_000_000, 10, 400
#: Pairs that trials side by side may train on together: each trial has shuffles of its own, and a large one keeps all cores busy.
PAIRS_SIDE_BY_SIDE = 20_000_000
#: Every iteration is checkpointed, which is when ALS drops the shuffle files of the iteration before.
DEFAULT_ALS = {"rank": 50, "maxIter": 10, "regParam": 0.1, "alpha": 1.0, "implicitPrefs": True, "seed": 42, "checkpointInterval": 1}
# The ranges searched and the grid tried for ALS.
SEARCH_SPACE = {
    "rank": ("log_int", 5, 200),
    "regParam": ("log", 0.001, 10.0),
    "alpha": ("log", 0.01, 100.0),
    "maxIter": ("int", 5, 30),
}
SEARCH_GRID = {"rank": [5, 10, 15], "regParam": [0.01, 0.1, 0.5], "maxIter": [5, 10]}


def als(nonnegative: bool = False, **params: Any) -> ALS:
    """Implicit-feedback ALS over userId, itemId, rating; unseen users and items are dropped."""
    return ALS(
        userCol="userId",
        itemCol="itemId",
        ratingCol="rating",
        coldStartStrategy="drop",
        nonnegative=nonnegative,
        **{**DEFAULT_ALS, **params},
    )


def fit_als(df: DataFrame, nonnegative: bool = False, **params: Any) -> ALSModel:
    """An ALS model, its factors stored. ``df`` is read twice, so hand in stored pairs."""
    # ALS cuts its own lineage every few iterations once a checkpoint folder is known.
    ensure_checkpoint_dir(df.sparkSession)
    pairs = df.select("userId", "itemId", "rating")
    # Factor blocks are the unit of parallel work; a factor goes to every block that has one of its ratings, and pieces
    # exchanged grow with the square of the blocks. So ratings and cores decide, not the width of shuffles.
    blocks = max(MIN_BLOCKS, pairs.sparkSession.sparkContext.defaultParallelism, -(-pairs.count() // BLOCK_RATINGS))
    model = _detached(als(nonnegative, **params).setNumBlocks(min(blocks, MAX_BLOCKS)).fit(pairs))
    tidied(df.sparkSession)
    return model


def _detached(model: ALSModel) -> ALSModel:
    """``model`` over stored factors: a fitted one holds on to the blocks and the last shuffles of its training."""
    users, items = stable(model.userFactors), stable(model.itemFactors)
    jvm = users.sparkSession.sparkContext._jvm
    made = jvm.org.apache.spark.ml.recommendation.ALSModel(model.uid, model.rank, users._jdf, items._jdf)
    return model._copyValues(ALSModel(model._java_obj.copyValues(made, jvm.org.apache.spark.ml.param.ParamMap.empty())))


def predict(model: ALSModel, df: DataFrame) -> DataFrame:
    return model.transform(df).na.drop(subset=["prediction"])


def recommend(model: ALSModel, k: int = 10, users: DataFrame | None = None) -> DataFrame:
    """Best ``k`` items for all users or for the users of a frame: what ``recommendForAllUsers`` and ``recommendForUserSubset``
    list, by block products that keep ``k`` scores a user and block instead of ``k`` rows a user and 4,096 items."""
    factors = model.userFactors
    if users is not None:
        factors = factors.join(users.select(F.col("userId").alias("id")).distinct(), "id", "left_semi")
    return best_by_blocks(factors, model.itemFactors, k)


def explode_recs(recs: DataFrame) -> DataFrame:
    """(userId, itemId, score, rank) rows of recommendation lists."""
    return recs.select("userId", F.posexplode("recommendations").alias("_pos", "_rec")).select(
        "userId",
        F.col("_rec.itemId").alias("itemId"),
        F.col("_rec.rating").alias("score"),
        (F.col("_pos") + 1).alias("rank"),
    )


def map_ids(recs: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """Original ids for indexes; ``Unknown`` where a mapping has none."""
    joined = recs.join(users, "userId", "left").join(items, "itemId", "left")
    return joined.withColumns(
        {c: F.coalesce(F.col(c).cast("string"), F.lit("Unknown")) for c in ("customer_id", "product_id")}
    )


def stamped_recs(recs: DataFrame, model_name: str, version: int, ts) -> DataFrame:
    """Recommendations in the shape of the result table."""
    return recs.select(
        "customer_id",
        "product_id",
        "score",
        F.lit(ts).alias("recommendation_ts_utc"),
        F.lit(model_name).alias("recommendation_model"),
        F.lit(version).alias("recommendation_model_version"),
    )


def regression_metrics(df: DataFrame, label: str = "rating", prediction: str = "prediction", by: list[str] | None = None) -> DataFrame:
    """RMSE and MAE, overall or per group, in one pass."""
    error = F.col(label) - F.col(prediction)
    return df.groupBy(*(by or [])).agg(
        F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(F.abs(error)).alias("mae"), F.count(error).alias("n")
    )


def cohort_errors(predictions: DataFrame, cohort: DataFrame, key: str = "userId") -> DataFrame:
    """Errors of cold and regular users and their difference, as one row."""
    marked = predictions.join(cohort.select(key, "is_cold"), key, "left").withColumn(
        "is_cold", F.coalesce("is_cold", F.lit(False))
    )
    error = F.col("rating") - F.col("prediction")
    cold, regular = F.col("is_cold"), ~F.col("is_cold")

    def rmse(test):
        return F.sqrt(F.avg(F.when(test, error * error)))

    def mae(test):
        return F.avg(F.when(test, F.abs(error)))

    return marked.agg(
        rmse(cold).alias("cold_rmse"),
        mae(cold).alias("cold_mae"),
        rmse(regular).alias("regular_rmse"),
        mae(regular).alias("regular_mae"),
    ).withColumn("rmse_difference", F.col("cold_rmse") - F.col("regular_rmse"))


def cohort_unique_items(recs: DataFrame, cohort: DataFrame, key: str = "userId") -> DataFrame:
    """Average number of different items recommended to cold and to regular users."""
    per_user = recs.groupBy(key).agg(F.countDistinct("itemId").alias("unique_items"))
    marked = per_user.join(cohort.select(key, "is_cold"), key, "left")
    return marked.groupBy(F.coalesce("is_cold", F.lit(False)).alias("is_cold")).agg(
        F.avg("unique_items").alias("avg_unique_items"), F.count(F.lit(1)).alias("users")
    )


def cold_item_coverage(recs: DataFrame, cohort: DataFrame, key: str = "itemId") -> DataFrame:
    """How many of the cold items are recommended to anyone."""
    cold = cohort.filter("is_cold").select(key)
    hit = recs.select(key).distinct().join(cold, key, "left_semi")
    return cold.agg(F.count(F.lit(1)).alias("cold_items")).select(
        "cold_items",
        hit.agg(F.count(F.lit(1))).scalar().alias("recommended_cold_items"),
    ).withColumn("coverage_percent", F.coalesce(percent_of("recommended_cold_items", "cold_items"), F.lit(0.0)))


def score_uplift(before: DataFrame, after: DataFrame, cohort: DataFrame, key: str = "userId") -> DataFrame:
    """Average score of the cold users under two models and the improvement in percent."""
    cold = cohort.filter("is_cold").select(key)
    new = after.join(cold, key, "left_semi").agg(F.avg("score")).scalar()
    return (
        before.join(cold, key, "left_semi")
        .agg(F.avg("score").alias("score_before"))
        .withColumn("score_after", new)
        .withColumn("improvement_percent", (divide_or_null("score_after", "score_before") - 1) * 100)
    )


def ranking_frame(actual: DataFrame, predicted: DataFrame) -> DataFrame:
    """Per user the items met in the test set and the ordered predictions (userId, actual, predicted).

    Repeated items are kept once: ranking measures look at sets, and a user's list is then no longer than
    the catalog.
    """
    met = actual.groupBy("userId").agg(F.array_sort(F.collect_set(F.col("itemId").cast("double"))).alias("actual"))
    ordered = F.array_sort(F.collect_list(F.struct("rank", F.col("itemId").cast("double").alias("item"))))
    guessed = predicted.groupBy("userId").agg(F.transform(ordered, lambda e: e["item"]).alias("predicted"))
    return met.join(guessed, "userId")


def ranking_metrics(actual: DataFrame, predicted: DataFrame, ks: Iterable[int] = (1, 5, 10)) -> DataFrame:
    """MAP@k and NDCG@k for several k as rows (k, map, ndcg, users).

    ``actual`` has (userId, itemId), ``predicted`` has (userId, itemId, rank). Works on exploded rows: the
    only per-user state is the rank-limited list of predictions.
    """
    ks = sorted(ks)
    met = actual.select("userId", "itemId").distinct()
    sizes = met.groupBy("userId").agg(F.count(F.lit(1)).alias("n_actual"))
    top = predicted.filter(F.col("rank") <= ks[-1]).select("userId", "itemId", "rank")
    hits = top.join(met.withColumn("_hit", F.lit(1)), ["userId", "itemId"], "left").select(
        "userId", "rank", F.coalesce("_hit", F.lit(0)).alias("hit")
    )
    so_far = F.sum("hit").over(
        Window.partitionBy("userId").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    )
    scored = hits.withColumn("precision", F.col("hit") * so_far / F.col("rank")).withColumn(
        "gain", F.col("hit") / F.log(F.col("rank") + 1)
    )
    sums = []
    for k in ks:
        inside = F.col("rank") <= k
        sums += [
            F.sum(F.when(inside, F.col("precision"))).alias(f"_p{k}"),
            F.sum(F.when(inside, F.col("gain"))).alias(f"_g{k}"),
        ]
    per_user = scored.groupBy("userId").agg(*sums).join(sizes, "userId")
    best = {k: [sum(1.0 / math.log(i + 2) for i in range(n)) for n in range(k + 1)] for k in ks}
    rows = [
        F.struct(
            F.lit(k).alias("k"),
            divide_or_null(f"_p{k}", "n_actual").alias("ap"),
            divide_or_null(
                F.col(f"_g{k}"),
                F.element_at(F.array(*[F.lit(x) for x in best[k]]), F.least("n_actual", F.lit(k)).cast("int") + 1),
            ).alias("ndcg"),
        )
        for k in ks
    ]
    return (
        per_user.select(F.inline(F.array(*rows)))
        .groupBy("k")
        .agg(F.avg("ap").alias("map"), F.avg("ndcg").alias("ndcg"), F.count(F.lit(1)).alias("users"))
    )


def diversity(recs: DataFrame, catalog: DataFrame) -> DataFrame:
    """Coverage of the catalog, Gini of item popularity and totals of a recommendation set, as one row."""
    popularity = recs.groupBy("product_id").agg(F.count(F.lit(1)).alias("_n"))
    return popularity_stats(popularity, "_n").select(
        recs.agg(F.countDistinct("customer_id")).scalar().alias("users_with_recommendations"),
        F.col("total").cast("long").alias("total_user_recommendations"),
        percent_of("groups", catalog.agg(F.countDistinct("product_id")).scalar()).alias("catalog_coverage_percent"),
        F.col("gini").alias("recommendation_gini"),
    )


class _Evaluator(RegressionEvaluator):
    """Judges a trial, and lets the driver drop the blocks and shuffles of trials that are over."""

    def _evaluate(self, dataset: DataFrame) -> float:
        tidied(dataset.sparkSession)
        return super()._evaluate(dataset)


def _evaluator(metric: str = "rmse") -> RegressionEvaluator:
    return _Evaluator(metricName=metric, labelCol="rating", predictionCol="prediction")


def _side_by_side(df: DataFrame, parallelism: int) -> int:
    """Trials at once, ``parallelism`` at most."""
    return max(1, min(parallelism, PAIRS_SIDE_BY_SIDE // max(1, df.count())))


def grid_search(
    df: DataFrame,
    grid: Mapping[str, list] = SEARCH_GRID,
    folds: int = 3,
    parallelism: int = 4,
    **params: Any,
) -> tuple[CrossValidatorModel, DataFrame]:
    """Cross-validated grid search by RMSE; returns the model and one row per combination.

    The pairs are stored once: each fold reads them twice, and must meet the same rows in the same order to divide them.
    """
    ensure_checkpoint_dir(df.sparkSession)
    df = stored(df.select("userId", "itemId", "rating"))
    estimator = als(**params)
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(estimator.getParam(name), values)
    maps = builder.build()
    model = CrossValidator(
        estimator=estimator,
        estimatorParamMaps=maps,
        evaluator=_evaluator(),
        numFolds=folds,
        parallelism=_side_by_side(df, parallelism),
        seed=42,
    ).fit(df)
    return model, _trials(df, maps, model.avgMetrics)


def random_configurations(space: Mapping[str, tuple], trials: int, seed: int) -> list[dict[str, Any]]:
    """Seeded draws: uniform integers, log-uniform integers and log-uniform reals."""
    rng = random.Random(seed)

    def draw(kind, low, high):
        if kind == "int":
            return rng.randrange(low, high)
        value = math.exp(rng.uniform(math.log(low), math.log(high)))
        return min(int(value), high - 1) if kind == "log_int" else value

    return [{name: draw(*spec) for name, spec in space.items()} for _ in range(trials)]


def random_search(
    df: DataFrame,
    space: Mapping[str, tuple] = SEARCH_SPACE,
    trials: int = 10,
    seed: int = 42,
    parallelism: int = 4,
    **params: Any,
) -> tuple[Any, DataFrame]:
    """Random search by hold-out RMSE; returns the best model and one row per trial. Pairs are stored as for the grid."""
    ensure_checkpoint_dir(df.sparkSession)
    df = stored(df.select("userId", "itemId", "rating"))
    estimator = als(**params)
    maps = [
        {estimator.getParam(name): value for name, value in config.items()}
        for config in random_configurations(space, trials, seed)
    ]
    model = TrainValidationSplit(
        estimator=estimator,
        estimatorParamMaps=maps,
        evaluator=_evaluator(),
        trainRatio=0.8,
        parallelism=_side_by_side(df, parallelism),
        seed=seed,
    ).fit(df)
    return model, _trials(df, maps, model.validationMetrics)


def _trials(df: DataFrame, maps: list[dict], metrics: list[float]) -> DataFrame:
    """Trial metrics as a table; its size is the number of trials."""
    names = sorted({p.name for m in maps for p in m})
    rows = [
        (i, *[float({p.name: v for p, v in m.items()}[n]) for n in names], float(metric))
        for i, (m, metric) in enumerate(zip(maps, metrics))
    ]
    return literal_table(
        df.sparkSession, rows, "trial int, " + ", ".join(f"{n} double" for n in names) + ", rmse double"
    )
