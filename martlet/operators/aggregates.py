"""Aggregations of the exploratory, dataset and serving jobs.

Everything is a grouped aggregate with map-side partial results. Statistics that need an order over all
rows (quantiles, Gini, Pareto) first collapse equal values, then work on positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from martlet.functions.columns import divide_or_null, percent_of
from martlet.operators.ordering import global_running_sum, null_safe_join, rank_within


def key_stats(df: DataFrame, keys: dict[str, str], per: str) -> DataFrame:
    """Row count, distinct count per key ``{alias: column}`` and average rows per distinct ``per`` column."""
    counted = df.agg(
        F.count(F.lit(1)).alias("total_rows"), *[F.countDistinct(c).alias(alias) for alias, c in keys.items()]
    )
    alias_of_per = next(alias for alias, c in keys.items() if c == per)
    return counted.withColumn("avg_rows_per_key", divide_or_null("total_rows", alias_of_per))


def freq(df: DataFrame, column: str) -> DataFrame:
    """Count per value, most frequent first (ties by value)."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), column)


def distinct_per(df: DataFrame, by: str, column: str, name: str = "distinct_count") -> DataFrame:
    return df.groupBy(by).agg(F.countDistinct(column).alias(name))


def singleton_share(df: DataFrame, by: str, column: str | None = None) -> DataFrame:
    """Percent of groups with exactly one distinct ``column`` (or one row when no column is given)."""
    size = F.count(F.lit(1)) if column is None else F.countDistinct(column)
    sizes = df.groupBy(by).agg(size.alias("_size"))
    return sizes.agg(
        F.count(F.lit(1)).alias("groups"),
        F.count_if(F.col("_size") == 1).alias("singletons"),
        (F.avg((F.col("_size") == 1).cast("int")) * 100).alias("singleton_percent"),
    )


def size_histogram(df: DataFrame, by: str) -> DataFrame:
    """How many groups have 1, 2, 3, ... rows."""
    sizes = df.groupBy(by).agg(F.count(F.lit(1)).alias("items_count"))
    return sizes.groupBy("items_count").agg(F.count(F.lit(1)).alias("groups"))


def histogram(df: DataFrame, column: str, bins: int, by: str | None = None) -> DataFrame:
    """Counts in ``bins`` equal bins between the overall minimum and maximum; with ``by`` also the density
    of every group, normalised per group. The last bin includes the maximum."""
    c = F.col(column).cast("double")
    ends = df.agg(F.struct(F.min(c).alias("lo"), F.max(c).alias("hi"))).scalar()
    groups = [by] if by else []
    placed = df.filter(c.isNotNull()).select(*groups, c.alias("_v"), ends.alias("_ends"))
    width = (F.col("_ends.hi") - F.col("_ends.lo")) / bins
    bin_no = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col("_v") - F.col("_ends.lo")) / width), F.lit(bins - 1))
    )
    counted = placed.groupBy(*groups, bin_no.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("count"),
        F.first("_ends.lo").alias("_lo"),
        F.first(width).alias("_width"),
    )
    out = counted.withColumn("bin_start", F.col("_lo") + F.col("bin") * F.col("_width"))
    if by:
        total = F.sum("count").over(Window.partitionBy(by))
        out = out.withColumn("density", divide_or_null("count", total * F.col("_width")))
    return out.drop("_lo", "_width")


def exact_quantiles(df: DataFrame, column: str, probabilities: list[float], by: list[str] | None = None) -> DataFrame:
    """Exact linear-interpolated quantiles per group as columns ``q0``, ``q1``, ...

    Equal values are counted first; the positions come from one distributed running sum, so a group may be
    larger than any task. ``percentile`` would hold a hot group's values in one task's memory.
    """
    by = by or []
    c = F.col(column).cast("double")
    counted = df.filter(c.isNotNull()).groupBy(*by, c.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    running = global_running_sum(counted, "_n", *by, "_v", name="_upto")
    if by:
        ends = running.groupBy(*by).agg(
            F.sum("_n").alias("_size"), F.min(F.col("_upto") - F.col("_n")).alias("_start")
        )
        placed = null_safe_join(running, ends, by)
    else:
        size = running.agg(F.sum("_n")).scalar()
        placed = running.withColumns({"_size": size, "_start": F.lit(0)})
    lower = F.col("_upto") - F.col("_n") - F.col("_start")
    upper = F.col("_upto") - F.col("_start")
    picks = []
    for i, p in enumerate(probabilities):
        target = F.lit(float(p)) * (F.col("_size") - 1)
        at_floor, at_ceil = F.floor(target), F.ceil(target)
        picks += [
            F.max(F.when((lower <= at_floor) & (at_floor < upper), F.col("_v"))).alias(f"_f{i}"),
            F.max(F.when((lower <= at_ceil) & (at_ceil < upper), F.col("_v"))).alias(f"_c{i}"),
            F.max(target - at_floor).alias(f"_w{i}"),
        ]
    picked = placed.groupBy(*by).agg(*picks)
    blend = [
        (F.col(f"_f{i}") + (F.col(f"_c{i}") - F.col(f"_f{i}")) * F.col(f"_w{i}")).alias(f"q{i}")
        for i in range(len(probabilities))
    ]
    return picked.select(*by, *blend)


def box_stats(df: DataFrame, column: str, by: str) -> DataFrame:
    """Quartiles and whiskers (furthest values within 1.5 interquartile ranges) per group."""
    quartiles = exact_quantiles(df, column, [0.25, 0.5, 0.75], [by]).toDF(by, "q1", "median", "q3")
    # Only distinct values can be a whisker, so collapse them before meeting the quartiles.
    values = df.select(by, F.col(column).cast("double").alias("_v")).distinct()
    spread = F.col("q3") - F.col("q1")
    inside = (F.col("_v") >= F.col("q1") - 1.5 * spread) & (F.col("_v") <= F.col("q3") + 1.5 * spread)
    return (
        null_safe_join(values, quartiles, [by])
        .groupBy(by, "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, F.col("_v"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("_v"))).alias("whisker_high"),
        )
    )


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, standard deviation, minimum and maximum per column, one row each, in one pass."""
    def facts(c: str) -> Column:
        v = F.col(c).cast("double")
        return F.struct(
            F.lit(c).alias("column"),
            F.count(v).alias("count"),
            F.avg(v).alias("mean"),
            F.stddev(v).alias("stddev"),
            F.min(v).alias("min"),
            F.max(v).alias("max"),
        )

    return df.agg(F.array(*[facts(c) for c in columns]).alias("_facts")).select(F.inline("_facts"))


def metric_summary(df: DataFrame, column: str) -> DataFrame:
    """Distribution of a column as metric rows ``column_min``, ``column_25p``, ... for the run history."""
    quartiles = exact_quantiles(df, column, [0.25, 0.5, 0.75]).select(F.struct("*")).scalar()
    one_row = describe(df, [column]).withColumn("_q", quartiles).select("*", "_q.*")
    names = {"min": "min", "25p": "q0", "50p": "q1", "75p": "q2", "max": "max", "mean": "mean", "stddev": "stddev"}
    pairs = [
        F.struct(F.lit(f"{column}_{n}").alias("metric_name"), F.coalesce(F.col(c), F.lit(0.0)).alias("value"))
        for n, c in names.items()
    ]
    return one_row.select(F.inline(F.array(*pairs)))


def scale_by_max(df: DataFrame, column: str, factor: float, name: str) -> DataFrame:
    """``column / max(column) * factor`` with the maximum as a scalar subquery."""
    top = df.agg(F.max(column)).scalar()
    return df.withColumn(name, divide_or_null(F.col(column), top) * factor)


def time_bounds(df: DataFrame, ts: str, by: str) -> DataFrame:
    return df.groupBy(by).agg(
        F.min(ts).alias("min_timestamp"), F.max(ts).alias("max_timestamp"), F.count(F.lit(1)).alias("size")
    )


def mean_per(df: DataFrame, by: str, column: str, name: str) -> DataFrame:
    return df.groupBy(by).agg(F.avg(column).alias(name))


def sum_count_per(df: DataFrame, by: str, column: str) -> DataFrame:
    return df.groupBy(by).agg(F.sum(column).alias("total"), F.count(F.lit(1)).alias("count"))


def sum_of_groups(grouped: DataFrame) -> DataFrame:
    """Grand total over the result of :func:`sum_count_per`."""
    return grouped.agg(
        F.sum("total").alias("total"), F.sum("count").alias("count"), F.count(F.lit(1)).alias("groups")
    )


def sales_by_date(fact: DataFrame, date: Column, price: str) -> DataFrame:
    return fact.groupBy(date.alias("date")).agg(F.sum(price).alias("sales")).orderBy("date")


def list_rows(df: DataFrame, by: str, column: str) -> DataFrame:
    """Lists in long form: (by, position, value), the values of a key in order, positions from 1. A key may have any number
    of values and span any number of tasks."""
    known = df.filter(F.col(column).isNotNull()).select(by, F.col(column).alias("value"))
    return rank_within(known, [by], "value", name="position").select(by, "position", "value")


def list_per(df: DataFrame, by: str, column: str, name: str = "values", max_len: int = 1_000_000) -> DataFrame:
    """Sorted list of values per key in chunks: (by, part, values).

    Part 0 has the first ``max_len`` values of a key, part 1 the next ones, and so on, so the chunks in order are the whole
    list, however long. Values are numbered only if some key needs a second chunk; no task gets all values of such a key.
    """
    known = df.filter(F.col(column).isNotNull()).select(by, F.col(column).alias("_value"))
    if known.groupBy(by).agg(F.count(F.lit(1)).alias("_size")).filter(F.col("_size") > max_len).isEmpty():
        return known.groupBy(by).agg(F.array_sort(F.collect_list("_value")).alias(name)).select(by, F.lit(0).alias("part"), name)
    numbered = list_rows(known, by, "_value").withColumn("part", F.floor((F.col("position") - 1) / max_len).cast("int"))
    chunks = numbered.groupBy(by, "part").agg(F.array_sort(F.collect_list("value")).alias(name))
    return chunks.select(by, "part", name)


def joined_list_per(df: DataFrame, by: str, column: str, separator: str = ", ", name: str = "joined", max_len: int = 1_000_000) -> DataFrame:
    """Like :func:`list_per`, with the values joined to one text."""
    listed = list_per(df.select(by, F.col(column).cast("string").alias(column)), by, column, "_values", max_len)
    return listed.select(by, "part", F.concat_ws(separator, "_values").alias(name))


def distinct_pairs(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct()


def dedupe(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key: any row, or the first by ``order`` when given."""
    if not order:
        return df.dropDuplicates(keys)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def matrix_stats(df: DataFrame, user: str, item: str) -> DataFrame:
    """Size, sparsity and average activity of an interaction matrix."""
    counted = df.agg(
        F.countDistinct(user).alias("total_users"),
        F.countDistinct(item).alias("total_items"),
        F.count(F.lit(1)).alias("total_interactions"),
    )
    cells = F.col("total_users").cast("double") * F.col("total_items")
    return counted.select(
        "*",
        (1 - divide_or_null("total_interactions", cells)).alias("matrix_sparsity"),
        divide_or_null("total_interactions", "total_users").alias("avg_interactions_per_user"),
        divide_or_null("total_interactions", "total_items").alias("avg_interactions_per_item"),
    )


def popularity_stats(df: DataFrame, count: str) -> DataFrame:
    """Number of groups, their total and their Gini coefficient, as one row from one pass.

    The coefficient is ``1 - 2 * sum((n + 1 - i) * v_i) / (n * sum(v))`` with v ascending, and 0 for no rows.
    Equal counts are folded into one row each. A fold of m values of size v after p smaller ones has the ranks
    p+1 .. p+m, whose weights (n + 1 - i) add up to m * n - m * p - m * (m - 1) / 2.
    """
    folds = df.groupBy(F.col(count).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("m"))
    # One row per distinct count: about sqrt(2 * rows counted) at most.
    smaller = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    placed = folds.withColumn("p", F.coalesce(F.sum("m").over(smaller), F.lit(0)))
    m, p, v = F.col("m").cast("double"), F.col("p"), F.col("v")
    whole = F.sum(m) * F.sum(m * v)
    missing = F.sum((m * p + m * (m - 1) / 2) * v)
    return placed.agg(
        F.coalesce(F.sum("m"), F.lit(0)).alias("groups"),
        F.coalesce(F.sum(m * v), F.lit(0.0)).alias("total"),
        F.coalesce(1 - 2 * divide_or_null(whole - missing, whole), F.lit(0.0)).alias("gini"),
    )


def gini(df: DataFrame, count: str) -> DataFrame:
    return popularity_stats(df, count).select("gini")


def coverage(recs: DataFrame, catalog: DataFrame, key: str = "product_id") -> DataFrame:
    """Percent of the catalog that is recommended at least once."""
    products = catalog.agg(F.countDistinct(key)).scalar()
    return recs.agg(F.countDistinct(key).alias("recommended")).select(
        "recommended",
        products.alias("catalog_size"),
        percent_of("recommended", products).alias("catalog_coverage_percent"),
    )


def split_overlap(train: DataFrame, test: DataFrame, key: str, name: str) -> DataFrame:
    """Distinct keys of both sides, common keys and the share of test keys seen in training. One shuffle."""
    both = train.select(F.col(key), F.lit(1).alias("_train"), F.lit(0).alias("_test")).unionByName(
        test.select(F.col(key), F.lit(0).alias("_train"), F.lit(1).alias("_test"))
    )
    per_key = both.groupBy(key).agg(F.max("_train").alias("_train"), F.max("_test").alias("_test"))
    counted = per_key.agg(
        F.sum("_train").alias(f"train_{name}"),
        F.sum("_test").alias(f"test_{name}"),
        F.sum(F.col("_train") * F.col("_test")).alias(f"common_{name}"),
    )
    return counted.withColumn(f"{name}_overlap_percentage", percent_of(f"common_{name}", f"test_{name}"))


def drift_summary(scores: DataFrame, threshold: float) -> DataFrame:
    """Mean, deviation, extremes and most frequent test per metric, rounded to 4 places, with a flag."""
    tests = scores.groupBy("metric_name", "statistical_test").agg(
        F.count(F.lit(1)).alias("n"),
    )
    mode = tests.groupBy("metric_name").agg(
        F.min_by("statistical_test", F.struct(-F.col("n"), F.col("statistical_test"))).alias("statistical_test")
    )
    s = F.col("drift_score")
    stats = scores.groupBy("metric_name").agg(
        F.round(F.avg(s), 4).alias("drift_mean"),
        F.round(F.stddev(s), 4).alias("drift_std"),
        F.round(F.max(s), 4).alias("drift_max"),
        F.round(F.min(s), 4).alias("drift_min"),
    )
    return stats.join(mode, "metric_name").select(
        "*", F.lit(threshold).alias("threshold"), (F.col("drift_max") > threshold).alias("above_threshold")
    )


def pivot_scores(scores: DataFrame, metrics: list[str]) -> DataFrame:
    """One row per time, one column per metric. Naming the metrics saves the pass that would find them."""
    return scores.groupBy("timestamp").pivot("metric_name", metrics).agg(F.first("drift_score"))


def profile(df: DataFrame, columns: list[str], exact_distinct: bool = False) -> DataFrame:
    """One row per column: counts, nulls, distinct values, extremes, mean and deviation, in one pass.

    Distinct counts are approximate unless asked otherwise: exact ones cost a shuffle of all values.
    """
    def facts(c: str) -> Column:
        v = F.col(c)
        number = v.try_cast("double")
        distinct = F.countDistinct(v) if exact_distinct else F.approx_count_distinct(v)
        return F.struct(
            F.lit(c).alias("column"),
            F.count(F.lit(1)).alias("rows"),
            F.count_if(v.isNull()).alias("nulls"),
            distinct.alias("distinct"),
            F.min(v).cast("string").alias("min"),
            F.max(v).cast("string").alias("max"),
            F.avg(number).alias("mean"),
            F.stddev(number).alias("stddev"),
        )

    return df.agg(F.array(*[facts(c) for c in columns]).alias("_facts")).select(F.inline("_facts"))


def profile_quantiles(df: DataFrame, columns: list[str], probabilities: list[float]) -> DataFrame:
    """Approximate quantiles per column with bounded memory, in one pass."""
    rows = [
        F.struct(F.lit(c).alias("column"), F.percentile_approx(F.col(c), probabilities, 10_000).alias("quantiles"))
        for c in columns
    ]
    return df.agg(F.array(*rows).alias("_facts")).select(F.inline("_facts"))


def factor_importance(factors: DataFrame, column: str = "features") -> DataFrame:
    """Mean absolute weight per latent dimension."""
    return (
        factors.select(F.posexplode(column).alias("dimension", "weight"))
        .groupBy("dimension")
        .agg(F.avg(F.abs("weight")).alias("importance"))
        .orderBy(F.desc("importance"), "dimension")
    )
