"""Queries over the recommender: data preparation, training, output and its judgement."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from martlet.functions.columns import cosine
from martlet.operators import interactions as I
from martlet.operators import recommender as R
from martlet.operators import similarity as S
from martlet.operators import topitems as TI
from martlet.operators import tuning as TU
from martlet.operators.aggregates import sum_count_per, sum_of_groups, time_bounds
from martlet.operators.ordering import global_row_number
from martlet.plans.registry import query, with_
from martlet.plans.tables import DELIVERED_FACT, FACT, Tables
from martlet.session import stored
from martlet.sources import readers, writers

USER_IDX = """user_idx AS (SELECT customer_id, CAST(row_number() OVER (ORDER BY count(*) DESC, CAST(customer_id AS VARCHAR)) - 1 AS INTEGER) AS "userId"
               FROM delivered_fact GROUP BY customer_id)"""
ITEM_IDX = """item_idx AS (SELECT product_id, CAST(row_number() OVER (ORDER BY count(*) DESC, CAST(product_id AS VARCHAR)) - 1 AS INTEGER) AS "itemId"
               FROM delivered_fact GROUP BY product_id)"""
RATED = """rated AS (SELECT *, price / (SELECT max(price) FROM delivered_fact) * 10 AS rating FROM delivered_fact)"""
# A recommendation set both engines can make: the ten dearest products a customer ever bought.
RECS = """recs AS (
  SELECT customer_id, product_id, score, CAST(row_number() OVER (PARTITION BY customer_id ORDER BY score DESC, product_id) AS INTEGER) AS rank
  FROM (SELECT customer_id, product_id, max(price) / 10000 AS score FROM fact GROUP BY 1, 2)
  QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY score DESC, product_id) <= 10)"""
ACTIVITY = "activity AS (SELECT customer_id, count(*) AS n FROM delivered_fact GROUP BY 1)"


def _recs(t: Tables):
    best = t.fact().groupBy("customer_id", "product_id").agg((F.max("price") / 10000).alias("score"))
    w = Window.partitionBy("customer_id").orderBy(F.desc("score"), "product_id")
    return best.withColumn("rank", F.row_number().over(w)).filter("rank <= 10")


def _stored_pairs(t: Tables):
    """Interactions as models read them, several times, and the two mappings."""
    pairs, users, items = I.interactions(t.delivered())
    return stored(pairs), users, items


def _as_indexes(recs):
    return recs.withColumnsRenamed({"customer_id": "userId", "product_id": "itemId"})


@query("R1", with_('SELECT product_id, "itemId" FROM item_idx', FACT, DELIVERED_FACT, ITEM_IDX))
def product_index(t: Tables):
    return I.index_ids(t.delivered(), "product_id", "itemId")


@query(
    "R2 R3",
    with_(
        """SELECT "userId", "itemId", round(rating, 8) AS rating, ts AS order_purchase_timestamp, customer_id, product_id
           FROM rated JOIN user_idx USING (customer_id) JOIN item_idx USING (product_id)""",
        FACT,
        DELIVERED_FACT,
        RATED,
        USER_IDX,
        ITEM_IDX,
    ),
)
def interaction_set(t: Tables):
    return I.interactions(t.delivered())[0].withColumn("rating", F.round("rating", 8))


@query("R4")
def random_split_overlap(t: Tables):
    pairs, _, _ = I.interactions(t.delivered())
    return I.random_split_stats(pairs, 0.8, 42)


@query(
    "R5 A11 W1",
    with_(
        """, n AS (SELECT ts, row_number() OVER (ORDER BY ts) AS rn, floor(count(*) OVER () * CAST('0.8' AS DOUBLE)) AS cut FROM delivered_fact)
           SELECT CASE WHEN rn <= cut THEN 'train' ELSE 'test' END AS split, min(ts) AS min_timestamp, max(ts) AS max_timestamp,
                  count(*) AS size FROM n GROUP BY 1""",
        FACT,
        DELIVERED_FACT,
    ).replace(") , n AS", "), n AS"),
)
def time_ordered_split(t: Tables):
    parts = I.time_split(
        t.delivered(), "order_purchase_timestamp", 0.2, "order_id", "order_item_id", F.xxhash64("product_id", "price")
    )
    return time_bounds(parts, "order_purchase_timestamp", "split")


@query("W1", "SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS row_number FROM orders")
def orders_numbered_by_time(t: Tables):
    orders = t.scan("orders").select("o_orderkey", "o_orderdate")
    return global_row_number(orders, "o_orderdate", "o_orderkey")


@query(
    "R8",
    with_(
        """, m AS (SELECT product_id, avg(rating) AS prediction FROM rated GROUP BY 1)
           SELECT round(sqrt(avg(pow(rating - prediction, 2))), 6) AS rmse, round(avg(abs(rating - prediction)), 6) AS mae, count(*) AS n
           FROM rated JOIN m USING (product_id)""",
        FACT,
        DELIVERED_FACT,
        RATED,
    ).replace(") , m AS", "), m AS"),
)
def errors_of_item_means(t: Tables):
    rated = I.preference(t.delivered(), name="rating")
    means = rated.groupBy("product_id").agg(F.avg("rating").alias("prediction"))
    out = R.regression_metrics(rated.join(means, "product_id"))
    return out.select(F.round("rmse", 6).alias("rmse"), F.round("mae", 6).alias("mae"), "n")


@query("R6 R7 R8")
def als_holdout_errors(t: Tables):
    pairs, _, _ = _stored_pairs(t)
    train, test = I.random_split(pairs, 0.8, 42)
    return R.regression_metrics(R.predict(R.fit_als(train, rank=10), test))


@query("R6 R9 R10 R14 R25")
def als_recommendations_stored(t: Tables):
    pairs, users, items = _stored_pairs(t)
    recs = R.explode_recs(R.recommend(R.fit_als(pairs, rank=10), 10))
    named = R.map_ids(recs, users, items)
    path = t.scratch("recommendations")
    writers.append_path(R.stamped_recs(named, "ProductRecommender", 1, dt.datetime(2024, 1, 31)), path)
    return readers.scan_path(t.spark, path, merge_schema=True)


@query("R6 R9 R12")
def als_ranking_metrics(t: Tables):
    pairs, _, _ = _stored_pairs(t)
    train, test = I.random_split(pairs, 0.8, 42)
    model = R.fit_als(train, rank=10)
    predicted = R.explode_recs(R.recommend(model, 10, test.select("userId").distinct()))
    return R.ranking_metrics(test, predicted)


@query("R21")
def cold_start_uplift_of_models(t: Tables):
    delivered = I.preference(stored(t.delivered().select("customer_id", "product_id", "price")))
    adjusted = I.adjusted_preference(delivered)
    users, items = I.index_ids(delivered, "customer_id", "userId"), I.index_ids(delivered, "product_id", "itemId")
    rated = stored(adjusted.join(users, "customer_id").join(items, "product_id").select("userId", "itemId", "preference", "adjusted_preference"))
    cohort = I.cold_start(rated, "userId", 12)
    cold = cohort.filter("is_cold").select("userId")
    base = R.fit_als(rated.withColumn("rating", F.col("preference")), True, rank=10)
    better = R.fit_als(rated.withColumn("rating", F.col("adjusted_preference")), True, rank=10, regParam=0.2, alpha=3.0)
    before, after = (R.explode_recs(R.recommend(m, 10, cold)) for m in (base, better))
    return R.score_uplift(before, after, cohort)


@query(
    "R21",
    with_(
        """SELECT round(avg(score) + 1e-9, 6) AS score_before, round(avg(score * rank) + 1e-9, 6) AS score_after,
                  round((avg(score * rank) / avg(score) - 1) * 100 + 1e-9, 6) AS improvement_percent
           FROM recs WHERE customer_id IN (SELECT customer_id FROM activity WHERE n < 12)""",
        FACT,
        DELIVERED_FACT,
        RECS,
        ACTIVITY,
    ),
)
def score_uplift_of_cohort(t: Tables):
    recs = _as_indexes(_recs(t))
    cohort = _as_indexes(I.cold_start(t.delivered(), "customer_id", 12))
    out = R.score_uplift(recs, recs.withColumn("score", F.col("score") * F.col("rank")), cohort)
    return out.select(*[F.round(F.col(c) + 1e-9, 6).alias(c) for c in out.columns])


@query(
    "R11",
    with_(
        """, a AS (SELECT customer_id, list(DISTINCT CAST(product_id AS DOUBLE) ORDER BY CAST(product_id AS DOUBLE)) AS actual FROM delivered_fact GROUP BY 1),
             p AS (SELECT customer_id, list(CAST(product_id AS DOUBLE) ORDER BY rank) AS predicted FROM recs GROUP BY 1)
           SELECT customer_id AS "userId", actual, predicted FROM a JOIN p USING (customer_id)""",
        FACT,
        DELIVERED_FACT,
        RECS,
    ).replace(") , a AS", "), a AS"),
)
def ranking_frame(t: Tables):
    return R.ranking_frame(_as_indexes(t.delivered()), _as_indexes(_recs(t)))


@query(
    "R12",
    with_(
        """, met AS (SELECT DISTINCT customer_id, product_id FROM delivered_fact),
             sizes AS (SELECT customer_id, count(*) AS n FROM met GROUP BY 1),
             hits AS (SELECT r.customer_id, r.rank, CASE WHEN m.product_id IS NULL THEN 0 ELSE 1 END AS hit
                      FROM recs r LEFT JOIN met m ON r.customer_id = m.customer_id AND r.product_id = m.product_id),
             sofar AS (SELECT *, sum(hit) OVER (PARTITION BY customer_id ORDER BY rank) AS h FROM hits),
             ks AS (SELECT unnest([1, 5, 10]) AS k),
             per AS (SELECT k, customer_id, any_value(n) AS n, sum(hit * h / rank) AS p, sum(hit / ln(rank + 1)) AS g
                     FROM sofar JOIN sizes USING (customer_id) JOIN ks ON rank <= k GROUP BY 1, 2),
             ideal AS (SELECT k, m, sum(1 / ln(i + 1)) AS best FROM ks, generate_series(1, 10) s(m), generate_series(1, 10) r(i)
                       WHERE m <= k AND i <= m GROUP BY 1, 2)
           SELECT CAST(per.k AS INTEGER) AS k, round(avg(p / n) + 1e-9, 6) AS map, round(avg(g / best) + 1e-9, 6) AS ndcg, count(*) AS users
           FROM per JOIN ideal ON per.k = ideal.k AND least(per.n, per.k) = ideal.m GROUP BY per.k""",
        FACT,
        DELIVERED_FACT,
        RECS,
    ).replace(") , met AS", "), met AS"),
)
def ranking_metrics(t: Tables):
    out = R.ranking_metrics(_as_indexes(t.delivered()), _as_indexes(_recs(t)))
    return out.select(
        "k", F.round(F.col("map") + 1e-9, 6).alias("map"), F.round(F.col("ndcg") + 1e-9, 6).alias("ndcg"), "users"
    )


@query(
    "R13",
    """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
       SELECT a.vec_id AS item, b.vec_id AS similar, round(list_cosine_similarity(a.e, b.e), 6) AS similarity,
              CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.e, b.e) DESC, b.vec_id) AS INTEGER) AS rank
       FROM v a JOIN v b ON a.vec_id <> b.vec_id
       QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.e, b.e) DESC, b.vec_id) <= 10""",
)
def similar_items(t: Tables):
    out = S.similar_items(t.scan("embeddings"), 10, "vec_id", "embedding")
    return out.withColumn("similarity", F.round("similarity", 6))


@query(
    "R9 R6",
    with_('SELECT "userId", 10 AS listed, true AS same_scores, true AS same_items FROM user_idx', FACT, DELIVERED_FACT, USER_IDX),
)
def als_top_items(t: Tables):
    """Best items of every user by blocks in order of length, held against the model's own all-by-all lists."""
    pairs, _, _ = _stored_pairs(t)
    model = R.fit_als(pairs)
    mine = TI.recommend_exactly(model, 10).lists
    other = R.recommend(model, 10).select("userId", F.col("recommendations").alias("others"))
    off = F.zip_with("recommendations", "others", lambda a, b: F.abs(a["rating"] - b["rating"]))
    # Where two neighbouring scores differ by less than a float tells, either item may come first.
    ids = F.zip_with("recommendations", "others", lambda a, b: (a["itemId"] == b["itemId"]) | F.exists("others", lambda o: (o["itemId"] == a["itemId"]) & (F.abs(o["rating"] - a["rating"]) < 1e-5)) | (F.abs(a["rating"] - F.element_at("others", -1)["rating"]) < 1e-5))
    return mine.join(other, "userId").select(
        "userId", F.size("recommendations").alias("listed"), (F.array_max(off) < 1e-5).alias("same_scores"), F.forall(ids, lambda x: x).alias("same_items")
    )


LETTERS = "etaoinshrdlucmfwygpbvkéñçã"
_PROFILE_SQL = ", ".join(f"(length(t) - length(replace(t, '{c}', '')))::DOUBLE / length(t)" for c in LETTERS)


def _letter_profiles(t: Tables):
    """Documents as shares of letters, a stand-in for factors that really lie in clusters."""
    text = F.lower("text")
    share = [(F.length("t") - F.length(F.replace(F.col("t"), F.lit(c), F.lit("")))) / F.length("t") for c in LETTERS]
    return t.scan("documents").select("doc_id", text.alias("t")).filter(F.length("t") > 0).select("doc_id", F.array(*share).alias("profile"))


def _recall(exact, found):
    """Share of the exact neighbours that were found, equally good ones counting as the same, and whether all scores agree."""
    least = exact.groupBy("item").agg(F.min("similarity").alias("least"), F.count(F.lit(1)).alias("n"))
    hits = found.join(least, "item").groupBy("item", "n").agg(F.sum((F.col("similarity") >= F.col("least") - 1e-9).cast("int")).alias("hits"))
    return hits.agg(F.sum(F.least("hits", "n")).alias("hits")), least.agg(F.sum("n").alias("n"))


@query(
    "R13",
    f"""WITH p AS (SELECT doc_id, [{_PROFILE_SQL}] AS e FROM (SELECT doc_id, lower(text) AS t FROM documents WHERE length(text) > 0)),
             v AS (SELECT doc_id, e FROM p WHERE list_sum(e) > 0)
        SELECT count(*) AS items, 10 * count(*) AS neighbours, true AS recall_reached, true AS scores_exact, true AS fewer_pairs FROM v""",
)
def similar_items_indexed(t: Tables):
    """The index against the exact search: nine of ten neighbours or more, with the same scores, from under half of all pairs."""
    profiles = t.scratch("profiles")
    _letter_profiles(t).write.parquet(profiles)
    profiles = t.spark.read.parquet(profiles)
    exact = stored(S.similar_items(profiles, 10, "doc_id", "profile"))  # read twice
    path = t.scratch("indexed")
    found, facts = S.indexed_similar_items(profiles, 10, "doc_id", "profile")
    found.write.parquet(path)
    found = t.spark.read.parquet(path)
    hits, wanted = _recall(exact, found)
    cosines = found.join(profiles.select(F.col("doc_id").alias("item"), F.col("profile").alias("a")), "item").join(
        profiles.select(F.col("doc_id").alias("similar"), F.col("profile").alias("b")), "similar"
    )
    return found.agg(
        F.countDistinct("item").alias("items"),
        F.count(F.lit(1)).alias("neighbours"),
        (hits.scalar() >= 0.9 * wanted.scalar()).alias("recall_reached"),
        cosines.agg(F.bool_and(F.abs(cosine("a", "b") - F.col("similarity")) < 1e-9)).scalar().alias("scores_exact"),
        F.lit(facts["share_of_pairs"] < 0.5).alias("fewer_pairs"),
    )


@query(
    "R13",
    """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
       SELECT CAST(7 AS INTEGER) AS item, b.vec_id AS similar, round(list_cosine_similarity(a.e, b.e), 6) AS similarity
       FROM v a JOIN v b ON a.vec_id = 7 AND b.vec_id <> 7 ORDER BY list_cosine_similarity(a.e, b.e) DESC, b.vec_id LIMIT 10""",
)
def items_similar_to_one(t: Tables):
    out = S.similar_to(t.scan("embeddings"), 7, 10, "vec_id", "embedding")
    return out.withColumn("similarity", F.round("similarity", 6))


@query(
    "R14",
    with_(
        """, known AS (SELECT * FROM item_idx WHERE "itemId" % 2 = 0)
           SELECT "userId", "itemId", customer_id, coalesce(CAST(known.product_id AS VARCHAR), 'Unknown') AS product_id, round(rating, 6) AS score
           FROM (SELECT "userId", "itemId", CAST(customer_id AS VARCHAR) AS customer_id, rating
                 FROM rated JOIN user_idx USING (customer_id) JOIN item_idx USING (product_id)) x
           LEFT JOIN known USING ("itemId")""",
        FACT,
        DELIVERED_FACT,
        RATED,
        USER_IDX,
        ITEM_IDX,
    ).replace(") , known AS", "), known AS"),
)
def recommendation_ids_restored(t: Tables):
    pairs, users, items = I.interactions(t.delivered())
    recs = pairs.select("userId", "itemId", F.round("rating", 6).alias("score"))
    return R.map_ids(recs, users, items.filter("itemId % 2 = 0"))


@query(
    "R15 A22 A23",
    with_(
        """, c AS (SELECT product_id, count(*) AS v FROM recs GROUP BY 1),
             o AS (SELECT v, row_number() OVER (ORDER BY v) AS i, count(*) OVER () AS n FROM c)
           SELECT (SELECT count(DISTINCT customer_id) FROM recs) AS users_with_recommendations,
                  (SELECT count(*) FROM recs) AS total_user_recommendations,
                  round((SELECT count(*) FROM c) * 100.0::DOUBLE / (SELECT count(*) FROM part), 6) AS catalog_coverage_percent,
                  (SELECT round(1 - 2 * sum((n + 1 - i) * v) / (any_value(n) * sum(v)), 8) FROM o) AS recommendation_gini""",
        FACT,
        RECS,
    ).replace(") , c AS", "), c AS"),
)
def recommendation_diversity(t: Tables):
    out = R.diversity(_recs(t), t.products())
    return out.withColumns(
        {
            "catalog_coverage_percent": F.round("catalog_coverage_percent", 6),
            "recommendation_gini": F.round("recommendation_gini", 8),
        }
    )


@query(
    "R16",
    with_("SELECT customer_id, n AS activity, n < 12 AS is_cold FROM activity", FACT, DELIVERED_FACT, ACTIVITY),
)
def cold_start_customers(t: Tables):
    return I.cold_start(t.delivered(), "customer_id", 12)


@query(
    "R16",
    with_(
        """, p AS (SELECT product_id, count(*) AS n FROM delivered_fact GROUP BY 1)
           SELECT count(*) FILTER (WHERE n <= 8) AS cold, count(*) AS total,
                  round(count(*) FILTER (WHERE n <= 8) * 100.0::DOUBLE / count(*), 6) AS cold_percent FROM p""",
        FACT,
        DELIVERED_FACT,
    ).replace(") , p AS", "), p AS"),
)
def cold_start_product_share(t: Tables):
    out = I.cold_start_share(I.cold_start(t.delivered(), "product_id", 8, inclusive=True))
    return out.withColumn("cold_percent", F.round("cold_percent", 6))


@query(
    "R17",
    with_(
        """, m AS (SELECT product_id, avg(rating) AS prediction FROM rated GROUP BY 1),
             e AS (SELECT n < 12 AS is_cold, rating - prediction AS e FROM rated JOIN m USING (product_id) JOIN activity USING (customer_id)),
             x AS (SELECT sqrt(avg(e * e) FILTER (WHERE is_cold)) AS cr, avg(abs(e)) FILTER (WHERE is_cold) AS cm,
                          sqrt(avg(e * e) FILTER (WHERE NOT is_cold)) AS rr, avg(abs(e)) FILTER (WHERE NOT is_cold) AS rm FROM e)
           SELECT round(cr, 6) AS cold_rmse, round(cm, 6) AS cold_mae, round(rr, 6) AS regular_rmse, round(rm, 6) AS regular_mae,
                  round(cr - rr, 6) AS rmse_difference FROM x""",
        FACT,
        DELIVERED_FACT,
        RATED,
        ACTIVITY,
    ).replace(") , m AS", "), m AS"),
)
def cohort_errors(t: Tables):
    rated = I.preference(t.delivered(), name="rating")
    means = rated.groupBy("product_id").agg(F.avg("rating").alias("prediction"))
    cohort = I.cold_start(t.delivered(), "customer_id", 12)
    out = R.cohort_errors(rated.join(means, "product_id"), cohort, "customer_id")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query(
    "R18",
    with_(
        """SELECT coalesce(n < 12, false) AS is_cold, round(avg(u) + 1e-9, 6) AS avg_unique_items, count(*) AS users
           FROM (SELECT customer_id, count(DISTINCT product_id) AS u FROM recs GROUP BY 1) LEFT JOIN activity USING (customer_id) GROUP BY 1""",
        FACT,
        DELIVERED_FACT,
        RECS,
        ACTIVITY,
    ),
)
def cohort_unique_items(t: Tables):
    cohort = _as_indexes(I.cold_start(t.delivered(), "customer_id", 12))
    out = R.cohort_unique_items(_as_indexes(_recs(t)), cohort)
    return out.withColumn("avg_unique_items", F.round(F.col("avg_unique_items") + 1e-9, 6))


@query(
    "R19",
    with_(
        """, c AS (SELECT product_id FROM delivered_fact GROUP BY 1 HAVING count(*) < 8)
           SELECT (SELECT count(*) FROM c) AS cold_items, (SELECT count(*) FROM c WHERE product_id IN (SELECT product_id FROM recs)) AS recommended_cold_items,
                  round((SELECT count(*) FROM c WHERE product_id IN (SELECT product_id FROM recs)) * 100.0::DOUBLE / (SELECT count(*) FROM c), 6) AS coverage_percent""",
        FACT,
        DELIVERED_FACT,
        RECS,
    ).replace(") , c AS", "), c AS"),
)
def cold_item_coverage(t: Tables):
    cohort = _as_indexes(I.cold_start(t.delivered(), "product_id", 8))
    out = R.cold_item_coverage(_as_indexes(_recs(t)), cohort)
    return out.withColumn("coverage_percent", F.round("coverage_percent", 6))


@query(
    "R20",
    with_(
        """, c AS (SELECT customer_id, avg(price) AS cp FROM delivered_fact GROUP BY 1), p AS (SELECT product_id, avg(price) AS pp FROM delivered_fact GROUP BY 1)
           SELECT order_id, order_item_id, product_id, round(rating, 6) AS preference,
                  round(rating * (1 + 0.2::DOUBLE * abs(cp / (SELECT max(cp) FROM c) - pp / (SELECT max(pp) FROM p))), 6) AS adjusted_preference
           FROM rated JOIN c USING (customer_id) JOIN p USING (product_id)""",
        FACT,
        DELIVERED_FACT,
        RATED,
    ).replace(") , c AS", "), c AS"),
)
def price_adjusted_preference(t: Tables):
    # Five jobs read the fact.
    sold = stored(t.delivered().select("order_id", "order_item_id", "customer_id", "product_id", "price"))
    out = I.adjusted_preference(I.preference(sold))
    return out.select(
        "order_id",
        "order_item_id",
        "product_id",
        F.round("preference", 6).alias("preference"),
        F.round("adjusted_preference", 6).alias("adjusted_preference"),
    )


PRICES = "prices AS (SELECT product_id, avg(price) AS avg_price FROM fact GROUP BY 1)"


@query(
    "R22",
    with_(
        """SELECT customer_id, product_id, round(score * avg_price / 10 + 1e-7, 4) AS potential_revenue FROM recs JOIN prices USING (product_id)""",
        FACT,
        RECS,
        PRICES,
    ),
)
def potential_revenue(t: Tables):
    out = I.revenue_potential(_recs(t), t.fact())
    return out.select("customer_id", "product_id", F.round(F.col("potential_revenue") + 1e-7, 4).alias("potential_revenue"))


@query(
    "R22 A13 K3",
    with_(
        """SELECT customer_id, round(sum(score * avg_price / 10) + 1e-7, 3) AS total, count(*) AS count FROM recs JOIN prices USING (product_id)
           GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
        FACT,
        RECS,
        PRICES,
    ),
)
def customers_by_potential_revenue(t: Tables):
    per = sum_count_per(I.revenue_potential(_recs(t), t.fact()), "customer_id", "potential_revenue")
    rounded = per.withColumn("total", F.round(F.col("total") + 1e-7, 3))
    return rounded.orderBy(F.desc("total"), "customer_id").limit(10)


@query(
    "R22 A13",
    with_(
        """SELECT round(sum(score * avg_price / 10), 2) AS total, count(*) AS count, count(DISTINCT customer_id) AS groups
           FROM recs JOIN prices USING (product_id)""",
        FACT,
        RECS,
        PRICES,
    ),
)
def total_potential_revenue(t: Tables):
    per = sum_count_per(I.revenue_potential(_recs(t), t.fact()), "customer_id", "potential_revenue")
    return sum_of_groups(per).withColumn("total", F.round("total", 2))


@query("R23")
def als_grid_search(t: Tables):
    pairs, _, _ = I.interactions(t.delivered())
    return R.grid_search(pairs, {"rank": [5, 10], "regParam": [0.1, 0.5]}, folds=3, maxIter=5)[1]


TRIAL_SPLIT = """, pairs AS (SELECT customer_id, product_id, ts FROM rated), train AS (SELECT * FROM pairs WHERE ts < TIMESTAMP '2000-01-01'),
  test AS (SELECT * FROM pairs WHERE ts >= TIMESTAMP '2000-01-01'),
  known AS (SELECT * FROM test WHERE customer_id IN (SELECT customer_id FROM train) AND product_id IN (SELECT product_id FROM train)),
  met AS (SELECT count(*)::DOUBLE AS pairs FROM known),
  served AS (SELECT count(DISTINCT customer_id)::DOUBLE AS users FROM test WHERE customer_id IN (SELECT customer_id FROM train))"""
#: A configuration that no model can be fitted with.
IMPOSSIBLE = {"rank": 10, "regParam": -1.0, "alpha": 1.0, "maxIter": 5}


def _trial_facts(log):
    """What can be said of a trial without fitting a model: where its parameters and metrics lie, and what it was judged on."""
    p = F.col("parameters")
    inside = p["rank"].between(5, 199) & p["regParam"].between(0.001, 10) & p["alpha"].between(0.01, 100) & p["maxIter"].between(5, 29)
    return log.select(
        "trial",
        inside.alias("inside_the_space"),
        F.col("error").isNotNull().alias("failed"),
        "evaluated_pairs",
        "evaluated_users",
        (F.col("rmse") >= F.col("mae")).alias("rmse_over_mae"),
        (F.col("map_at_k").between(0, 1) & F.col("ndcg_at_k").between(0, 1)).alias("ranks_in_bounds"),
        (F.col("seconds") > 0).alias("timed"),
    )


def _trial_sql(trials: int) -> str:
    return with_(
        TRIAL_SPLIT
        + f"""
  SELECT t::INT AS trial, t < {trials} AS inside_the_space, t = {trials} AS failed, CASE WHEN t < {trials} THEN pairs END AS evaluated_pairs,
         CASE WHEN t < {trials} THEN users END AS evaluated_users, CASE WHEN t < {trials} THEN true END AS rmse_over_mae,
         CASE WHEN t < {trials} THEN true END AS ranks_in_bounds, true AS timed FROM range({trials + 1}) r(t), met, served""",
        FACT,
        DELIVERED_FACT,
        RATED,
    ).replace(") , pairs AS", "), pairs AS")


def _trial_pairs(t: Tables):
    pairs, cut = _stored_pairs(t)[0], F.col("order_purchase_timestamp") < F.lit("2000-01-01").cast("timestamp_ntz")
    return pairs.filter(cut), pairs.filter(~cut)


@query("R24 R12 R8", _trial_sql(10))
def als_random_search(t: Tables):
    """Ten draws from the whole space and one impossible configuration, four at a time, as rows of the trial log."""
    train, test = _trial_pairs(t)
    return _trial_facts(TU.search_als(train, test, t.scratch("trials"), also=[IMPOSSIBLE], parallelism=4))


@query("R24", _trial_sql(2))
def als_search_resumed(t: Tables):
    """A search whose budget ends it at once, one that runs its first trial, and one that finds the log and runs the rest."""
    train, test, log = *_trial_pairs(t), t.scratch("trials")
    small = {"space": {"rank": ("log_int", 5, 12), "regParam": ("log", 0.001, 10.0), "alpha": ("log", 0.01, 100.0), "maxIter": ("int", 5, 7)}}
    assert TU.search_als(train, test, log, **small, trials=2, budget_seconds=0).isEmpty()
    TU.search_als(train, test, log, **small, trials=1)
    return _trial_facts(TU.search_als(train, test, log, **small, trials=2, also=[IMPOSSIBLE]))
