"""Queries over text enrichment and segmentation. A local function stands for the remote service."""

from __future__ import annotations

import uuid

from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from martlet.operators import enrichment as E
from martlet.operators import segments as S
from martlet.plans.registry import query
from martlet.plans.tables import Tables
from martlet.sources import writers

SYSTEM = "Rate product reviews of a shop by how likely the product was defective."
INSTRUCTION = "Give every review of the JSON array a defect score between 0.0 and 1.0 and answer with the list of scores only."
TEMPLATE = "Find one name for all of these categories: {brands_str}"


def mark_english(texts: list[str]) -> list[str]:
    return [f"en:{text}" for text in texts]


def letter_vector(texts: list[str]) -> list[list[float]]:
    return [[float(text.lower().count(c)) + 0.5 for c in "aeiounrst"] for text in texts]


def name_segment(prompts: list[str]) -> list[str]:
    return [f"Segment of {prompt.split(': ', 1)[1]}" for prompt in prompts]


@query(
    "X1",
    "SELECT DISTINCT doc_id, CASE WHEN trim(text) <> '' THEN text END AS text FROM documents WHERE trim(text) <> '' AND text IS NOT NULL",
)
def texts_to_enrich(t: Tables):
    return E.texts_to_enrich(t.scan("documents"), "doc_id", "text")


@query(
    "X2",
    """SELECT count(*) AS texts, CAST(sum(length(text)) AS BIGINT) AS chars, true AS within_limits, true AS ids_once
       FROM (SELECT DISTINCT doc_id, text FROM documents WHERE trim(text) <> '')""",
)
def request_batches_by_size(t: Tables):
    batches = E.batch_by_size(E.texts_to_enrich(t.scan("documents"), "doc_id", "text"), "doc_id", "text")
    fits = ((F.col("n_chars") <= E.MAX_CHARS) | (F.col("n_items") == 1)) & (F.col("n_items") <= E.MAX_ITEMS)
    per_text = batches.select("n_items", fits.alias("_fits"), F.explode(F.arrays_zip("ids", "texts")).alias("_e"))
    return per_text.agg(
        F.count(F.lit(1)).alias("texts"),
        F.sum(F.length("_e.texts")).alias("chars"),
        F.min("_fits").alias("within_limits"),
        (F.count(F.lit(1)) == F.countDistinct("_e.ids")).alias("ids_once"),
    )


NUMBERED = """numbered AS (SELECT doc_id, text, (row_number() OVER (ORDER BY doc_id) - 1) AS i FROM documents WHERE trim(text) <> '')"""


def _batches(t: Tables):
    return E.batch_by_count(E.texts_to_enrich(t.scan("documents"), "doc_id", "text"), "doc_id", "text")


@query(
    "X3",
    f"WITH {NUMBERED} SELECT i // 20 AS batch_no, list(doc_id ORDER BY doc_id) AS ids, CAST(sum(length(text)) AS BIGINT) AS chars FROM numbered GROUP BY 1",
)
def review_batches_by_count(t: Tables):
    return _batches(t).select(
        "batch_no",
        F.transform("items", lambda e: e["id"]).alias("ids"),
        F.aggregate("items", F.lit(0).cast("long"), lambda acc, e: acc + F.length(e["text"])).alias("chars"),
    )


@query(
    "X4 J8",
    "SELECT conv_id, turn, role, CASE WHEN trim(text) <> '' THEN 'en:' || text END AS text_en FROM conversations",
)
def enriched_conversations(t: Tables):
    turns = t.scan("conversations")
    enriched = E.enrich(turns, "conv_id", "text", mark_english, "text_en")
    return E.add_enrichment(turns, enriched, "conv_id", "text").select("conv_id", "turn", "role", "text_en")


def first_try(texts: list[str]) -> list[str]:
    if any(len(text) % 5 == 0 for text in texts):
        raise TimeoutError("no answer")
    return [f"1:{text}" for text in texts]


def second_try(texts: list[str]) -> list[str]:
    if any(len(text) % 15 == 0 for text in texts):
        raise TimeoutError("no answer again")
    return [f"2:{text}" for text in texts]


@query(
    "X4",
    """SELECT conv_id, text, CASE WHEN length(text) % 5 <> 0 THEN '1:' || text WHEN length(text) % 15 <> 0 THEN '2:' || text END AS text_en,
              CASE WHEN length(text) % 15 = 0 THEN 'TimeoutError: no answer again' END AS text_en_error, CASE WHEN length(text) % 5 = 0 THEN 2 ELSE 1 END::BIGINT AS attempts
       FROM (SELECT DISTINCT conv_id, text FROM conversations WHERE trim(text) <> '')""",
)
def enrichment_taken_up_again(t: Tables):
    """Requests of one text; a second run asks again for those that failed only, and one error stays in its column."""
    turns, path = t.scan("conversations"), t.scratch("answers")
    once = {"retries": 0, "wait": 0.0, "max_items": 1}
    E.enrich_stored(turns, "conv_id", "text", first_try, "text_en", path, waves=2, **once)
    return E.enrich_stored(turns, "conv_id", "text", second_try, "text_en", path, **once)


def _json_sql(column: str) -> str:
    return f"to_json(list({column} ORDER BY doc_id))"


@query(
    "X5",
    f"""WITH {NUMBERED} SELECT i // 20 AS batch_no, '{SYSTEM}' AS system_content,
          '{INSTRUCTION} Reviews: ' || CAST({_json_sql('text')} AS VARCHAR) AS user_content FROM numbered GROUP BY 1""",
)
def chat_requests(t: Tables):
    payload = E.chat_payload(_batches(t), SYSTEM, INSTRUCTION)
    return payload.select(
        "batch_no",
        F.get("messages", F.lit(0))["content"].alias("system_content"),
        F.get("messages", F.lit(1))["content"].alias("user_content"),
    )


def _replies(t: Tables):
    """Replies of every kind: scores, silence, and one score too few."""
    scores = F.to_json(F.transform("items", lambda e: (e["id"] % 10) / 10))
    short = F.to_json(F.transform(F.slice("items", 2, 100), lambda e: (e["id"] % 10) / 10))
    kind = F.col("batch_no") % 5
    reply = F.when(kind == 1, None).when(kind == 2, "[null]").when(kind == 3, short).otherwise(scores)
    return _batches(t).withColumn("reply", reply)


@query(
    "X6 X7",
    f"""WITH {NUMBERED} SELECT doc_id AS review_id, text AS review,
          CASE WHEN (i // 20) % 5 NOT IN (1, 2) THEN CAST((doc_id % 10) / 10 AS FLOAT) END AS defect_score
        FROM numbered WHERE (i // 20) % 5 <> 3""",
)
def parsed_defect_scores(t: Tables):
    return E.parse_scores(_replies(t))[0]


@query(
    "S4 X7",
    f"""WITH {NUMBERED}, scored AS (SELECT doc_id AS review_id, text AS review, CASE WHEN (i // 20) % 5 NOT IN (1, 2) THEN CAST((doc_id % 10) / 10 AS FLOAT) END AS defect_score
          FROM numbered WHERE (i // 20) % 5 <> 3)
        SELECT *, (SELECT count(*) FROM scored) AS rows_after_failure, 2::BIGINT AS columns_before FROM scored""",
)
def score_table_replaced(t: Tables):
    """The score table written without texts, replaced by one with texts; a replacement that fails in between changes nothing."""
    database, folder = f"scores_{uuid.uuid4().hex}", t.scratch("scores")
    t.spark.sql(f"CREATE DATABASE {database}")
    name, scores = f"{database}.reviews_defect", E.parse_scores(_replies(t))[0]
    writers.replace_table(scores.select("review_id", "defect_score"), name, folder)
    before = len(t.spark.table(name).columns)
    broken = scores.withColumn("defect_score", F.when(F.col("review_id") % 7 == 3, F.raise_error(F.lit("lost")).cast("float")).otherwise(F.col("defect_score")))
    try:
        writers.replace_table(broken, name, folder)
    except Exception as error:  # noqa: BLE001 - the failure is the point
        if "lost" not in str(error):
            raise
    kept = t.spark.table(name).count()
    writers.replace_table(scores, name, folder, check=lambda df: not df.isEmpty())
    return t.spark.table(name).withColumns({"rows_after_failure": F.lit(kept).cast("long"), "columns_before": F.lit(before).cast("long")})


@query(
    "X6",
    f"""WITH {NUMBERED} SELECT i // 20 AS batch_no, CAST(count(*) AS INTEGER) AS n_items, CAST(count(*) - 1 AS INTEGER) AS n_scores
        FROM numbered WHERE (i // 20) % 5 = 3 GROUP BY 1""",
)
def rejected_score_batches(t: Tables):
    return E.parse_scores(_replies(t))[1].select("batch_no", "n_items", "n_scores")


@query("X8", "SELECT count(*) FILTER (WHERE trim(lang) <> '' AND doc_id % 3 = 0) AS enriched, count(*) AS rows FROM documents")
def enriched_row_count(t: Tables):
    some = t.scan("documents").withColumn("lang_en", F.when(F.col("doc_id") % 3 == 0, F.col("lang")).otherwise("  "))
    return E.enriched_count(some, "lang_en")


@query(
    "X9",
    "SELECT doc_id, 'en:' || lang AS lang_en, 'en:' || source AS source_en FROM documents",
)
def several_columns_enriched(t: Tables):
    docs = t.scan("documents").select("doc_id", "lang", "source")
    return E.enrich_columns(docs, "doc_id", ["lang", "source"], mark_english).select("doc_id", "lang_en", "source_en")


@query(
    "X10",
    "SELECT p_name, list_transform(string_split('a,e,i,o,u,n,r,s,t', ','), lambda c: length(p_name) - length(replace(p_name, c, '')) + 0.5::DOUBLE) AS embeddings FROM (SELECT DISTINCT p_name FROM part)",
)
def category_vectors(t: Tables):
    return E.embed(t.scan("part"), "p_name", letter_vector).select("p_name", "embeddings")


@query("X11")
def embedding_clusters(t: Tables):
    return S.cluster(t.scan("embeddings"), "embedding")[1].select("vec_id", "label", "cluster")


@query(
    "X12",
    """SELECT label, 0::INT AS part, list(vec_id ORDER BY vec_id) AS members, string_agg(CAST(vec_id AS VARCHAR), ', ' ORDER BY vec_id) AS members_str
       FROM embeddings GROUP BY 1""",
)
def cluster_members(t: Tables):
    return S.members(t.scan("embeddings"), "label", "vec_id", "members")


BRANDS = """b AS (SELECT p_type, string_agg(p_brand, ', ' ORDER BY p_brand) AS s FROM (SELECT DISTINCT p_type, p_brand FROM part) GROUP BY 1)"""


def _named(t: Tables):
    grouped = S.members(t.scan("part").select("p_type", "p_brand").distinct(), "p_type", "p_brand", "brands")
    return S.name_clusters(grouped, "p_type", TEMPLATE, "brands_str", name_segment, "segment")


@query("X13", f"WITH {BRANDS} SELECT p_type, 'Segment of ' || s AS segment FROM b")
def named_segments(t: Tables):
    return _named(t).select("p_type", "segment")


@query(
    "X12 X13",
    """WITH n AS (SELECT p_type, p_brand, row_number() OVER (PARTITION BY p_type ORDER BY p_brand) - 1 AS i FROM (SELECT DISTINCT p_type, p_brand FROM part)),
            c AS (SELECT p_type, i // 3 AS part, string_agg(p_brand, ', ' ORDER BY p_brand) AS s FROM n GROUP BY 1, 2),
            g AS (SELECT p_type, CASE WHEN count(*) > 1 THEN 'Segment of ' || string_agg('Segment of ' || s, ', ' ORDER BY part) ELSE 'Segment of ' || any_value(s) END AS segment FROM c GROUP BY 1)
       SELECT p_type, CAST(part AS INTEGER) AS part, s AS brands_str, segment FROM c JOIN g USING (p_type)""",
)
def segments_named_in_chunks(t: Tables):
    """Members in chunks of three; a group of several chunks has one name, made of the names of its chunks."""
    grouped = S.members(t.scan("part").select("p_type", "p_brand").distinct(), "p_type", "p_brand", "brands", 3)
    return S.name_clusters(grouped, "p_type", TEMPLATE, "brands_str", name_segment, "segment").select("p_type", "part", "brands_str", "segment")


@query("X14", f"WITH {BRANDS} SELECT DISTINCT p_type, p_brand, 'Segment of ' || s AS segment FROM part JOIN b USING (p_type)")
def brand_segment_map(t: Tables):
    return _named(t).select("p_type", F.explode("brands").alias("p_brand"), "segment")


@query("X14", f"WITH {BRANDS} SELECT p_brand, 'Segment of ' || s AS segment FROM b, (SELECT DISTINCT p_type, p_brand FROM part) p WHERE p.p_type = b.p_type")
def segment_of_members(t: Tables):
    return S.segment_map(_named(t), "brands", "p_brand", "segment")


@query("X15", f"WITH {BRANDS} SELECT p_type, 'Segment of ' || s AS segment FROM b")
def segments_by_pipeline_stage(t: Tables):
    stage = S.SegmentTransformer(
        groupCol="p_type",
        valueCol="p_brand",
        pluralCol="brands",
        outputCol="segment",
        template=TEMPLATE,
        namer="martlet.plans.texts:name_segment",
    )
    pairs = t.scan("part").select("p_type", "p_brand").distinct()
    return Pipeline(stages=[stage]).fit(pairs).transform(pairs).select("p_type", "segment")


@query("X11 X15 X13")
def clustered_and_named(t: Tables):
    vectors = E.embed(t.scan("part"), "p_name", letter_vector)
    _, clustered = S.cluster(vectors, "embeddings", k=6)
    grouped = S.members(clustered, "cluster", "p_name", "brands")
    return S.name_clusters(grouped, "cluster", TEMPLATE, "brands_str", name_segment, "segment")
