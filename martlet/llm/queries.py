"""One query for each operator, over the whole given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from martlet.llm import bpe, byte_cnn, decontaminate, ftrl, isolation_forest, jaccard_join, line_dedup, ranked_search, secrets, simhash, sparse_suffix, surrogates, vector_codes
from martlet.llm.common import default_tokenizer, held_out, table


#: Key of the surrogates that the query draws; a user's own key stays secret.
SURROGATE_KEY = "martlet"


def op1_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced by surrogates."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.replace_entities(docs, SURROGATE_KEY)


def op2_isolation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule statistics of every document, whether the base limits reject it, and the verdict."""
    judged = isolation_forest.judge_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    counts = [F.col(f"counts.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return judged.select("doc_id", *counts, "base_failed", "kept", "anomaly")


def op3_ftrl_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by the classifier on hashed word n-grams."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = ftrl.score_documents(docs, ftrl.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under links of similar shingle sets."""
    return jaccard_join.join_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded and decoded: doc_id, n_tokens and digests of the ids and of the decoded text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, default_tokenizer(), decoded="decoded")
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op6_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by the convolutional network over its bytes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    judged = byte_cnn.identify(docs.select("doc_id", "text"), byte_cnn.fit(docs))
    return judged.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with an earlier similar line."""
    return line_dedup.duplicate_lines(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts of the known kinds, a digest of their spans, and all spans."""
    found = secrets.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"] != "random")
    counts = [secrets.count_of(kind).alias(f"n_{kind}") for kind in secrets.KINDS]
    return found.select("doc_id", *counts, F.sha2(secrets.as_text(base), 256).alias("base_sha256"), secrets.as_text(F.col("spans")).alias("spans"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that stand in documents."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_sparse_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that several documents have."""
    return sparse_suffix.repeated_passages(table(spark, sf_dir, "documents"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and its component under links of at most two differing bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item."""
    return ranked_search.ranked_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and error of every whole vector, with the errors of its label and a digest of the codebooks."""
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    out = vector_codes.with_label_errors(coded)
    return out.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


QUERIES = {f.__name__: f for f in (op1_surrogates, op2_isolation_forest, op3_ftrl_quality, op4_jaccard_join, op5_bpe, op6_byte_cnn, op7_line_dedup, op8_secret_scan, op9_decontaminate, op10_sparse_suffix, op11_simhash, op12_ranked_search, op13_vector_codes)}
QUERIES["pipeline"] = corpus_pipeline.run
SQL: dict[str, str] = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
SQL["op12_ranked_search"] = r"""
WITH term_lists AS (
  SELECT row_number() OVER () AS doc, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents WHERE text IS NOT NULL),
lengths AS (SELECT doc, doc_id, terms, len(terms) AS n FROM term_lists WHERE len(terms) > 0),
totals AS (SELECT count(*)::BIGINT AS total, sum(n)::BIGINT AS words FROM lengths),
counts AS (SELECT doc, term, count(*)::BIGINT AS tf FROM (SELECT doc, unnest(terms) AS term FROM lengths) GROUP BY doc, term),
asked AS (
  SELECT item_id, term, count(*)::BIGINT AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE text IS NOT NULL) GROUP BY item_id, term),
weights AS (
  SELECT term, floor(1000 * ln((2 * total + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM counts, totals
  WHERE term IN (SELECT term FROM asked) GROUP BY term, total),
scored AS (
  SELECT item_id, doc_id, doc, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * total) // words))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN counts USING (term) JOIN lengths USING (doc), totals GROUP BY item_id, doc_id, doc),
ranked AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""


def _vector_codes_sql(rounds: int = 6) -> str:
    """Rounds of assignment and update, written out one after the other."""
    floor_div = "(({0}) - ((({0}) % ({1})) + ({1})) % ({1})) // ({1})"
    steps = [
        """kept AS MATERIALIZED (
  SELECT row_number() OVER () AS v, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS c, len(embedding) // 8 AS w
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "parts AS MATERIALIZED (SELECT v, vec_id, label, p, c[p * w + 1 : (p + 1) * w] AS c FROM kept, range(8) t(p))",
        "firsts AS (SELECT v, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < 16)",
        "book0 AS MATERIALIZED (SELECT p, e, c FROM parts JOIN firsts USING (v))",
    ]
    for i in range(rounds + 1):
        steps.append(
            f"""near{i} AS MATERIALIZED (
  SELECT v, p, c, d, e FROM (
    SELECT x.v, x.p, x.c, b.e, list_sum(list_transform(list_zip(x.c, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM parts x JOIN book{i} b USING (p))
  QUALIFY row_number() OVER (PARTITION BY v, p ORDER BY d, e) = 1)"""
        )
        if i < rounds:
            mean = floor_div.format("sum(x)::BIGINT", "count(*)::BIGINT")
            steps.append(
                f"""mean{i} AS (
  SELECT p, e, list(m ORDER BY k) AS c FROM (
    SELECT p, e, k, {mean} AS m FROM (SELECT p, e, unnest(c) AS x, generate_subscripts(c, 1) AS k FROM near{i}) GROUP BY p, e, k) GROUP BY p, e)"""
            )
            steps.append(f"book{i + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.c, b.c) AS c FROM book{i} b LEFT JOIN mean{i} m USING (p, e))")
    steps.append(f"coded AS MATERIALIZED (SELECT v, string_agg(lpad(hex(e), 2, '0'), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near{rounds} GROUP BY v)")
    steps.append(f"books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds})")
    return (
        "WITH " + ",\n".join(steps) + "\nSELECT vec_id, lower(code) AS code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 "
        "FROM coded JOIN kept USING (v), books"
    )


SQL["op13_vector_codes"] = _vector_codes_sql()
