"""Batched text enrichment through a pluggable function, and its reply parsing.

The function stands for a remote service: it takes a list of texts and returns a list of the same length.
Calls cost time and money, so write the result of :func:`enrich` to a table before using it twice.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martlet.functions.columns import blank_as_null
from martlet.operators.ordering import global_row_number

MAX_CHARS = 45_000
MAX_ITEMS = 900
REVIEWS_PER_BATCH = 20

EnrichFn = Callable[[list[str]], list]


def texts_to_enrich(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Distinct (id, text) pairs with a text that is not blank."""
    cleaned = df.select(id_col, blank_as_null(text_col).alias(text_col))
    return cleaned.dropna(subset=[text_col]).distinct()


def greedy_batches(
    items: Iterable[tuple], max_chars: int = MAX_CHARS, max_items: int = MAX_ITEMS
) -> Iterator[list[tuple]]:
    """Fill a batch until the next (id, text) would break a limit. A text over the limit travels alone."""
    batch, chars = [], 0
    for item in items:
        size = len(item[1])
        if batch and (chars + size > max_chars or len(batch) == max_items):
            yield batch
            batch, chars = [], 0
        batch.append(item)
        chars += size
    if batch:
        yield batch


def _rows(pdfs: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    for pdf in pdfs:
        yield from zip(pdf.iloc[:, 0], pdf.iloc[:, 1])


def _spread(df: DataFrame, partitions: int | None) -> DataFrame:
    """Even partitions whatever the ids look like: of a size in bytes that the session advises, or as many as asked."""
    return df.repartition(partitions) if partitions else df.hint("rebalance")


def batch_by_size(
    df: DataFrame,
    id_col: str,
    text_col: str,
    max_chars: int = MAX_CHARS,
    max_items: int = MAX_ITEMS,
    partitions: int | None = None,
) -> DataFrame:
    """Request batches (batch_id, ids, texts, n_items, n_chars) within both limits, filled per partition."""
    source = _spread(df.select(id_col, text_col), partitions)
    id_type = source.schema[id_col].dataType.simpleString()

    def pack(pdfs):
        base = TaskContext.get().partitionId() << 33
        for number, batch in enumerate(greedy_batches(_rows(pdfs), max_chars, max_items)):
            ids, texts = zip(*batch)
            yield pd.DataFrame(
                {
                    "batch_id": [base + number],
                    "ids": [list(ids)],
                    "texts": [list(texts)],
                    "n_items": [len(batch)],
                    "n_chars": [sum(map(len, texts))],
                }
            )

    return source.mapInPandas(
        pack, f"batch_id long, ids array<{id_type}>, texts array<string>, n_items int, n_chars long"
    )


def batch_by_count(df: DataFrame, id_col: str, text_col: str, n: int = REVIEWS_PER_BATCH) -> DataFrame:
    """Batches (batch_no, items) of exactly ``n`` rows in id order; only the last one may be shorter."""
    numbered = global_row_number(df.select(id_col, text_col), id_col, F.xxhash64(text_col), name="_rn")
    item = F.struct("_rn", F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return (
        numbered.withColumn("batch_no", F.floor((F.col("_rn") - 1) / n))
        .groupBy("batch_no")
        .agg(F.array_sort(F.collect_list(item)).alias("_items"))
        .select("batch_no", F.transform("_items", lambda e: F.struct(e["id"].alias("id"), e["text"].alias("text"))).alias("items"))
    )


def call_with_retry(fn: EnrichFn, texts: list[str], retries: int, wait: float) -> tuple[list, str | None]:
    """Results of one request, or nulls and the last error after all tries."""
    for attempt in range(retries + 1):
        try:
            results = list(fn(texts))
            if len(results) != len(texts):
                raise ValueError(f"{len(results)} results for {len(texts)} texts")
            return results, None
        except Exception as error:  # noqa: BLE001 - whatever the service raises is recorded per row
            message = f"{type(error).__name__}: {error}"
            if attempt < retries:
                time.sleep(wait)
    return [None] * len(texts), message


def enrich(
    df: DataFrame,
    id_col: str,
    text_col: str,
    fn: EnrichFn,
    output: str,
    output_type: str = "string",
    retries: int = 3,
    wait: float = 30.0,
    max_chars: int = MAX_CHARS,
    max_items: int = MAX_ITEMS,
    partitions: int | None = None,
) -> DataFrame:
    """Enrich distinct texts: (id, text, output, output_error), one row per pair.

    A request that keeps failing marks its rows with the error instead of stopping the job.
    """
    source = _spread(texts_to_enrich(df, id_col, text_col), partitions)
    id_type = source.schema[id_col].dataType.simpleString()

    def work(pdfs):
        for batch in greedy_batches(_rows(pdfs), max_chars, max_items):
            ids, texts = map(list, zip(*batch))
            results, error = call_with_retry(fn, texts, retries, wait)
            yield pd.DataFrame(
                {id_col: ids, text_col: texts, output: results, f"{output}_error": [error] * len(ids)}
            )

    schema = f"`{id_col}` {id_type}, `{text_col}` string, `{output}` {output_type}, `{output}_error` string"
    return source.mapInPandas(work, schema)


def _keys(id_col: str, text_col: str) -> list[Column]:
    """Two hashes that stand for an id with its text, so that texts are not moved to find results again."""
    return [F.xxhash64(id_col, text_col).alias("_key"), F.xxhash64(text_col).alias("_text_key")]


def add_enrichment(df: DataFrame, enriched: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Join results back on id and text, so a repeated id neither multiplies rows nor mixes up texts."""
    results = enriched.select(*_keys(id_col, text_col), *[c for c in enriched.columns if c not in (id_col, text_col)])
    return df.select("*", *_keys(id_col, text_col)).join(results, ["_key", "_text_key"], "left").drop("_key", "_text_key")


def stored_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Outcomes of all requests written so far; no rows where none were."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def enrich_stored(
    df: DataFrame,
    id_col: str,
    text_col: str,
    fn: EnrichFn,
    output: str,
    path: str,
    output_type: str = "string",
    waves: int = 1,
    **options,
) -> DataFrame:
    """Enrich distinct texts with a memory: (id, text, output, output_error, attempts), one row per pair of ``df``.

    Every outcome is appended under ``path``, and only pairs without a result there are asked for, so a run that follows
    repeats requests that failed and pairs that are new, nothing else. Pairs go in ``waves`` of about equal size; a wave is
    in the store before the next one starts, and a lost executor or driver repeats its part of one wave at most.
    """
    spark, error = df.sparkSession, f"{output}_error"
    pairs = texts_to_enrich(df, id_col, text_col).select("*", *_keys(id_col, text_col))
    id_type = pairs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, `{text_col}` string, `{output}` {output_type}, `{error}` string, _key long, _text_key long"
    for wave in range(waves):
        own = pairs if waves == 1 else pairs.filter(F.pmod(F.xxhash64("_key", F.lit("wave")), F.lit(waves)) == wave)
        answered = stored_results(spark, path, schema).filter(F.col(error).isNull()).select("_key", "_text_key")
        todo = own.join(answered, ["_key", "_text_key"], "left_anti")
        asked = enrich(todo, id_col, text_col, fn, output, output_type, **options)
        asked.select("*", *_keys(id_col, text_col)).write.mode("append").parquet(path)
    outcome = F.struct(F.col(output), F.col(error))
    best = stored_results(spark, path, schema).groupBy("_key", "_text_key").agg(
        F.max_by(outcome, F.struct(F.col(error).isNull(), F.col(error))).alias("_best"), F.count(F.lit(1)).alias("attempts")
    )
    return pairs.join(best, ["_key", "_text_key"], "left").select(id_col, text_col, "_best.*", "attempts")


def enrich_columns(
    df: DataFrame, id_col: str, columns: Sequence[str], fn: EnrichFn, suffix: str = "_en", store=None, **options
) -> DataFrame:
    """Enrich several text columns; every column keeps its result.

    ``store`` maps (enriched frame, column) to a frame read from a table, to avoid repeated calls.
    """
    for column in columns:
        result = enrich(df, id_col, column, fn, f"{column}{suffix}", **options)
        df = add_enrichment(df, store(result, column) if store else result, id_col, column)
    return df


def enriched_count(df: DataFrame, column: str) -> DataFrame:
    """How many rows have a result that is not blank."""
    return df.agg(F.count(blank_as_null(column)).alias("enriched"), F.count(F.lit(1)).alias("rows"))


def chat_payload(batches: DataFrame, system: str, instruction: str, lead: str = " Reviews: ") -> DataFrame:
    """System and user message per batch of :func:`batch_by_count`; ``lead`` stands before the JSON array of texts."""
    def message(role, content):
        return F.struct(F.lit(role).alias("role"), content.alias("content"), F.lit(role).alias("name"))

    texts = F.to_json(F.transform("items", lambda e: e["text"]))
    user = F.concat(F.lit(instruction + lead), texts)
    return batches.withColumn("messages", F.array(message("system", F.lit(system)), message("user", user)))


def parse_scores(replies: DataFrame, reply: str = "reply") -> tuple[DataFrame, DataFrame]:
    """Scores per review from list-shaped replies, and the batches that had to be rejected.

    No reply (null, ``null`` or ``[null]``) gives null scores. A reply of the wrong length, or one that is
    no list, rejects its batch.
    """
    text = F.trim(F.col(reply))
    silent = F.col(reply).isNull() | F.regexp_replace(text, r"\s", "").isin("null", "[null]")
    scores = F.from_json(text, "array<double>", {"mode": "PERMISSIVE"})
    parsed = replies.withColumns({"_silent": silent, "_scores": scores})
    fits = F.col("_silent") | F.coalesce(F.size("_scores") == F.size("items"), F.lit(False))
    accepted = (
        parsed.filter(fits)
        .select(F.posexplode("items").alias("_pos", "_item"), "_silent", "_scores")
        .select(
            F.col("_item.id").alias("review_id"),
            F.col("_item.text").alias("review"),
            F.when(~F.col("_silent"), F.get("_scores", F.col("_pos"))).cast("float").alias("defect_score"),
        )
    )
    rejected = parsed.filter(~fits).select(
        "batch_no", F.size("items").alias("n_items"), F.size("_scores").alias("n_scores"), reply
    )
    return accepted, rejected


def embed(df: DataFrame, column: str, fn: EnrichFn, output: str = "embeddings", **options) -> DataFrame:
    """Vector per distinct value of a column, from a function that maps texts to vectors."""
    values = df.select(F.col(column)).dropna().distinct()
    keyed = values.select(F.col(column).alias("_id"), F.col(column))
    return enrich(keyed, "_id", column, fn, output, "array<double>", **options).drop("_id")
