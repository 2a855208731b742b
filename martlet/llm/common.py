"""Helpers shared by the text operators."""

from __future__ import annotations

import ctypes
import sys
import types
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martlet.session import ensure_checkpoint_dir, tidied

#: Bytes that end a word: space, and tab to carriage return. ``bytes.split()`` splits at exactly these.
BLANKS = " \t\n\r\x0b\x0c"


def default_tokenizer() -> str:
    """Path of the byte-level vocabulary that queries and pipeline use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared checkpoint folder and read again: like a checkpoint, but compressed."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made and that nothing reads any more.

    The shuffles of the jobs that made and read them go too: Spark deletes those of plans that are garbage, which a driver
    with memory left does not collect by itself.
    """
    sc = tables[0].sparkSession.sparkContext
    for folder in {f.rsplit("/", 1)[0] for df in tables for f in df.inputFiles()}:
        path = sc._jvm.org.apache.hadoop.fs.Path(sc._jvm.java.net.URI(folder))
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    tidied(tables[0].sparkSession)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a few numbers that may be sent to every task.
SENT = 100_000


def join_counted(rows: DataFrame, some: DataFrame, keys: list[str], most: int = SENT) -> DataFrame:
    """``rows`` joined with ``some``, a stored table, which is broadcast if it has at most ``most`` rows; else both go by key.

    Spark takes files for their compressed size and an explode for its input, and keeps to a broadcast once planned.
    """
    if some.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(some), keys)
    return rows.hint("merge").join(some, keys)


def join_classes(rows: DataFrame, classes: DataFrame, keys: list[str], share: int = 1000) -> DataFrame:
    """``rows`` with the other columns of ``classes``, one row a class with its number of members in ``rows``.

    Classes that hold more than one in ``share`` of all members are joined by broadcast, so there are at most ``share`` of
    them; the others meet by key, by broadcast only if there are few. So no large class is collected in one task. Keys are
    not null.
    """
    total, count = classes.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.count(F.lit(1))).first()
    values = [c for c in classes.columns if c not in keys and c != "rows"]
    hot = classes.filter(F.col("rows") > total // share).select(*keys, F.lit(True).alias("_hot"), *[F.col(v).alias(f"_{v}") for v in values])
    spread = rows.join(F.broadcast(hot), keys, "left")
    at_once = spread.filter("_hot").select(*rows.columns, *[F.col(f"_{v}").alias(v) for v in values])
    cold = spread.filter("_hot is null").select(*rows.columns)
    rest = (cold.hint("merge") if count > SENT else cold).join(classes.drop("rows"), keys)
    return at_once.unionByName(rest)


def held_out(doc_id: Column) -> Column:
    """Rows that no classifier may learn from: crc32 of the id as text is divisible by 5. A null id is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def worker_state(name: str) -> dict:
    """A dict that outlives the task in a reused Python worker; functions themselves arrive anew with every task."""
    module = sys.modules.setdefault("_martlet_worker_state", types.ModuleType("_martlet_worker_state"))
    return module.__dict__.setdefault(name, {})


def give_back() -> None:
    """Return the memory that a task freed to the system; a reused Python worker would keep it through later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


#: Settings for Arrow batches of a few MB.
_SMALL = {"spark.sql.execution.arrow.maxBytesPerBatch": "4194304", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


def keep_batches_small(spark: SparkSession) -> None:
    """Arrow batches of a few MB from now on, for results that are only planned when the caller writes them."""
    for name, value in _SMALL.items():
        spark.conf.set(name, value)


@contextmanager
def small_batches(spark: SparkSession):
    """Arrow batches of a few MB for jobs that run inside, so that long texts do not add up in a worker."""
    before = {name: spark.conf.get(name, None) for name in _SMALL}
    keep_batches_small(spark)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def bounded_sample(ids: DataFrame, key: Column, rows: int) -> int | None:
    """The hash below or at which about ``rows`` rows of ``ids`` lie: the rows-th smallest hash of ``key``, None for no rows.

    One number per row goes through the top-n of Spark; the caller filters the wide table by the returned bound.
    """
    found = (
        ids.select(sample_hash(key).alias("_h"))
        .orderBy("_h")
        .limit(rows)
        .agg(F.max("_h").alias("_h"))
        .first()
    )
    return found["_h"]


def sample_hash(key: Column) -> Column:
    """A non-negative hash that deals rows at random and alike in every run."""
    return F.xxhash64(key, F.lit("sample")).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))
