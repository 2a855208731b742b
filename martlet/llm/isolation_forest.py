"""Quality rules judged by an isolation forest.

Every document gets statistics of plain rules (words, symbols, repeated lines and words, case). Trees split random
statistics at random values; odd documents are alone after few splits, so a short mean path is a high anomaly score.
The score from which a document is rejected is calibrated on all labelled rows. Documents beyond the base limits are
rejected anyway and take no part in fitting.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlet.llm.common import BLANKS, sample_hash, small_batches
from martlet.session import stable

SYMBOLS = "#*$%&|<>"
#: Base limits: fewest words, and the largest share in percent of words in repeated windows of three words.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: The forest: number of trees, rows a tree sees, labelled rows at most from which trees draw, seed.
TREES, TREE_ROWS, SAMPLE_ROWS, SEED = 200, 64, 20_000, 17
#: Calibration: largest share of good labelled rows that may be rejected, and what rejecting a share of good rows costs
#: against keeping the same share of bad ones.
MAX_GOOD_REJECTED, GOOD_COST = 0.01, 10.0
_BINS = 2000

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_top_word", "n_upper"]
FEATURES = ["word_length", "symbols_per_word", "top_word_share", "upper_share"]
_UPPER = string.ascii_uppercase.encode()


def repeated_words(words: list[bytes], first: dict[bytes, int]) -> tuple[int, int]:
    """Words that lie in a three-word window found twice or more, and the count of the most frequent word."""
    n = len(words)
    ids = np.fromiter(map(first.setdefault, words, range(n)), np.int64, n)
    top = int(np.bincount(ids).max()) if n else 0
    if n < 4:
        return 0, top
    pairs = ids[:-1] * n + ids[1:]
    if n >= 1 << 20:  # keep the key of a window inside 64 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    keys = pairs[:-1] * n + ids[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = twice.copy()
    covered[1:] |= twice[:-1]
    covered[2:] |= twice[:-2]
    return int(covered.sum()), top


def counts_of(text: str | None) -> tuple[int, ...]:
    """COUNTS of one text; a null text has no words."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    lines = [line for line in data.split(b"\n") if line.strip()]
    first: dict[bytes, int] = {}
    repeats, top = repeated_words(words, first)
    return (
        len(words),
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeats,
        top,
        len(data) - len(data.translate(None, _UPPER)),
    )


def _count_rows(batch: pa.Array) -> np.ndarray:
    return np.array([counts_of(t.as_py()) for t in batch], np.int64).reshape(-1, len(COUNTS))


def _counts(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in texts:
        rows = _count_rows(batch)
        yield pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(len(COUNTS))], COUNTS)


def rule_counts(text: Column) -> Column:
    """A struct of COUNTS (long) for a text column."""
    return F.arrow_udf(_counts, ", ".join(f"{c} long" for c in COUNTS))(text)


def base_failed(n_words, n_repeat_words):
    """For columns, or for arrays of numbers."""
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def _features(counts: str) -> Column:
    """FEATURES as an array, from a struct of COUNTS."""
    c = {name: F.col(f"{counts}.{name}").cast("double") for name in COUNTS}
    words, chars = (F.greatest(c[n], F.lit(1.0)) for n in ("n_words", "word_chars"))
    return F.array(c["word_chars"] / words, c["n_symbols"] / words, c["n_top_word"] / words, c["n_upper"] / chars)


def _feature_rows(counts: np.ndarray) -> np.ndarray:
    """The same FEATURES from rows of COUNTS."""
    c = dict(zip(COUNTS, counts.T.astype(float)))
    words, chars = (np.maximum(c[n], 1.0) for n in ("n_words", "word_chars"))
    return np.stack([c["word_chars"] / words, c["n_symbols"] / words, c["n_top_word"] / words, c["n_upper"] / chars], axis=1)


def _mean_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Trees in arrays of shape (trees, nodes); children of node i are 2i+1 and 2i+2. A leaf has feature -1."""

    feature: np.ndarray
    value: np.ndarray
    path: np.ndarray
    rows: int

    @classmethod
    def fit(cls, rows: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = SEED) -> Forest:
        rng, size = np.random.default_rng(seed), min(tree_rows, len(rows))
        depth = max(1, int(np.ceil(np.log2(max(size, 2)))))
        nodes = 2 ** (depth + 1) - 1
        feature, value, path = np.full((trees, nodes), -1), np.zeros((trees, nodes)), np.zeros((trees, nodes))
        for t in range(trees):
            open_ = [(0, 0, rows[rng.choice(len(rows), size, replace=False)])]
            while open_:
                node, level, own = open_.pop()
                low, high = own.min(axis=0), own.max(axis=0)
                varying = np.flatnonzero(high > low)
                if level == depth or len(own) < 2 or not len(varying):
                    path[t, node] = level + _mean_path(len(own))
                    continue
                f = rng.choice(varying)
                feature[t, node], value[t, node] = f, rng.uniform(low[f], high[f])
                left = own[:, f] < value[t, node]
                if left.all() or not left.any():
                    feature[t, node] = -1
                    path[t, node] = level + _mean_path(len(own))
                    continue
                open_ += [(2 * node + 1, level + 1, own[left]), (2 * node + 2, level + 1, own[~left])]
        return cls(feature, value, path, size)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly scores from 0 to 1, the higher the odder."""
        total = np.zeros(len(rows))
        at = np.arange(len(rows))
        for feature, value, path in zip(self.feature, self.value, self.path):
            node = np.zeros(len(rows), np.int64)
            while (inner := feature[node] >= 0).any():
                right = rows[at, np.maximum(feature[node], 0)] >= value[node]
                node = np.where(inner, 2 * node + 1 + right, node)
            total += path[node]
        return 2.0 ** (-total / len(self.feature) / max(float(_mean_path(self.rows)), 1e-9))


@dataclass
class QualityModel:
    forest: Forest | None
    threshold: float

    def score(self, counts: str) -> Column:
        forest = self.forest
        if forest is None:
            return F.lit(0.0)

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                rows = np.asarray(batch.flatten()).reshape(len(batch), -1)
                yield pa.array(forest.score(rows))

        return F.arrow_udf(run, "double")(_features(counts))


    def accepts(self, text: Column) -> Column:
        """Whether the base limits and the forest keep a text: counts, path lengths and verdict in one function."""
        forest, threshold = self.forest, self.threshold
        n_words, n_repeats = COUNTS.index("n_words"), COUNTS.index("n_repeat_words")

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                rows = _count_rows(batch)
                kept = ~base_failed(rows[:, n_words], rows[:, n_repeats])
                if forest is not None and len(rows):
                    kept &= forest.score(_feature_rows(rows)) < threshold
                yield pa.array(kept, pa.bool_())

        return F.arrow_udf(run, "boolean")(text)


def fit(counts: DataFrame, labels: DataFrame) -> QualityModel:
    """Fit on ``counts`` (doc_id, struct ``counts``) and ``labels`` (doc_id, quality 0 or 1; null or other: unlabelled).

    Trees draw from at most SAMPLE_ROWS labelled rows, picked by a hash of the id; a document with both labels counts as
    bad. The threshold is chosen over all labelled rows, through their score histogram. Without labelled rows there is
    no forest and no rejection beyond the base limits.
    """
    known = labels.filter(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    passed = ~base_failed(F.col("counts.n_words"), F.col("counts.n_repeat_words"))
    rows = counts.filter(passed).select("doc_id", "counts").join(known, "doc_id")
    sample = (
        rows.withColumn("_h", sample_hash(F.col("doc_id")))
        .orderBy("_h")
        .limit(SAMPLE_ROWS)
        .select(_features("counts").alias("features"))
        .toArrow()
    )
    if not sample.num_rows:
        return QualityModel(None, float("inf"))
    table = np.asarray(sample["features"].combine_chunks().flatten()).reshape(sample.num_rows, -1)
    model = QualityModel(Forest.fit(table), float("inf"))
    scored = rows.select("quality", F.floor(model.score("counts") * _BINS).cast("int").alias("bin"))
    histogram = np.zeros((2, _BINS + 2))
    for r in scored.groupBy("quality", "bin").count().collect():  # two rows per bin at most
        histogram[r["quality"], r["bin"]] = r["count"]
    above = histogram[:, ::-1].cumsum(axis=1)[:, ::-1]  # rows at or above the lower end of each bin
    bad, good = above / np.maximum(above[:, :1], 1)
    cost = GOOD_COST * good - bad
    cost[good > MAX_GOOD_REJECTED] = np.inf
    best = np.flatnonzero(cost == cost.min())
    model.threshold = float(best[len(best) // 2] / _BINS) if cost.min() < 0 else float("inf")
    return model


def _judge(df: DataFrame, model: QualityModel) -> DataFrame:
    failed = base_failed(F.col("counts.n_words"), F.col("counts.n_repeat_words"))
    score = F.coalesce(model.score("counts"), F.lit(0.0))
    return df.withColumn("anomaly", score).withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("anomaly") < model.threshold))


def judge_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, struct ``counts``, ``anomaly`` (double), ``base_failed`` and ``kept`` for each row of ``docs``.

    Null and empty texts fail the base limits; repeated rows are judged alike; other columns are ignored.
    """
    counts = stable(docs.select("doc_id", rule_counts(F.col("text")).alias("counts")))
    return _judge(counts, fit(counts, labels))


def keep_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns as they were; the verdict of :func:`judge_documents` for each.

    Only texts go to Python and only verdicts come back; no other column leaves Spark, and nothing is shuffled but counts.
    """
    with small_batches(docs.sparkSession):
        counts = stable(docs.select("doc_id", rule_counts(F.col("text")).alias("counts")))
        model = fit(counts, labels)
    return docs.filter(model.accepts(F.col("text")))
