"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

Features of a text are its word unigrams and bigrams, and unigrams and bigrams of the words' shapes (case, digits, other
signs, a mark for a word that repeats the one before), hashed into DIMENSIONS places. A family of n-grams has the square
roots of its relative frequencies as values, so long and short texts weigh the same. A score is the sparse dot product
of a text's features with the weights, through the logistic function.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlet.llm.common import bounded_sample, held_out, sample_hash

#: Places for hashed n-grams (a power of two), and the place of the constant.
DIMENSIONS, CONSTANT = 1 << 18, 0
#: Labelled rows at most that the classifier is fitted on, picked by a hash of the id, and passes over them.
SAMPLE_ROWS, PASSES = 8_000, 4
#: Learning rate, its offset, and the two penalties of the leader.
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.1
THRESHOLD = 0.3
_STORED_WORDS = 200_000
_SHAPES = bytes.maketrans(
    bytes(range(256)),
    bytes(
        ord("X") if 65 <= b <= 90 else ord("x") if 97 <= b <= 122 or b >= 128 else ord("9") if 48 <= b <= 57 else b
        for b in range(256)
    ),
)
_RUN = re.compile(rb"(.)\1+", re.S)
_FAMILIES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


class _Words(dict):
    """Hashes of a word and of its shape as (word, shape) in one 64-bit number."""

    def __missing__(self, word: bytes) -> int:
        shape = _RUN.sub(rb"\1", word.translate(_SHAPES))
        self[word] = both = zlib.crc32(word) << 32 | zlib.crc32(shape)
        return both


def features(text: str | None, words: _Words) -> tuple[np.ndarray, np.ndarray]:
    """Places (sorted, distinct) and values of one text; a text without words has the constant alone."""
    tokens = (text or "").encode("utf-8", "surrogatepass").split()
    if not tokens:
        return np.array([CONSTANT], np.int64), np.ones(1)
    if len(words) > _STORED_WORDS:
        words.clear()
    both = np.fromiter(map(words.__getitem__, tokens), np.uint64, len(tokens))
    word, shape = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
    again = np.zeros(len(tokens), np.uint64)
    again[1:] = word[1:] == word[:-1]
    shape = shape * np.uint64(2) + again
    places, values = [np.array([CONSTANT])], [np.ones(1)]
    for family, grams in zip(_FAMILIES, (word, word[:-1] * np.uint64(0x9E3779B1) + word[1:], shape, shape[:-1] * np.uint64(0x9E3779B1) + shape[1:])):
        if not len(grams):
            continue
        hashed = ((grams + family) * family) >> np.uint64(64 - DIMENSIONS.bit_length() + 1)
        place, count = np.unique(np.maximum(hashed.astype(np.int64), 1), return_counts=True)
        places.append(place)
        values.append(np.sqrt(count / len(grams)))
    place, value = np.concatenate(places), np.concatenate(values)
    distinct, inverse = np.unique(place, return_inverse=True)
    return distinct, np.bincount(inverse, value)


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], passes: int = PASSES) -> np.ndarray:
    """Weights after ``passes`` over (label, places, values) with per-place learning rates."""
    z, n = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS)

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) > L1, (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(ni)) / ALPHA + L2), 0.0)

    for _ in range(passes):
        for label, place, value in rows:
            zi, ni = z[place], n[place]
            w = weights(zi, ni)
            error = 1 / (1 + np.exp(-np.clip(w @ value, -35, 35))) - label
            step = error * value
            grown = ni + step * step
            z[place] = zi + step - (np.sqrt(grown) - np.sqrt(ni)) / ALPHA * w
            n[place] = grown
    return weights(z, n).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Weights learned from at most SAMPLE_ROWS labelled documents that are not held out.

    Documents with a null text count as empty; labels other than 0 and 1 are ignored, a document with both counts as 0.
    The features of the sample are made in parallel, the updates in one task, whose input the bound limits. Without
    labelled rows all weights are zero.
    """
    known = labels.filter(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    bound = bounded_sample(known, F.col("doc_id"), SAMPLE_ROWS)
    if bound is None:
        return np.zeros(DIMENSIONS, np.float32)
    picked = sample_hash(F.col("doc_id")) <= bound
    # SAMPLE_ROWS ids go to the documents, so that no other text moves.
    sample = docs.filter(picked).select("doc_id", "text").join(F.broadcast(known.filter(picked)), "doc_id").dropDuplicates()

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            made = [features(t.as_py(), words) for t in batch["text"]]
            columns = [batch["order"], batch["quality"].cast("int32")]
            columns += [pa.array([a.astype(t).tobytes() for a in side], pa.binary()) for t, side in (("<i4", [m[0] for m in made]), ("<f4", [m[1] for m in made]))]
            yield pa.RecordBatch.from_arrays(columns, ["order", "label", "places", "values"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for batch in batches for row in zip(*(batch[c].to_pylist() for c in ("order", "label", "places", "values")))]
        rows.sort(key=lambda r: (r[0], r[2]))
        weights = train([(r[1], np.frombuffer(r[2], "<i4").astype(np.int64), np.frombuffer(r[3], "<f4").astype(float)) for r in rows])
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary())], ["weights"])

    shaped = sample.select(sample_hash(F.col("doc_id")).alias("order"), "quality", "text").mapInArrow(
        featured, "order long, label int, places binary, values binary"
    )
    found = shaped.repartition(1).mapInArrow(fitted, "weights binary").first()
    return np.frombuffer(found["weights"], np.float32)


def score_documents(docs: DataFrame, weights: np.ndarray, text: str = "text", score: str = "score", predicted: str = "predicted") -> DataFrame:
    """Add ``score`` (0 to 1, higher: label 1 is likelier) and ``predicted`` (1 from THRESHOLD on) to every row.

    Null and empty texts get the score of the constant. Repeated rows score alike; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(np.asarray(weights, np.float32))  # 1 MB: DIMENSIONS numbers

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words, w = _Words(), shared.value.astype(float)
        for batch in batches:
            out = np.empty(len(batch))
            for i, t in enumerate(batch):
                place, value = features(t.as_py(), words)
                out[i] = w[place] @ value
            yield pa.array(1 / (1 + np.exp(-np.clip(out, -35, 35))))

    scored = docs.withColumn(score, F.arrow_udf(run, "double")(F.col(text)))
    return scored.withColumn(predicted, (F.col(score) >= THRESHOLD).cast("int"))
