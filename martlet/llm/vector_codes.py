"""Vector code compression: codebooks for parts of vectors, with entries found over a trie of distinct parts.

Vectors are rounded to integers and cut into parts. Distinct parts of a place, counted and sorted, are the leaves of a
trie whose levels are the dimensions of a part. Walking it depth first, the distances to all entries add up along common
prefixes, so a prefix that many parts share is paid for once; a leaf takes the nearest entry and adds its components,
weighted by its count. Tasks hold stretches of the sorted parts, that is, neighbouring subtrees; a round moves only
sums per place and entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlet.llm.common import join_classes, written
from martlet.session import shuffle_width

#: Parts of a vector, entries of a codebook, rounds of fitting, and the scale of the integers.
PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Integers beyond this saturate, so that squared distances of long parts stay inside 64 bits.
LIMIT = 1 << 26
#: Leaves of a subtree that is walked level by level; larger ones are walked child by child.
LEAVES = 1 << 16


def rounded(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Whether each vector is whole (not null, all components finite), and the floors of all components of whole ones."""
    lists = vectors.cast(pa.large_list(pa.float64()))
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)  # nulls become NaN
    owner = np.repeat(np.arange(len(lists)), np.where(lists.is_null().to_numpy(zero_copy_only=False), 0, sizes))
    good = ~lists.is_null().to_numpy(zero_copy_only=False)
    good[owner[~np.isfinite(flat)]] = False
    values = np.floor(np.clip(flat[good[owner]] * SCALE, -LIMIT, LIMIT)).astype(np.int64)
    return good, values


def packed(parts: np.ndarray) -> list[bytes]:
    """Rows of integers as bytes that sort like the rows: big-endian, the sign turned."""
    raw = (parts + (1 << 31)).astype(">u4").tobytes()
    width = 4 * parts.shape[1]
    return [raw[i : i + width] for i in range(0, len(raw), width)]


def unpacked(rows: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(rows.to_pylist()), ">u4").astype(np.int64).reshape(-1, dims) - (1 << 31)


def walk(parts: np.ndarray, entries: np.ndarray, leaves: int = LEAVES) -> tuple[np.ndarray, np.ndarray]:
    """(nearest entry, squared distance) of every row of ``parts``, which are distinct and sorted.

    Rows are the leaves of a trie in depth-first order. ``same[i]`` dimensions of row i are those of the row before. A node
    with at most ``leaves`` leaves is walked one level at a time over all its subtrees; a larger one hands the distances
    gathered so far to its children, first to last.
    """
    n, dims = parts.shape
    equal = parts[1:] == parts[:-1]
    same = np.concatenate([[0], np.where(equal.all(1), dims, equal.argmin(1))]) if n else np.zeros(0, np.int64)
    code, error = np.empty(n, np.int64), np.empty(n, np.int64)
    stack = [(0, n, 0, np.zeros(len(entries), np.int64))] if n else []
    while stack:
        begin, end, depth, gathered = stack.pop()
        if end - begin > leaves and depth < dims:
            starts = [begin, *(begin + 1 + np.flatnonzero(same[begin + 1 : end] <= depth)).tolist(), end]
            if len(starts) - 1 <= (end - begin) // 2:  # few large children: each in turn
                for i, j in zip(starts[-2::-1], starts[:0:-1]):
                    stack.append((i, j, depth + 1, gathered + (parts[i, depth] - entries[:, depth]) ** 2))
                continue
            middle = starts[len(starts) // 2]  # many small children: two halves of them
            stack += [(middle, end, depth, gathered), (begin, middle, depth, gathered)]
            continue
        node, sums = np.zeros(end - begin, np.int64), gathered[None, :]  # node of each leaf, and what each node gathered
        for level in range(depth, dims):
            opens = same[begin:end] <= level
            opens[0] = True
            first = np.flatnonzero(opens)
            sums = sums[node[first]] + (parts[begin + first, level][:, None] - entries[None, :, level]) ** 2
            node = np.cumsum(opens) - 1
        best = sums.argmin(1)
        code[begin:end], error[begin:end] = best[node], sums[np.arange(len(best)), best][node]
    return code, error


def _kept(embeddings: DataFrame, dims: int) -> DataFrame:
    """(vec_id, label, values packed) of whole vectors of ``dims`` components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, values = rounded(batch["embedding"])
            rows = batch.filter(pa.array(good))
            yield pa.RecordBatch.from_arrays([rows["vec_id"], rows["label"], pa.array(packed(values.reshape(-1, dims)), pa.binary())], ["vec_id", "label", "packed"])

    return embeddings.filter(F.size("embedding") == dims).mapInArrow(run, "vec_id long, label long, packed binary")


def _distinct_parts(kept: DataFrame, width: int) -> DataFrame:
    """(place, part, times), sorted in stretches: every distinct part of every place with its count."""
    each = kept.select(F.explode(F.array(*[F.struct(F.lit(p).alias("place"), F.substring("packed", 1 + 4 * width * p, 4 * width).alias("part")) for p in range(PARTS)])).alias("at"))
    counted = each.select("at.*").groupBy("place", "part").agg(F.count(F.lit(1)).alias("times"))
    stretches = counted.repartitionByRange(shuffle_width(kept.sparkSession), "place", "part")
    return stretches.sortWithinPartitions("place", "part")


def _sums(parts: DataFrame, books: np.ndarray, width: int) -> DataFrame:
    """(place, entry, times, sums) after walking all parts with the codebooks ``books`` (place, entry, component)."""
    shared = parts.sparkSession.sparkContext.broadcast(books)  # PARTS x ENTRIES x width numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = np.zeros((PARTS, ENTRIES), np.int64), np.zeros((PARTS, ENTRIES, width), np.int64)
        for batch in batches:
            places, times, rows = batch["place"].to_numpy(), batch["times"].to_numpy(), unpacked(batch["part"], width)
            for place in np.unique(places):
                own = places == place
                code, _ = walk(rows[own], shared.value[place])
                np.add.at(count[place], code, times[own])
                np.add.at(sums[place], code, rows[own] * times[own][:, None])
        place, entry = np.nonzero(count)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(place) + 1, dtype=np.int32) * width), pa.array(sums[place, entry].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(count[place, entry]), lists], ["place", "entry", "times", "sums"])

    made = parts.mapInArrow(run, "place int, entry int, times long, sums array<long>")
    return made.groupBy("place", "entry").agg(F.sum("times").alias("times"), F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(width)]).alias("sums"))


def _components(embeddings: DataFrame) -> int:
    """Components of the whole vector with the smallest id whose length is a multiple of PARTS; 0 if there is none."""
    fits = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & (F.size("embedding") % PARTS == 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    found = embeddings.filter(fits).agg(F.min_by(F.size("embedding"), F.struct(F.col("vec_id").isNull(), "vec_id", F.size("embedding")))).first()[0]
    return found or 0


def fit(kept: DataFrame, dims: int) -> np.ndarray:
    """Codebooks (place, entry, component) after ROUNDS rounds over all vectors; entries no part is nearest to stay.

    With fewer than ENTRIES vectors there are as many entries as vectors.
    """
    width = dims // PARTS
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "packed").limit(ENTRIES).select("packed").collect()
    books = np.stack([unpacked(pa.array([bytes(r["packed"]) for r in first]), dims)[:, p * width : (p + 1) * width] for p in range(PARTS)])
    parts = written(_distinct_parts(kept, width), "parts")
    for _ in range(ROUNDS):
        for row in _sums(parts, books, width).collect():  # PARTS x ENTRIES rows
            books[row["place"], row["entry"]] = [s // row["times"] for s in row["sums"]]
    return books


def _coded(kept: DataFrame, books: np.ndarray, dims: int) -> DataFrame:
    """(vec_id, label, code, error): all parts assigned to the entries of ``books``."""
    width, shared = dims // PARTS, kept.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = unpacked(batch["packed"], dims)
            codes, errors = np.empty((len(rows), PARTS), np.uint8), np.zeros(len(rows), np.int64)
            for place in range(PARTS):
                part = rows[:, place * width : (place + 1) * width]
                order = np.lexsort(part.T[::-1])
                part = part[order]
                opens = np.ones(len(part), bool)
                opens[1:] = (part[1:] != part[:-1]).any(1)
                leaf = np.cumsum(opens) - 1
                code, error = walk(part[opens], shared.value[place])
                codes[order, place] = code[leaf]
                errors[order] += error[leaf]
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(errors)], ["vec_id", "label", "code", "error"])

    return kept.mapInArrow(run, "vec_id long, label long, code string, error long")


def compress(embeddings: DataFrame) -> tuple[DataFrame, np.ndarray | None]:
    """(vec_id, label, code, error) of every whole vector, and the codebooks (place, entry, component).

    Needs vec_id, embedding and label; other columns do not matter, whatever their names. Vectors that are null, empty, or
    hold null or non-finite components are dropped, and so are those with another number of components than the one with
    the smallest vec_id (that number has to be a multiple of PARTS). Repeated rows count and come out as often as they are
    there; rows without a vec_id come last in the choice of first entries, equal ids go by components. Components beyond
    LIMIT / SCALE saturate. Without vectors there are no rows and no codebooks.
    """
    dims = _components(embeddings)
    if not dims:
        return embeddings.sparkSession.createDataFrame([], "vec_id long, label long, code string, error long"), None
    narrow = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("long").alias("label"))
    kept = written(_kept(narrow, dims), "vectors")
    books = fit(kept, dims)
    return _coded(kept, books, dims), books


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with label_error: the errors of all rows with the same label, nulls together."""
    names, key = coded.columns, [F.col("label").isNull().alias("_none"), F.coalesce("label", F.lit(0)).alias("_label")]
    rows = written(coded, "codes").select("*", *key)
    sums = rows.groupBy("_none", "_label").agg(F.count(F.lit(1)).alias("rows"), F.sum("error").alias("label_error"))
    return join_classes(rows, written(sums, "labels"), ["_none", "_label"]).select(*names, "label_error")


def digest(books: np.ndarray | None) -> str:
    """SHA-256 of all entries' components by part, entry and place, as decimals joined by commas."""
    return hashlib.sha256(",".join(map(str, [] if books is None else books.ravel().tolist())).encode()).hexdigest()
