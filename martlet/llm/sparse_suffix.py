"""Passages of LENGTH words or more that stand in several documents, found at sparse suffixes.

A suffix is kept where its first GRAM words are the minimiser (smallest hash) of some window of LENGTH words; equal windows
have equal minimisers, so every repeated passage shares a kept suffix. A suffix stands for the windows that chose it, a
stretch of words to its left and right. Suffixes are brought into order by their first words and by that stretch: equal
neighbours from different documents repeat the whole stretch. Where suffixes begin alike but their stretches differ, at
the edges of passages and around edits, the match is extended to both sides window by window. What is found in
a document grows together to maximal passages.

Comparing only neighbours of an order by what follows is not enough: in a family of near copies the neighbour with the
longest common continuation may differ in front, while another member matches on both sides. Windows are therefore compared
through hashes of their content, which finds all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlet.llm.common import small_batches, written
from martlet.llm.shingles import mixed, parts, window_hashes, word_hashes

#: Least words of a passage, and words that choose a suffix.
LENGTH, GRAM = 50, 10
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = np.array([pow(_BASE, i, 1 << 64) for i in range(2 * LENGTH)], np.uint64)


class _Text:
    """Hashes of the words of some texts, and of any stretch of less than 2 LENGTH of them."""

    def __init__(self, texts: pa.Array):
        self.words, self.begins = word_hashes(texts, lower=False)
        # Sums of word * base^-place would need division; a polynomial is built up block by block instead.
        self.prefix = np.zeros(len(self.words) + 1, np.uint64)
        inverse = np.uint64(pow(_BASE, -1, 1 << 64))
        place = np.cumprod(np.full(len(self.words), inverse, np.uint64)) if len(self.words) else self.words
        self.prefix[1:] = np.cumsum(self.words * place)
        self.power = np.cumprod(np.full(len(self.words) + 1, np.uint64(_BASE), np.uint64))

    def stretch(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of words start..end-1, whatever stands around them."""
        return mixed((self.prefix[end] - self.prefix[start]) * self.power[start] + (end - start).astype(np.uint64))

    def suffixes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, place of the minimiser and first and last window (places in all words) of every kept suffix."""
        windows = len(self.words) - LENGTH + 1
        if windows <= 0:
            return (np.zeros(0, np.int64),) * 4
        grams = window_hashes(self.words, GRAM)
        width = LENGTH - GRAM + 1
        starts = np.arange(windows)
        text = np.searchsorted(self.begins, starts, side="right") - 1
        inside = starts + LENGTH <= self.begins[text + 1]
        starts, text = starts[inside], text[inside]
        chosen = np.empty(len(starts), np.int64)
        views = np.lib.stride_tricks.sliding_window_view(grams, width)
        for i in range(0, len(starts), 100_000):
            own = starts[i : i + 100_000]
            chosen[i : i + 100_000] = own + views[own].argmin(axis=1)
        first = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1])])) if len(starts) else np.zeros(0, np.int64)
        last = np.append(first[1:], len(starts)) - 1 if len(first) else first
        self.grams = grams
        return text[first], chosen[first], starts[first], starts[last]


def _suffix_rows(docs: DataFrame) -> DataFrame:
    """(doc, key, span, place, windows): each kept suffix with hashes of its first words and of its stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in parts(batch["text"]):
                own = _Text(part)
                text, place, first, last = own.suffixes()
                if len(text):
                    doc = batch["doc_id"].slice(at, len(part)).take(pa.array(text))
                    columns = [doc, own.grams[place].view(np.int64), own.stretch(first, last + LENGTH).view(np.int64), first - own.begins[text], last - first + 1]
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], ["doc", "key", "span", "place", "windows"])

    return docs.mapInArrow(run, "doc long, key long, span long, place long, windows long")


def _window_rows(docs: DataFrame) -> DataFrame:
    """(doc, place, window) hashes of the windows named in ``open`` (structs of place and number) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in parts(batch["text"]):
                own = _Text(part)
                sizes = np.diff(own.begins)
                for i, stretches in enumerate(batch["open"].slice(at, len(part)).to_pylist()):
                    spots = np.concatenate([np.arange(s["place"], s["place"] + s["windows"]) for s in stretches])
                    spots = np.unique(spots[spots + LENGTH <= sizes[i]])
                    start = own.begins[i] + spots
                    hashes = own.stretch(start, start + LENGTH).view(np.int64)
                    doc = pa.array([batch["doc_id"][at + i].as_py()] * len(spots), pa.int64())
                    yield pa.RecordBatch.from_arrays([doc, pa.array(spots), pa.array(hashes)], ["doc", "place", "window"])

    return docs.mapInArrow(run, "doc long, place long, window long")


def _in_two(rows: DataFrame, *by: str) -> DataFrame:
    """The values that more than one document has; sums with map-side combine, so a hot value is no hot task."""
    return rows.groupBy(*by).agg(F.min("doc").alias("_a"), F.max("doc").alias("_b")).filter("_a < _b").select(*by)


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, passages, n_repeated): for each document with a passage of LENGTH words or more that another one has too.

    ``passages`` is a sorted array of (start, end) in words, the end exclusive; passages that touch or overlap are one.
    Words are what stands between blanks, upper and lower case differ. Texts with fewer words than LENGTH, null and empty
    texts have none. Rows with the same doc_id are one document, a null doc_id is none. Content is compared by 64-bit hashes.
    """
    docs = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with small_batches(docs.sparkSession):
        suffixes = written(_suffix_rows(docs), "suffixes")
        whole = suffixes.join(_in_two(suffixes, "key", "span"), ["key", "span"], "left_semi")
        # Suffixes that begin alike in several documents while some stretch of theirs has no partner.
        stretches = suffixes.groupBy("key", "span").agg(F.min("doc").alias("a"), F.max("doc").alias("b"))
        keys = stretches.groupBy("key").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.max((F.col("a") == F.col("b")).cast("int")).alias("single"))
        open_keys = keys.filter("a < b and single = 1").select("key")
        # Of a stretch that documents share, its first and last document stand for all.
        edge = suffixes.join(open_keys, "key", "left_semi").join(stretches, ["key", "span"]).filter("doc = a or doc = b")
        of_doc = edge.groupBy("doc").agg(F.collect_list(F.struct("place", "windows")).alias("open"))
        asked = docs.join(of_doc.withColumnRenamed("doc", "doc_id"), "doc_id")
        windows = written(_window_rows(asked.select("doc_id", "text", "open")), "windows")
    edges = windows.join(_in_two(windows, "window"), "window", "left_semi")
    found = whole.select("doc", F.col("place").alias("start"), (F.col("place") + F.col("windows") - 1 + LENGTH).alias("end")).union(
        edges.select("doc", F.col("place"), F.col("place") + LENGTH)
    )
    spans = F.array_sort(F.collect_set(F.struct("start", "end")))  # at most the places of one text
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def grow(acc, s):
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (s["start"] <= last["end"]), joined).otherwise(F.array_append(acc, s))

    merged = F.aggregate("_spans", empty, grow)
    out = found.groupBy(F.col("doc").alias("doc_id")).agg(spans.alias("_spans")).select("doc_id", merged.alias("passages"))
    return out.withColumn("n_repeated", F.aggregate("passages", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]))
