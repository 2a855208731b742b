"""Benchmark decontamination: test items in an inverted index with BM25 impacts, every training passage as a query.

A passage is a window of words; windows are twice as long as the longest item of the index and overlap by half, so an
item that stands whole in a text is whole in a passage. Impacts are divided by the score that an item gets from its own
words, so one threshold means the same for all items. Block-max WAND finds every item at or above the threshold: it moves
through the postings item by item and skips what the lists' maxima, and those of their blocks, cannot lift to the threshold.
A passage that no block can lift to the threshold is not looked up at all; for that, items are ordered by length, which
keeps the maxima of blocks close. What is found is a leak if enough of the item's question and of its answer stands in
the passage.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlet.session import stable

#: BM25, the share of an item's own score that a passage has to reach, entries of a block.
K1, B, THRESHOLD, BLOCK = 1.2, 0.75, 0.7, 4
#: Words in a row that are compared, and the least share of them found for the question and for the answer.
RUN, QUESTION_SHARE, ANSWER_SHARE = 3, 0.6, 0.6
#: Bytes of items in one index; a larger benchmark is dealt over several indexes, one pass over the documents for each.
INDEX_BYTES = 500_000
#: Entries of the table of block bounds that are summed at once, and words that a task remembers; both bound memory.
_SUMMED, _STORED_WORDS = 4_000_000, 200_000
_EDGES = b".,;:!?\"'()[]{}<>|*$%&#-_/\\"
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+")


def tokens(text: str | None) -> list[bytes]:
    """Words in lower case without the signs around them."""
    return [w for w in (x.strip(_EDGES) for x in (text or "").lower().encode("utf-8", "surrogatepass").split()) if w]


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """The last sentence of an item is its answer; an item of one sentence is both."""
    sentences = [w for w in map(tokens, _SENTENCE_END.split(text)) if w]
    if len(sentences) < 2:
        whole = sentences[0] if sentences else []
        return whole, whole
    return [w for s in sentences[:-1] for w in s], sentences[-1]


def _runs(words: list) -> set:
    k = min(RUN, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if k else set()


_UNKNOWN, _SIGNS = -1, -2


class _Coded(dict):
    """Term of a word as it stands in a text: _UNKNOWN if no item has it, _SIGNS if it is made of signs alone."""

    def __init__(self, term: dict[bytes, int]):
        super().__init__()
        self.term = term

    def __missing__(self, raw: bytes) -> int:
        word = raw.strip(_EDGES)
        self[raw] = code = self.term.get(word, _UNKNOWN) if word else _SIGNS
        return code


class Statistics(NamedTuple):
    """Of the whole benchmark: items with words, their words, words of the longest, and for words the items that have them."""

    items: int
    words: int
    longest: int
    having: dict[bytes, int]


class BlockMaxIndex:
    """Index of ``items``; ``whole`` are the statistics of a benchmark of which they are a part (none: they are all of it)."""

    def __init__(self, items: list[tuple[int, str]], whole: Statistics | None = None):
        parsed = [(i, tokens(t), *map(_runs, question_and_answer(t))) for i, t in items]
        parsed = sorted((p for p in parsed if p[1]), key=lambda p: (len(p[1]), p[0] is None, p[0]))
        self.ids = [p[0] for p in parsed]
        self.parts = [p[2:] for p in parsed]
        if whole is None:
            having = Counter(w for p in parsed for w in set(p[1]))
            whole = Statistics(len(parsed), sum(len(p[1]) for p in parsed), max((len(p[1]) for p in parsed), default=0), having)
        self.longest = whole.longest
        mean = whole.words / max(whole.items, 1)
        lists: dict[bytes, list[tuple[int, float]]] = {}
        for number, (_, words, *_) in enumerate(parsed):
            for word in set(words):
                tf = words.count(word)
                lists.setdefault(word, []).append((number, tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean))))
        own = [0.0] * len(parsed)
        weight = {w: float(np.log(1 + (whole.items - whole.having[w] + 0.5) / (whole.having[w] + 0.5))) for w in lists}
        for word, postings in lists.items():
            for number, impact in postings:
                own[number] += weight[word] * impact
        self.term = {w: i for i, w in enumerate(lists)}
        self.postings = [([n for n, _ in p], [weight[w] * x / own[n] for n, x in p]) for w, p in lists.items()]
        self.most = np.array([max(x) for _, x in self.postings])
        #: For each list the largest impact and the last item of every block.
        self.blocks = [[(max(x[i : i + BLOCK]), n[min(i + BLOCK, len(n)) - 1]) for i in range(0, len(n), BLOCK)] for n, x in self.postings]

        #: Largest impact of each term on each block of items, and of no term (last row).
        self.bounds = np.zeros((len(lists) + 1, -(-max(len(parsed), 1) // BLOCK)), np.float32)
        for t, (numbers, impacts) in enumerate(self.postings):
            np.maximum.at(self.bounds[t], np.array(numbers) // BLOCK, np.array(impacts) * (1 + 1e-5))
        self.coded = _Coded(self.term)

    def state(self) -> dict:
        """All that :meth:`of` needs, in lists, dicts and arrays: a broadcast of it can be read without this package."""
        return {name: value for name, value in vars(self).items() if name != "coded"}

    @classmethod
    def of(cls, state: dict) -> BlockMaxIndex:
        index = cls.__new__(cls)
        vars(index).update(state, coded=_Coded(state["term"]))
        return index

    def search(self, terms: list[int], threshold: float = THRESHOLD) -> list[tuple[int, float]]:
        """Every (item number, score) at or above the threshold, for distinct terms."""
        threshold -= 1e-9
        out, end = [], len(self.ids)
        cursors = [[self.postings[t][0][0], 0, t, self.most[t]] for t in terms]
        while True:
            cursors.sort(key=lambda c: c[0])
            bound, pivot = 0.0, -1
            for i, c in enumerate(cursors):
                if c[0] >= end:
                    break
                bound += c[3]
                if bound >= threshold:
                    pivot = i
                    break
            if pivot < 0:
                return out
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            bound, upto = 0.0, end
            for c in cursors[: pivot + 1]:
                block = c[1] // BLOCK
                blocks = self.blocks[c[2]]
                while block < len(blocks) and blocks[block][1] < item:
                    block += 1
                if block < len(blocks):
                    bound += blocks[block][0]
                    upto = min(upto, blocks[block][1] + 1)
            if bound < threshold:
                # No item up to the end of these blocks can do it, nor before the next list begins.
                goal = max(item + 1, min([upto, *(c[0] for c in cursors[pivot + 1 : pivot + 2])]))
            else:
                goal = item
                if cursors[0][0] == item:
                    score = sum(self.postings[c[2]][1][c[1]] for c in cursors[: pivot + 1])
                    if score >= threshold:
                        out.append((item, score))
                    goal = item + 1
            for c in cursors[: pivot + 1]:
                if c[0] < goal:
                    self._advance(c, goal, end)

    def _advance(self, cursor: list, goal: int, end: int) -> None:
        numbers, blocks = self.postings[cursor[2]][0], self.blocks[cursor[2]]
        at = cursor[1]
        while at < len(numbers) and blocks[at // BLOCK][1] < goal:
            at = (at // BLOCK + 1) * BLOCK
        while at < len(numbers) and numbers[at] < goal:
            at += 1
        cursor[0], cursor[1] = (numbers[at] if at < len(numbers) else end), at

    def leaks(self, text: str | None) -> list[tuple[int, float]]:
        """(item id, best score) of every item whose question and answer stand in a passage of the text."""
        if not self.longest or not text:
            return []
        if len(self.coded) > _STORED_WORDS:
            self.coded.clear()
        raw = text.lower().encode("utf-8", "surrogatepass").split()
        terms = np.fromiter(map(self.coded.__getitem__, raw), np.int64, len(raw))
        terms = terms[terms != _SIGNS]
        places = np.flatnonzero(terms != _UNKNOWN)
        if not len(places):
            return []
        # Distinct (passage, term): a word is in the passage that begins in its stretch and in the one before.
        last = max(0, -(-len(terms) // self.longest) - 2)
        stretch, n = places // self.longest, len(self.bounds)
        passages = np.concatenate([np.minimum(stretch, last), np.maximum(stretch - 1, 0)])
        keys = np.unique(passages * n + np.tile(terms[places], 2))
        passage, known = keys // n, keys % n
        starts = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
        ends, words, best = np.append(starts[1:], len(keys)), None, {}
        step = max(1, _SUMMED // self.bounds.shape[1])
        i = 0
        while i < len(starts):  # some passages at once
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + step, side="right")))
            own = known[starts[i] : ends[j - 1]]
            reach = np.add.reduceat(self.bounds[own], starts[i:j] - starts[i], axis=0).max(axis=1)
            for p in (i + np.flatnonzero(reach >= THRESHOLD)).tolist():
                found = self.search(known[starts[p] : ends[p]].tolist())
                if not found:
                    continue
                words = tokens(text) if words is None else words
                start = int(passage[starts[p]]) * self.longest
                span = words[start : start + 2 * self.longest]
                runs = {k: {tuple(span[q : q + k]) for q in range(len(span) - k + 1)} for k in range(1, RUN + 1)}
                for number, score in found:
                    if all(len(part & runs[len(next(iter(part)))]) >= share * len(part) for part, share in zip(self.parts[number], (QUESTION_SHARE, ANSWER_SHARE))):
                        best[number] = max(score, best.get(number, 0.0))
            i = j
        return [(self.ids[n], s) for n, s in sorted(best.items())]


def _item_words(items: DataFrame) -> DataFrame:
    """(item_id, text, words) of the items that have words; in a list each word stands as often as in the item."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([tokens(t.as_py()) for t in batch], pa.list_(pa.binary()))

    return items.select("item_id", "text", F.arrow_udf(run, "array<binary>")("text").alias("words")).filter(F.size("words") > 0)


def _indexes(benchmark: DataFrame) -> Iterator[BlockMaxIndex]:
    """Indexes of about INDEX_BYTES of items each; items are dealt by a hash of their text.

    All of them use the statistics of the whole benchmark, so what an item scores does not depend on how many there are.
    """
    items = benchmark.filter(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    items = stable(_item_words(items))
    size = F.size("words")
    whole = items.agg(F.count(F.lit(1)).alias("items"), F.sum(size).alias("words"), F.max(size).alias("longest"), F.sum(F.octet_length("text")).alias("bytes")).first()
    if not whole["items"]:
        return
    shards = 1 + int(whole["bytes"]) // INDEX_BYTES
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("text"), F.lit(shards)))
    spread = dealt.select("shard", F.explode(F.array_distinct("words")).alias("word"))
    having = spread.groupBy("shard", "word").count()
    having = stable(having.join(having.groupBy("word").agg(F.sum("count").alias("having")), "word"))
    for shard in range(shards):
        own = dealt.filter(F.col("shard") == shard).select("item_id", "text").collect()
        known = {bytes(r["word"]): r["having"] for r in having.filter(F.col("shard") == shard).select("word", "having").collect()}
        yield BlockMaxIndex([tuple(r) for r in own], Statistics(whole["items"], whole["words"], whole["longest"], known))


def _with_leaks(docs: DataFrame, index: BlockMaxIndex, name: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index.state())  # made of INDEX_BYTES of items at most

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64())]))
        own = BlockMaxIndex.of(shared.value)
        for batch in batches:
            yield pa.array([[{"item_id": i, "score": s} for i, s in own.leaks(t.as_py())] for t in batch], kind)

    return docs.withColumn(name, F.arrow_udf(run, "array<struct<item_id: bigint, score: double>>")(F.col("text")))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, score): every benchmark item that stands in a document, with the best score of a passage.

    Null and empty texts have no passages, items without words are in no index; without items there are no leaks. Repeated rows of a document give one row
    for each item; rows with a null doc_id count as one document. Items with a null id are found as such.
    """
    narrow, out = docs.select("doc_id", "text"), None
    for index in _indexes(benchmark):
        found = _with_leaks(narrow, index, "_leaks").select("doc_id", F.explode("_leaks").alias("leak"))
        part = found.groupBy("doc_id", F.col("leak.item_id").alias("item_id")).agg(F.max("leak.score").alias("score"))
        out = part if out is None else out.union(part)
    if out is None:
        return narrow.filter(F.lit(False)).select("doc_id", F.lit(None).cast("long").alias("item_id"), F.lit(None).cast("double").alias("score"))
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no item stands, with their columns as they were."""
    names = docs.columns
    for index in _indexes(benchmark):
        packed = docs.select(F.struct(*names).alias("row"), "text")
        docs = _with_leaks(packed, index, "_leaks").filter(F.size("_leaks") == 0).select("row.*")
    return docs
