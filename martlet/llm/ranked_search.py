"""Ranked lexical search reversed: documents stream through an inverted index of the items that are asked for.

The index over the items' terms is broadcast, in shards of bounded size; texts are cut into terms once, and of a document
only the counts of terms that some item has go on. A task runs the counts of its documents through the index, keeps the
best documents of every item in a bounded heap and returns the heaps, which are merged in two steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from martlet.llm.common import small_batches, written
from martlet.llm.shingles import parts

#: Documents kept for an item.
TOP = 10
#: Scores: thousandths of the saturation, and percent by which the length of a text counts.
SATURATION, LENGTH_PERCENT = 8, 75
#: The broadcast index: (item, term) entries of a shard at most (24 bytes each), and bits of the table that tells terms
#: which no item has (2 MB, whatever the number of items).
POSTINGS, TABLE_BITS = 2_000_000, 1 << 24
#: Cells of (document, item) and entries that a task adds up at once; heaps are merged in this many lanes first.
CELLS, LANES = 2_000_000, 32
#: Bytes that belong to terms: digits, letters (A-Z become a-z), and all of characters beyond ASCII; others part terms.
_BYTES = np.full(256, 32, np.uint8)
_BYTES[48:58] = np.arange(48, 58)
_BYTES[65:91] = np.arange(97, 123)
_BYTES[97:123] = np.arange(97, 123)
_BYTES[128:] = np.arange(128, 256)


def term_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the terms of all texts in order, and where the terms of each text begin and end."""
    strings = pa.concat_arrays([texts.fill_null("").cast(pa.large_string())])
    _, offsets, data = strings.buffers()
    plain = pa.py_buffer(_BYTES[np.frombuffer(data, np.uint8)]) if data and data.size else pa.py_buffer(b"")
    lists = pc.split_pattern(pa.LargeStringArray.from_buffers(len(strings), offsets, plain, offset=strings.offset), " ")
    words = lists.flatten()
    full = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    coded = words.dictionary_encode()
    known = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary)).view(np.int64)
    upto = np.concatenate([[0], np.cumsum(full)])
    starts = lists.offsets.to_numpy().astype(np.int64)
    return known[coded.indices.to_numpy()[full]] if len(words) else np.zeros(0, np.int64), upto[starts - starts[0]]


def counts_of(texts: pa.Array, wanted: np.ndarray | None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per slice of ``texts``: (first text, terms of each text, ends of each text's entries, terms, counts).

    Of the entries only those stay whose bit is set in ``wanted``; the number of terms counts all.
    """
    for start, some in parts(texts):
        hashes, begins = term_hashes(some)
        total = np.diff(begins)
        owner = np.repeat(np.arange(len(some)), total)
        if wanted is not None:
            at = hashes.view(np.uint64) % np.uint64(TABLE_BITS)
            kept = (wanted[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
            hashes, owner = hashes[kept], owner[kept]
        order = np.lexsort((hashes, owner))
        hashes, owner = hashes[order], owner[order]
        first = np.ones(len(hashes), bool)
        first[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        places = np.flatnonzero(first)
        counts = np.diff(np.append(places, len(hashes)))
        ends = np.cumsum(np.bincount(owner[places], minlength=len(some)))
        yield start, total, ends, hashes[places], counts


def _counted(df: DataFrame, key: str, wanted=None) -> DataFrame:
    """(key, n_terms, terms, counts) of every row whose text has a term."""
    schema = f"{key} long, n_terms long, terms array<long>, counts array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None if wanted is None else np.frombuffer(wanted.value, np.uint8)
        for batch in batches:
            for start, total, ends, terms, counts in counts_of(batch["text"], table):
                offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int64))) for x in (terms, counts)]
                made = pa.RecordBatch.from_arrays([batch[key].slice(start, len(total)), pa.array(total.astype(np.int64)), *lists], [key, "n_terms", "terms", "counts"])
                yield made.filter(pc.greater(made["n_terms"], 0))

    return df.select(F.col(key).cast("long").alias(key), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def _table_of(items: DataFrame) -> bytes:
    """Bits of all items' terms, made in tasks as numbers of words of 64 bits; at most TABLE_BITS / 64 rows come back."""
    at = F.pmod(F.expr(f"term & {TABLE_BITS - 1}"), F.lit(TABLE_BITS))
    words = items.select(at.alias("at")).groupBy(F.expr("at div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits"))
    table = np.zeros(TABLE_BITS // 64, np.int64)
    found = words.toArrow()
    table[found["word"].to_numpy()] = found["bits"].to_numpy()
    return table.astype("<i8").tobytes()


class Heaps:
    """The best TOP documents of every item, by score and then by id; documents without an id come last."""

    def __init__(self, items: int):
        self.items, self.least = items, np.ones(items, np.int64)
        self.item, self.score, self.doc, self.none = (np.zeros(0, t) for t in (np.int64, np.int64, np.int64, bool))

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray, none: np.ndarray) -> None:
        item, score, doc, none = (np.concatenate(x) for x in ((self.item, item), (self.score, score), (self.doc, doc), (self.none, none)))
        order = np.lexsort((doc, none, -score, item))
        item = item[order]
        starts = np.searchsorted(item, np.arange(self.items))
        kept = np.arange(len(item)) - starts[item] < TOP
        order = order[kept]
        self.item, self.score, self.doc, self.none = item[kept], score[order], doc[order], none[order]
        last = np.searchsorted(self.item, np.arange(self.items), side="right") - 1
        full = np.bincount(self.item, minlength=self.items) == TOP
        self.least[full] = self.score[last[full]]


class Index:
    """Postings of a shard of items: for each term its weight and the items that have it, with their counts."""

    def __init__(self, term: np.ndarray, item: np.ndarray, times: np.ndarray, weight: np.ndarray):
        order = np.argsort(term, kind="stable")
        self.item, self.times = item[order], times[order]
        self.terms, self.begin, self.length = np.unique(term[order], return_index=True, return_counts=True)
        self.weight = weight[order][self.begin]

    def scores(self, items: int, m: np.ndarray, owner: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Scores of documents (rows) for items (columns); ``owner`` tells whose term an entry is."""
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        known = self.terms[at] == terms
        at, owner, counts = at[known], owner[known], counts[known]
        value = self.weight[at] * ((1_000_000_000 * counts) // (1000 * counts + SATURATION * m[owner]))
        out = np.zeros(len(m) * items, np.int64)
        length = self.length[at]
        upto = np.cumsum(length)
        cuts = [0, *(1 + np.flatnonzero(np.diff(upto // CELLS))).tolist(), len(at)]
        for i, j in zip(cuts, cuts[1:]):
            entry = np.repeat(np.arange(i, j), length[i:j])
            place = np.arange(len(entry)) - np.repeat(upto[i:j] - length[i:j] - (upto[i - 1] if i else 0), length[i:j]) + self.begin[at][entry]
            np.add.at(out, owner[entry] * items + self.item[place], value[entry] * self.times[place])
        return out.reshape(len(m), items)


def best_of(index: Index, items: int, batches: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> Heaps:
    """Heaps after all batches of (doc, doc is null, m, offsets, terms, counts)."""
    heaps, most = Heaps(items), 32  # the first documents fill the heaps, later blocks bring few candidates
    for doc, none, m, offsets, terms, counts in batches:
        i = 0
        while i < len(doc):
            j = min(len(doc), i + most)
            j = max(i + 1, min(j, int(np.searchsorted(offsets, offsets[i] + CELLS, side="right")) - 1))
            span = slice(offsets[i], offsets[j])
            owner = np.repeat(np.arange(j - i), np.diff(offsets[i : j + 1]))
            found = index.scores(items, m[i:j], owner, terms[span], counts[span])
            row, item = np.nonzero(found >= heaps.least)
            heaps.add(item, found[row, item], doc[i:j][row], none[i:j][row])
            i, most = j, max(1, min(2 * most, CELLS // items))
    return heaps


def _heaps(counted: DataFrame, postings: DataFrame) -> DataFrame:
    """(item_id, mark, doc_id, score): the heaps of every task for the items of one shard."""
    got = postings.toArrow()  # POSTINGS entries, or one item's, at most
    if not got.num_rows:
        return counted.sparkSession.createDataFrame([], "item_id long, mark long, doc_id long, score long")
    keys = got.select(["item_id", "mark"]).group_by(["item_id", "mark"]).aggregate([])
    number = {key: i for i, key in enumerate(zip(keys["item_id"].to_pylist(), keys["mark"].to_pylist()))}
    own = np.fromiter((number[key] for key in zip(got["item_id"].to_pylist(), got["mark"].to_pylist())), np.int64, got.num_rows)
    arrays = [got["term"].to_numpy(), own, got["times"].to_numpy(), got["weight"].to_numpy()]
    names = list(number)
    shared = counted.sparkSession.sparkContext.broadcast((arrays, [n[0] for n in names], [n[1] for n in names]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (term, item, times, weight), ids, marks = shared.value

        def plain():
            for b in batches:
                offsets = b["terms"].offsets.to_numpy().astype(np.int64)
                terms, counts = (b[c].values.to_numpy() for c in ("terms", "counts"))
                yield b["doc_id"].fill_null(0).to_numpy(), b["doc_id"].is_null().to_numpy(zero_copy_only=False), b["m"].to_numpy(), offsets, terms, counts

        heaps = best_of(Index(term, item, times, weight), len(ids), plain())
        where = pa.array(heaps.item)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()).take(where), pa.array(marks, pa.int64()).take(where), pa.array(heaps.doc, mask=heaps.none), pa.array(heaps.score)],
            ["item_id", "mark", "doc_id", "score"],
        )

    return counted.select("doc_id", "m", "terms", "counts").mapInArrow(run, "item_id long, mark long, doc_id long, score long")


def ranked_documents(docs: DataFrame, items: DataFrame, postings: int = POSTINGS) -> DataFrame:
    """(item_id, rank, doc_id, score): the TOP documents of ``docs`` for each row of ``items``, best first.

    Needs doc_id and text, item_id and text; other columns do not matter, whatever their names. Null, empty and blank texts
    have no terms: such documents count nowhere, such items find nothing. Equal scores go by doc_id, rows without one last.
    Repeated documents each hold a rank; repeated items count once, and items with one id and different texts are ranked
    apart. Very long texts are cut into terms a few at a time. Empty tables give no rows. Terms are told apart by 64 bits.
    """
    asked = _counted(items.select("item_id", F.col("text").cast("string").alias("text")).distinct(), "item_id").select(
        "item_id", F.xxhash64("terms", "counts").alias("mark"), F.explode(F.arrays_zip("terms", "counts")).alias("entry")
    )
    asked = written(asked.select("item_id", "mark", F.col("entry.terms").alias("term"), F.col("entry.counts").alias("times")), "asked")
    table = docs.sparkSession.sparkContext.broadcast(_table_of(asked))
    with small_batches(docs.sparkSession):
        counted = written(_counted(docs, "doc_id", table), "counted")
    size = counted.agg(F.count(F.lit(1)).alias("n"), F.sum("n_terms").alias("l")).first()
    n, length = size["n"], size["l"] or 1
    holding = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2 * n + 2).cast("double") / (2 * F.coalesce("df", F.lit(0)) + 1)))
    weighed = asked.join(holding, "term", "left").select("item_id", "mark", "term", "times", weight.cast("long").alias("weight"))
    weighed = written(weighed, "weighed")
    counted = counted.filter(F.size("terms") > 0).withColumn("m", F.expr(f"{100 - LENGTH_PERCENT}L + ({LENGTH_PERCENT}L * n_terms * {n}L) div {length}L"))
    shards = 1 + weighed.count() // postings
    found = None
    for shard in range(shards):
        own = weighed.filter(F.pmod("mark", F.lit(shards)) == shard) if shards > 1 else weighed
        heaps = _heaps(counted, own)
        found = heaps if found is None else found.unionByName(heaps)
    best = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    lanes = Window.partitionBy("item_id", "mark", "lane").orderBy(*best)
    whole = Window.partitionBy("item_id", "mark").orderBy(*best)
    first = found.withColumn("lane", F.pmod(F.xxhash64("doc_id"), F.lit(LANES))).withColumn("rank", F.row_number().over(lanes)).filter(F.col("rank") <= TOP)
    return first.withColumn("rank", F.row_number().over(whole)).filter(F.col("rank") <= TOP).select("item_id", "rank", "doc_id", "score")
