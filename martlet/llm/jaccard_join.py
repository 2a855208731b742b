"""Exact similarity join of documents on word shingles, with set-relation skipping.

Shingles are hashed. Tasks deal them out to buckets by hash, as packed arrays, and each bucket counts in how many sets a
shingle is. Only shared shingles go on: a set's shared shingles in order of rarity are its index prefix, and a set whose
prefix holds none cannot have a partner. An index list is one shingle's sets, in blocks by set size; blocks out of reach
by size are skipped, and entries whose position leaves too few shingles behind are skipped too.

A set is first compared with one representative of each of its lists. Sets that are linked with it are settled together. For
the members behind a representative v an upper bound follows from its computed answers (overlap of x and y <= overlap of v
and y + shingles of x outside v). Members of different groups meet twice: first within small parts of their lists, which puts
most of a large group together, then those outside a list's largest group meet the rest of it, where blocks, positions,
sketches and that bound leave the link possible.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlet.llm.common import give_back, small_batches
from martlet.llm.components import components
from martlet.llm.shingles import parts, shingle_sets
from martlet.session import stable, tidied

#: Words of a shingle, and the similarity in percent from which two sets are linked.
WORDS, PERCENT = 5, 75
#: Shingles that a task gathers before it deals them out, and shingles of a bucket; both bound memory.
DEALT, BUCKET = 500_000, 1_000_000
#: Entries of a list that meet each other before the whole list does, on average, and longs of a set's sketch.
MEETING, SKETCH = 8, 8
#: Links that one task settles, so that the driver has few jobs to plan and to remember.
LINKS_AT_ONCE = 500_000
_PACKED = 5  # bytes kept of a shingle inside its bucket


def _dealt(batches: Iterator[pa.Array], k: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Lists of (row, distinct shingles) of about DEALT shingles."""
    held, size, row = [], 0, 0
    for batch in batches:
        for _, part in parts(batch):
            for own in shingle_sets(part, k):
                held.append((row, own))
                row, size = row + 1, size + len(own)
                if size >= DEALT or len(held) >= 60_000:  # by rows alone, however they come in batches
                    yield held
                    held, size = [], 0
    if held:
        yield held
    give_back()


def _set_ids(held: list[tuple[int, np.ndarray]]) -> list[int]:
    """Set id of each entry: 63 bits of a hash of its shingles alone, so it is the same however rows are dealt to tasks, and
    equal sets share it. Empty sets have id -1."""
    return [xxhash.xxh3_64_intdigest(own.tobytes()) >> 1 if len(own) else -1 for _, own in held]


def set_table(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """(doc_id, sid, n): set id and size of each row's shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []

        def texts():
            for batch in batches:
                ids.extend(batch["doc_id"].to_pylist())
                yield batch["text"]

        for held in _dealt(texts(), k):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[: len(held)], pa.int64()),
                    pa.array(_set_ids(held), pa.int64()),
                    pa.array([len(own) for _, own in held], pa.int64()),
                ],
                ["doc_id", "sid", "n"],
            )
            del ids[: len(held)]

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, sid long, n long")


def _bucket_rows(docs: DataFrame, buckets: int, k: int) -> DataFrame:
    """Shingles of all sets in packed arrays by set: (bucket, shingles, set ids, number of shingles of each set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _dealt((batch["text"] for batch in batches), k):
            own = {sid: row[1] for sid, row in zip(_set_ids(held), held) if sid >= 0}
            if not own:
                continue
            shingles = np.concatenate(list(own.values()))
            sids = np.repeat(np.array(list(own), np.int64), [len(v) for v in own.values()])
            bucket = (shingles % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            kept = (shingles // np.uint64(buckets)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_PACKED][order]
            sids, ends = sids[order], np.cumsum(np.bincount(bucket, minlength=buckets))
            starts = ends - np.bincount(bucket, minlength=buckets)
            full = np.flatnonzero(ends > starts).tolist()
            for i in range(0, len(full), 256):
                some = full[i : i + 256]
                heads, lengths = zip(*(_runs_of(sids[starts[b] : ends[b]]) for b in some))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(some, pa.int64()),
                        pa.array([kept[starts[b] : ends[b]].tobytes() for b in some], pa.binary()),
                        pa.array([x.tobytes() for x in heads], pa.binary()),
                        pa.array([x.tobytes() for x in lengths], pa.binary()),
                    ],
                    ["bucket", "shingles", "sids", "lengths"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "bucket long, shingles binary, sids binary, lengths binary")


def _runs_of(sids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Set ids of adjacent equal entries, and how many each has."""
    starts = np.flatnonzero(np.concatenate([[True], sids[1:] != sids[:-1]]))
    return sids[starts], np.diff(np.append(starts, len(sids))).astype(np.uint32)


def _unpack(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Shingles (without their bucket) and set ids of a bucket's rows, each pair once."""
    flat = np.frombuffer(b"".join(table["shingles"].to_pylist()), np.uint8).reshape(-1, _PACKED)
    wide = np.zeros((len(flat), 8), np.uint8)
    wide[:, :_PACKED] = flat
    sids = np.frombuffer(b"".join(table["sids"].to_pylist()), np.int64)
    sids = np.repeat(sids, np.frombuffer(b"".join(table["lengths"].to_pylist()), np.uint32))
    shingles = wide.view("<u8").ravel()
    order = np.lexsort((sids, shingles))
    shingles, sids = shingles[order], sids[order]
    new = np.concatenate([[True], (shingles[1:] != shingles[:-1]) | (sids[1:] != sids[:-1])])  # copies of a set in several tasks
    return shingles[new], sids[new]


def _shared_rows(rows: DataFrame, buckets: int, groups: int) -> DataFrame:
    """Shingles that are in two sets or more, in packed arrays by group of sets: (part, sids, shingles, counts up to 255)."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        shingles, sids = _unpack(table)
        starts = np.flatnonzero(np.concatenate([[True], shingles[1:] != shingles[:-1]]))
        counts = np.diff(np.append(starts, len(shingles)))
        count = np.repeat(counts, counts)
        shared = count > 1
        shingles = shingles[shared] * np.uint64(buckets) + np.uint64(bucket)
        sids, count = sids[shared], np.minimum(count[shared], 255).astype(np.uint8)
        part = sids % groups
        order = np.argsort(part, kind="stable")
        ends = np.cumsum(np.bincount(part, minlength=groups))
        starts = ends - np.bincount(part, minlength=groups)
        full = np.flatnonzero(ends > starts).tolist()
        blob = lambda a: pa.array([a[order[starts[g] : ends[g]]].tobytes() for g in full], pa.binary())
        return pa.table({"part": pa.array(full, pa.int64()), "sids": blob(sids), "shingles": blob(shingles), "counts": blob(count)})

    return rows.groupBy("bucket").applyInArrow(run, "part long, sids binary, shingles binary, counts binary")


def _candidates(shared: DataFrame, sets: DataFrame, groups: int) -> DataFrame:
    """Sets that can have a partner: (sid, n, prefix: shingles, places: their places in the set, body: sorted shared shingles,
    alone: how many shingles are in no other set, sketch: longs in which every shared shingle turned one bit)."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("sid", pa.int64()), ("n", pa.int64()), ("prefix", pa.list_(pa.int64())), ("places", pa.list_(pa.int64())), ("body", pa.binary()), ("alone", pa.int64()), ("sketch", pa.list_(pa.int64()))])
        size = dict(zip(right["sid"].to_pylist(), right["n"].to_pylist()))
        sids = np.frombuffer(b"".join(left["sids"].to_pylist()), np.int64)
        shingles = np.frombuffer(b"".join(left["shingles"].to_pylist()), np.uint64)
        counts = np.frombuffer(b"".join(left["counts"].to_pylist()), np.uint8)
        out = []
        if len(sids):
            order = np.lexsort((shingles, counts, sids))
            sids, shingles = sids[order], shingles[order]
            starts = np.flatnonzero(np.concatenate([[True], sids[1:] != sids[:-1]])).tolist()
            for i, j in zip(starts, [*starts[1:], len(sids)]):
                n = size.get(int(sids[i]))
                if n is None:
                    raise ValueError(f"set {sids[i]} has shingles but is not in the table of sets: texts changed between two reads")
                alone = n - (j - i)  # shingles of no other set come first in the order
                prefix = n - -(-PERCENT * n // 100) + 1 - alone
                if prefix > 0:
                    prefix = min(prefix, j - i)
                    out.append((int(sids[i]), n, shingles[i : i + prefix].view(np.int64), np.arange(alone, alone + prefix), np.sort(shingles[i:j]).tobytes(), alone, _sketch(shingles[i:j])))
        columns = zip(*out) if out else [[]] * len(schema)
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    keyed = sets.select(F.pmod("sid", F.lit(groups)).alias("part"), "sid", "n")
    return shared.groupBy("part").cogroup(keyed.groupBy("part")).applyInArrow(
        run, "sid long, n long, prefix array<long>, places array<long>, body binary, alone long, sketch array<long>"
    )


def _sketch(shingles: np.ndarray) -> np.ndarray:
    """SKETCH longs in which every shingle turns one bit: at most as many bits differ between two sets as shingles."""
    odd = np.bincount((shingles % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _overlaps(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """Pairs (a, b) with their sizes and the size of their intersection."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in batches:
            yield pa.array(
                [len(np.intersect1d(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), assume_unique=True)) for x, y in zip(left, right)],
                pa.int64(),
            )

    a = bodies.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("body").alias("body_a"))
    b = bodies.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("body").alias("body_b"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "na", "nb", F.arrow_udf(run, "long")("body_a", "body_b").alias("overlap"))


def _linked(overlap: Column | str = "overlap") -> Column:
    o = F.col(overlap) if isinstance(overlap, str) else overlap
    return 100 * o >= PERCENT * (F.col("na") + F.col("nb") - o)


def _postings(candidates: DataFrame) -> DataFrame:
    """Index entries; ``block`` is the size class: sets that can link are in the same class or in neighbouring ones."""
    entry = F.explode(F.arrays_zip("prefix", "places")).alias("e")
    block = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / PERCENT))).cast("int")
    return candidates.select("sid", "n", block.alias("block"), entry).select("sid", "n", "block", F.col("e.prefix").alias("shingle"), F.col("e.places").alias("place"))


def _in_reach(x: str, y: str) -> Column:
    """Whether sizes and positions of two entries of a list allow a link."""
    nx, ny, px, py = F.col(f"n{x}"), F.col(f"n{y}"), F.col(f"p{x}"), F.col(f"p{y}")
    sizes = 100 * F.least(nx, ny) >= PERCENT * F.greatest(nx, ny)
    most = 1 + F.least(nx - px - 1, ny - py - 1)
    return sizes & (100 * most >= PERCENT * (nx + ny - most))


def _sketches_allow(x: str, y: str) -> Column:
    """Whether two sets may differ in few enough shingles: those of no other set, and one at least for each bit of the sketches."""
    differ = [F.bit_count(F.get(f"s{x}", F.lit(j)).bitwiseXOR(F.get(f"s{y}", F.lit(j)))) for j in range(SKETCH)]
    return (100 + PERCENT) * sum(differ, F.col(f"a{x}") + F.col(f"a{y}")) <= (100 - PERCENT) * (F.col(f"n{x}") + F.col(f"n{y}"))


def _open_entries(entries: DataFrame, labels: DataFrame, sketches: DataFrame) -> DataFrame:
    """Entries, with label and sketch, of the lists whose sets are not known to belong together, and the label ``main`` that
    most of the list has."""
    own = labels.withColumnsRenamed({"node": "sid"})
    marked = entries.join(own, "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    sizes = marked.groupBy("shingle", "label").agg(F.count(F.lit(1)).alias("_c"))
    mixed = sizes.groupBy("shingle").agg(F.max_by("label", F.struct("_c", "label")).alias("main"), F.count(F.lit(1)).alias("_labels"))
    open_ = marked.join(mixed.filter("_labels > 1").drop("_labels"), "shingle")
    return stable(open_.join(sketches, "sid"))


def _side(entries: DataFrame, x: str, *more: str) -> DataFrame:
    """``entries`` with columns named after one side of a pair."""
    named = {"sid": x, "n": f"n{x}", "place": f"p{x}", "label": f"l{x}", "alone": f"a{x}", "sketch": f"s{x}"}
    return entries.select("shingle", "block", *more, *[F.col(c).alias(name) for c, name in named.items()])


def _meetings(open_: DataFrame) -> DataFrame:
    """(x, y) of different labels that may be linked, from parts of about MEETING entries of one block of a list."""
    counts = open_.groupBy("shingle", "block").agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1")
    dealt = open_.join(counts, ["shingle", "block"]).withColumn("part", F.pmod(F.xxhash64("sid"), F.ceil(F.col("_c") / MEETING)))
    x, y = _side(dealt, "x", "part"), _side(dealt, "y", "part").withColumnsRenamed({c: f"_{c}" for c in ("shingle", "block", "part")})
    meet = (F.col("shingle") == F.col("_shingle")) & (F.col("block") == F.col("_block")) & (F.col("part") == F.col("_part"))
    return x.join(y, meet & (F.col("lx") < F.col("ly")) & _in_reach("x", "y") & _sketches_allow("x", "y")).select("x", "y")


def _remaining(open_: DataFrame) -> DataFrame:
    """(x, y, nx, ny, lx) of all pairs of different labels in a list that may be linked. One of the two is outside the list's
    largest group, so only entries outside it look for others."""
    blocks = F.explode(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1)).alias("_block")
    x = _side(open_.filter("label <> main"), "x", "main").select("*", blocks).withColumnsRenamed({"shingle": "_shingle"}).drop("block")
    meet = (F.col("shingle") == F.col("_shingle")) & (F.col("block") == F.col("_block"))
    once = (F.col("ly") == F.col("main")) | (F.col("lx") < F.col("ly"))
    return x.join(_side(open_, "y"), meet & once & _in_reach("x", "y") & _sketches_allow("x", "y")).select("x", "y", "nx", "ny", "lx").distinct()


def _pairs(found: DataFrame) -> DataFrame:
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def links_of(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b, overlap) links that hold all components together, and (node, label) of every set with a link."""
    spark = candidates.sparkSession
    entries = stable(_postings(candidates))
    bodies, sketches = candidates.select("sid", "n", "body"), candidates.select("sid", "alone", "sketch")

    def linked(pairs: DataFrame) -> DataFrame:
        return stable(_overlaps(pairs, bodies).filter(_linked()).select("a", "b", "overlap"))

    # 1. Each set against the first set of each of its lists.
    first = entries.groupBy("shingle").agg(F.min("sid").alias("v"), F.max("sid").alias("_last")).filter("v < _last")
    pairs = entries.join(first, "shingle").filter("sid <> v").select(F.col("v").alias("a"), F.col("sid").alias("b")).distinct()
    star = stable(_overlaps(pairs, bodies))
    links = star.filter(_linked()).select("a", "b", "overlap")
    labels = components(links, at_once=LINKS_AT_ONCE)
    tidied(spark)

    # 2. Lists whose sets are not known to belong together, in small parts.
    open_ = _open_entries(entries, labels, sketches)
    found = linked(_pairs(_meetings(open_)))
    if not found.isEmpty():
        links = links.union(found)
        labels = components(links, at_once=LINKS_AT_ONCE)
        open_ = _open_entries(open_.select(*entries.columns), labels, sketches)
    tidied(spark)

    # 3. Those lists as wholes: what neither sizes and positions nor sketches nor the bound from a representative's answer rule out.
    rest = _remaining(open_)
    both = star.select("a", "b", "overlap").union(star.select(F.col("b"), F.col("a"), F.col("overlap"))).distinct()
    to_own = both.select(F.col("a").alias("lx"), F.col("b").alias("x"), F.col("overlap").alias("own"))
    to_other = both.select(F.col("a").alias("lx"), F.col("b").alias("y"), F.col("overlap").alias("other"))
    bound = F.coalesce(F.col("other") + F.col("nx") - F.when(F.col("x") == F.col("lx"), F.col("nx")).otherwise(F.col("own")), F.least("nx", "ny"))
    rest = rest.join(to_own, ["lx", "x"], "left").join(to_other, ["lx", "y"], "left")
    rest = rest.filter(100 * bound >= PERCENT * (F.col("nx") + F.col("ny") - bound))
    found = linked(_pairs(rest))
    if found.isEmpty():
        return links, labels
    links = links.union(found)
    labels = components(links, at_once=LINKS_AT_ONCE)
    tidied(spark)
    return links, labels


def join_documents(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """doc_id, n_shingles (size of the set of ``k``-word shingles) and component_id for every row of ``docs``.

    Documents whose sets are at least PERCENT percent similar (Jaccard) are linked; component_id is the smallest doc_id that
    links reach. Null and empty texts have an empty set and are linked with nothing; a text with fewer words than ``k`` is one
    shingle. Repeated rows are linked with each other. A null doc_id gets the smallest id of its component, null alone.
    ``docs`` is read twice and has to give the same texts, in whatever partitions. Sets are told apart by 63-bit hashes, shingles inside a comparison by 40 bits and their bucket.
    """
    with small_batches(docs.sparkSession):
        sets = stable(set_table(docs, k))
    total = sets.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows")).first()
    buckets = 1 + (total["n"] or 0) // BUCKET
    filled = sets.filter("n > 0")
    classes = stable(filled.groupBy("sid").agg(F.min("n").alias("n"), F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("rows")))
    shared = _shared_rows(_bucket_rows(docs, buckets, k), buckets, buckets)
    with small_batches(docs.sparkSession):
        candidates = stable(_candidates(shared, classes, buckets))
    tidied(docs.sparkSession)
    with small_batches(docs.sparkSession):
        _, labels = links_of(candidates)
    grouped = classes.join(labels.withColumnRenamed("node", "sid"), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    smallest = grouped.groupBy("label").agg(F.min("first_doc").alias("component"), F.sum("rows").alias("_rows"))
    found = grouped.join(smallest.filter("_rows > 1"), "label").select("sid", "component")
    out = sets.join(found, "sid", "left")
    alone = F.col("n") == 0
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.coalesce("component", "doc_id")).alias("component_id"))


def keep_first_of_each(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its component, with their columns as they were.

    Rows that share a doc_id are one document and give one row. Rows without a doc_id cannot be told apart by it: they stay,
    equal texts once.
    """
    named = docs.filter(F.col("doc_id").isNotNull())
    first = join_documents(docs, k).filter("doc_id = component_id").select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id")).distinct()
    kept = named.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.union(docs.filter(F.col("doc_id").isNull()).dropDuplicates(["text"]))
