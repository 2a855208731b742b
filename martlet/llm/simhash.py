"""SimHash near duplicates over deletion-variant signatures, in DataFrame functions only.

A fingerprint has 64 bits; two are linked when at most two bits differ. Cut into two halves, one half of a linked pair
differs by at most one bit, so the pair agrees on a half with one bit taken out. Every distinct fingerprint is therefore
indexed under the 64 variants of its halves with one wildcard bit; equal variants meet and are verified. A variant that
more than FEW fingerprints share would cost more in pairs than all patterns with two wildcards over the whole
fingerprint, and those say exactly who is linked: its members get these patterns, and each pattern links its members to
the smallest of them. So no list is compared pair by pair beyond FEW, and no link is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlet.llm.common import join_classes, join_counted, written
from martlet.llm.components import components

#: Words of a shingle; bits of a fingerprint.
WORDS, BITS = 3, 64
#: Differing bits that still link. The index is made for two halves and one wildcard, that is, for this number.
DISTANCE = 2
#: Fingerprints of one variant that are compared pair by pair: 64 variants of 63/2 pairs are as many as 2,016 patterns.
FEW = 64
_UPPER, _LOWER, _BLANKS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "\t\n\x0b\x0c\r"
_HALF = 0xFFFFFFFF


def _words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case; an empty array for null."""
    plain = F.translate(F.coalesce(text, F.lit("")), _UPPER + _BLANKS, _LOWER + " " * len(_BLANKS))
    return F.array_remove(F.split(plain, " "), "")


def _shingles(docs: DataFrame) -> DataFrame:
    """(doc, mark, n, h): the hash of every shingle, repeats included; one row with a null hash for a text without words."""
    text = F.col("text").cast("string")
    split = docs.select(F.col("doc_id").alias("doc"), F.xxhash64(text).alias("mark"), _words(text).alias("words"))
    n = F.size("words") - (WORDS - 1)
    runs = F.arrays_zip(*[F.slice("words", F.lit(i + 1), F.greatest(n, F.lit(1))).alias(f"w{i}") for i in range(WORDS)])
    # Of fewer words arrays_zip gives the first ones and nulls, which concat_ws leaves out: the whole sequence.
    short = F.array(F.struct(*[F.get("words", F.lit(i)).alias(f"w{i}") for i in range(WORDS)]))
    cut = split.select("doc", "mark", F.when(F.size("words") == 0, F.lit(0)).otherwise(F.greatest(n, F.lit(1))).alias("n"), F.when(n >= 1, runs).when(F.size("words") > 0, short).alias("runs"))
    each = cut.select("doc", "mark", "n", F.inline_outer("runs").alias(*[f"w{i}" for i in range(WORDS)]))
    hashed = F.xxhash64(F.concat_ws(" ", *[f"w{i}" for i in range(WORDS)]))
    return each.select("doc", "mark", "n", F.when(F.col("n") > 0, hashed).alias("h"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc, fp) for every row of ``docs``: a bit is 1 if it is set in over half of the shingles' hashes.

    Ones are counted two bits to a number, 32 bits apart, and add up inside the task that holds the text, so that one row
    a document is shuffled. Rows with equal id and text count together, which moves no majority, and come out as often as
    they went in.
    """
    counted = _shingles(docs).groupBy("doc", "mark", "n").agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.sum(F.shiftright("h", i).bitwiseAND(F.lit(0x100000001))).alias(f"s{i}") for i in range(32)],
    )
    half = F.col("_rows") / 2
    fp = F.lit(0).cast("long")
    for i in range(32):
        low, high = F.col(f"s{i}").bitwiseAND(F.lit(_HALF)), F.shiftrightunsigned(f"s{i}", 32)
        fp = fp.bitwiseOR(F.when(low > half, F.lit(1 << i)).otherwise(F.lit(0)))
        fp = fp.bitwiseOR(F.when(high > half, F.lit(1 << (i + 32) if i < 31 else -(1 << 63))).otherwise(F.lit(0)))
    times = F.when(F.col("n") == 0, F.col("_rows")).otherwise(F.col("_rows") / F.greatest("n", F.lit(1))).cast("int")
    return counted.select("doc", fp.alias("fp"), times.alias("_times")).select("doc", "fp", F.explode(F.sequence(F.lit(1), "_times")).alias("_")).drop("_")


def distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _variants(distinct: DataFrame) -> DataFrame:
    """(variant, fp): both halves with each bit taken out in turn. The place of the wildcard stands above the half."""
    places = distinct.select("fp", F.explode(F.sequence(F.lit(0), F.lit(BITS - 1))).alias("place"))
    half = F.when(F.col("place") < 32, F.col("fp").bitwiseAND(F.lit(_HALF))).otherwise(F.shiftrightunsigned("fp", 32))
    one = F.expr("shiftleft(1L, place % 32)")
    return places.select((F.shiftleft(F.col("place").cast("long"), 32)).bitwiseOR(half.bitwiseAND(F.bitwise_not(one))).alias("variant"), "fp")


def _patterns(crowded: DataFrame) -> DataFrame:
    """(place, pattern, fp): the fingerprint with every two of its bits taken out."""
    low = crowded.select("fp", F.explode(F.sequence(F.lit(0), F.lit(BITS - 2))).alias("i"))
    both = low.select("fp", "i", F.explode(F.expr("sequence(i + 1, 63)")).alias("j"))
    masked = F.col("fp").bitwiseAND(F.bitwise_not(F.expr("shiftleft(1L, i) | shiftleft(1L, j)")))
    return both.select((F.col("i") * BITS + F.col("j")).alias("place"), masked.alias("pattern"), "fp")


def links(distinct: DataFrame, few: int = FEW) -> DataFrame:
    """(a, b) between distinct fingerprints at most DISTANCE bits apart, with every such pair connected by a chain of rows.

    ``distinct`` is read twice. Of up to three fingerprints that share a variant, smallest, largest and the sum of all bits
    tell each; only members of larger groups are looked up again. Groups of up to ``few`` are compared pair by pair.
    """
    met = _variants(distinct).groupBy("variant").agg(
        F.count(F.lit(1)).alias("n"), F.min("fp").alias("low"), F.max("fp").alias("high"), F.bit_xor("fp").alias("all")
    )
    met = written(met.filter("n > 1"), "variants")
    middle = F.col("all").bitwiseXOR(F.col("low")).bitwiseXOR(F.col("high"))
    sides = F.when(F.col("n") == 2, F.array(F.struct(F.col("low").alias("a"), F.col("high").alias("b")))).otherwise(
        F.array(*[F.struct(x.alias("a"), y.alias("b")) for x, y in ((F.col("low"), middle), (middle, F.col("high")), (F.col("low"), F.col("high")))])
    )
    pairs = met.filter("n <= 3").select(F.inline(sides)).filter(distance("a", "b") <= DISTANCE)
    members = written(join_counted(_variants(distinct), met.filter("n > 3").select("variant", "n"), ["variant"]), "members")
    lists = members.filter(F.col("n") <= few).groupBy("variant").agg(F.collect_list("fp").alias("fps"))  # few fingerprints at most
    of_lists = (
        lists.select("fps", F.explode("fps").alias("a"))
        .select("a", F.explode(F.expr(f"filter(fps, b -> a < b and bit_count(a ^ b) <= {DISTANCE})")).alias("b"))
        .select("a", "b")
    )
    crowded = members.filter(F.col("n") > few).select("fp").distinct()
    shared = _patterns(crowded).groupBy("place", "pattern").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    # By key: Spark takes the 2,016 patterns of a fingerprint for one row, and would send them all to the driver.
    starred = _patterns(crowded).hint("merge").join(shared, ["place", "pattern"]).filter("a < fp").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(of_lists).unionByName(starred)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id that links reach) for every row of ``docs``.

    Needs doc_id and text; other columns do not matter, whatever their names. Null, empty and blank texts have fingerprint
    zero and are linked like any other; texts of fewer than WORDS words are one shingle. Repeated rows stay repeated, rows
    with one doc_id and different texts have a fingerprint each. Rows without a doc_id get the smallest id of their
    component, null if no row of it has one. Of a very long text one task holds the words and nothing else. An empty table
    gives no rows.
    """
    made = written(fingerprints(docs), "fingerprints")
    groups = written(made.groupBy("fp").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("rows")), "groups")
    labels = components(links(groups.select("fp"))).withColumnRenamed("node", "fp")
    classes = groups.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    smallest = classes.groupBy("label").agg(F.min("first").alias("component"))
    classes = written(classes.join(smallest, "label").select("fp", "rows", "component"), "classes")
    return join_classes(made, classes, ["fp"]).select(
        F.col("doc").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")
    )
