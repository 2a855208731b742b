"""Secrets in texts: known forms by pattern, others by a battery of randomness tests. DataFrame functions only.

Every run of 20 or more characters of an encoding's alphabet is a candidate. Its encoding is inferred from its characters;
over that alphabet three tests ask whether the characters are uniform (chi-squared), alternate like independent ones
(runs about the middle) and do not follow from the one before (serial correlation). A secret passes the three together.
Ordinary text can do so by chance, so a candidate also has to be unlikely as ordinary text: the pairs of characters in the
corpus's shorter runs, which are no candidates, give its chance Q as text, and U is its chance as random characters of its
encoding. Under Q a ratio U / Q of x or more has a chance of 1 / x at most, at any length, so Q / U is taken as p-value, and
the Benjamini-Hochberg rule, applied in each length class to all candidates, holds the share of false finds at FALSE_FINDS.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns of the known kinds, in their order, and what a match has to have.
KINDS = ("assign", "access", "hex")
ASSIGN = "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
ASSIGN_VALUE = 6
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
#: Alphabets by encoding, in the order in which they are tried.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "letters": "abcdefghijklmnopqrstuvwxyz",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
#: Level at which the three tests together reject randomness, and the share of false finds per length class.
RANDOM_LEVEL, FALSE_FINDS = 0.005, 0.05
#: Bins of -ln p over which the rule is applied, and what is added to every count of ordinary pairs.
_BINS, _ADDED = 400, 0.5
#: Characters of candidates, and their kinds; a pair's chance is that of the kind, then of the character in it, case ignored.
_CHARACTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
_KIND = {c: ("lower" if c.islower() else "upper" if c.isupper() else "digit" if c.isdigit() else "sign") for c in _CHARACTERS}


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), f), 1)


def _spans(text: Column, pattern: str, kind: str, passes: Column | None = None) -> Column:
    """Spans (start, rank, end, kind) of the matches of a pattern, in code points; ``passes`` says which matches count."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    ok = passes if passes is not None else F.transform(found, lambda m: F.lit(True))
    rank = (*KINDS, "random").index(kind)
    empty = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["b"])
        end = start + F.char_length(x["m"])
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"))
        return F.struct(end.alias("at"), F.when(x["ok"], F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    rows = F.arrays_zip(F.slice(between, F.lit(1), F.size(found)).alias("b"), found.alias("m"), ok.alias("ok"))
    start = F.struct(F.lit(0).alias("at"), empty.alias("spans"))
    return F.when(F.size(found) == 0, empty).otherwise(F.aggregate(rows, start, step)["spans"])


def base_spans(text: Column) -> list[Column]:
    """Spans of each known kind."""
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    long_enough = F.transform(values, lambda v: F.char_length(v) >= ASSIGN_VALUE)
    return [_spans(text, ASSIGN, "assign", long_enough), _spans(text, ACCESS, "access"), _spans(text, HEX, "hex")]


def _normal_tail(z: Column) -> Column:
    """P(Z > z), by a logistic of a cubic; the error is below 0.0002."""
    bounded = F.greatest(F.lit(-12.0), F.least(F.lit(12.0), z))
    return 1 / (1 + F.exp(1.5976 * bounded + 0.07056 * bounded * bounded * bounded))


def _encoding(run: Column) -> Column:
    return (
        F.when(run.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex")
        .when(run.rlike("^[a-z]+$"), "letters")
        .when(run.rlike("^[A-Z2-7]+=*$"), "base32")
        .otherwise("base64")
    )


def _symbols(run: Column, encoding: Column) -> Column:
    """Places of the characters in their alphabet."""
    plain = F.rtrim(F.translate(run, "-_", "+/"), F.lit("="))
    plain = F.when(encoding == "hex", F.lower(plain)).otherwise(plain)
    alphabet = F.element_at(F.create_map(*[F.lit(x) for pair in ALPHABETS.items() for x in pair]), encoding)
    return F.transform(F.filter(F.split(plain, ""), lambda c: c != ""), lambda c: F.call_function("instr", alphabet, c) - 1)


def _tests(symbols: Column, size: Column) -> Column:
    """(n, uniform: standardised chi-squared, p: of the three tests together) for places in an alphabet of ``size``."""
    n = F.size(symbols).cast("double")
    add = lambda a, v: a + v
    squares = F.aggregate(
        F.array_distinct(symbols),
        F.lit(0.0),
        lambda a, s: a + F.pow(F.size(F.filter(symbols, lambda x: x == s)).cast("double"), F.lit(2.0)),
    )
    k = size - 1
    chi = F.greatest(F.lit(1e-9), size / n * squares - n)
    uniform = (F.pow(chi / k, F.lit(1 / 3)) - (1 - 2 / (9 * k))) / F.sqrt(2 / (9 * k))
    high = F.transform(symbols, lambda s: (s >= size / 2).cast("int"))
    ones = F.aggregate(high, F.lit(0), add).cast("double")
    pairs = F.arrays_zip(F.slice(symbols, F.lit(1), F.size(symbols) - 1).alias("a"), F.slice(symbols, F.lit(2), F.size(symbols) - 1).alias("b"))
    changes = F.aggregate(pairs, F.lit(0), lambda acc, p: acc + ((p["a"] >= size / 2) != (p["b"] >= size / 2)).cast("int")).cast("double")
    expected = 2 * ones * (n - ones) / n
    spread = F.sqrt(F.greatest(F.lit(1e-9), expected * (expected - 1) / (n - 1)))
    runs = F.abs(changes - expected) / F.greatest(spread, F.lit(1e-3))
    mean = F.aggregate(symbols, F.lit(0), add) / n
    variance = F.aggregate(symbols, F.lit(0.0), lambda a, s: a + (s - mean) * (s - mean))
    joint = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + (p["a"] - mean) * (p["b"] - mean))
    serial = F.abs(joint / F.greatest(variance, F.lit(1e-9)) + 1 / n) * F.sqrt(n)

    logs = -(F.log(_normal_tail(uniform)) + F.log(F.least(F.lit(1.0), 2 * _normal_tail(runs))) + F.log(F.least(F.lit(1.0), 2 * _normal_tail(serial))))
    together = F.exp(-logs) * (1 + logs + logs * logs / 2)
    return F.struct(n.cast("int").alias("n"), uniform.alias("uniform"), together.alias("p"))


def battery(run: Column) -> Column:
    """(encoding, n, uniform, p) of a run of characters."""
    size = F.element_at(F.create_map(*[x for k, a in ALPHABETS.items() for x in (F.lit(k), F.lit(float(len(a))))]), _encoding(run))
    tests = _let(F.struct(_symbols(run, _encoding(run)).alias("s"), size.alias("k")), lambda v: _tests(v["s"], v["k"]))
    return _let(tests, lambda t: F.struct(_encoding(run).alias("encoding"), t["n"].alias("n"), t["uniform"].alias("uniform"), t["p"].alias("p")))


def _length_class(n: Column) -> Column:
    """Two classes for each doubling of the length."""
    return F.floor(2 * F.log2(F.greatest(n, F.lit(1)).cast("double"))).cast("int")


def ordinary_pairs(docs: DataFrame) -> list[float]:
    """-ln Q of every pair of _CHARACTERS, row by row: the second character's chance after the first one in ordinary text.

    Counted over all runs too short to be candidates, so no find is among them; a pair is a row, and pairs are a few thousand.
    """
    words = docs.select(F.explode(F.split("text", "[^A-Za-z0-9+/_=-]+")).alias("w")).filter(F.length("w").between(2, 19)).groupBy("w").count()
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda i: F.substring(F.col("w"), i, F.lit(2)))).alias("pair")
    counts = {r["pair"]: r["n"] for r in words.select("count", pair).groupBy("pair").agg(F.sum("count").alias("n")).collect()}
    kinds: dict[tuple[str, str], float] = {}
    folded: dict[tuple[str, str], float] = {}
    for (a, b), n in counts.items():
        kinds[_KIND[a], _KIND[b]] = kinds.get((_KIND[a], _KIND[b]), 0) + n
        folded[a.lower(), b.lower()] = folded.get((a.lower(), b.lower()), 0) + n
    names = sorted(set(_KIND.values()))
    of_kind = {(x, y): (kinds.get((x, y), 0) + _ADDED) / sum(kinds.get((x, z), 0) + _ADDED for z in names) for x in names for y in names}
    out = []
    for a in _CHARACTERS:
        for b in _CHARACTERS:
            alike = {c.lower() for c in _CHARACTERS if _KIND[c] == _KIND[b]}
            total = sum(folded.get((a.lower(), c), 0) + _ADDED for c in alike)
            out.append(-math.log(of_kind[_KIND[a], _KIND[b]] * (folded.get((a.lower(), b.lower()), 0) + _ADDED) / total))
    return out


def _log_p(run: Column, encoding: Column, pairs: list[float]) -> Column:
    """-ln of Q / U, 0 at least; the first character counts for neither, and neither does padding."""
    table = F.split(F.lit(",".join(f"{x:.4f}" for x in pairs)), ",").cast("array<double>")
    size = F.element_at(F.create_map(*[x for k, a in ALPHABETS.items() for x in (F.lit(k), F.lit(math.log(len(a))))]), encoding)
    places = F.transform(F.filter(F.split(F.rtrim(run, F.lit("=")), ""), lambda c: c != ""), lambda c: F.call_function("instr", F.lit(_CHARACTERS), c) - 1)

    def ratio(at: Column) -> Column:
        both = F.arrays_zip(F.slice(at, F.lit(1), F.size(at) - 1).alias("a"), F.slice(at, F.lit(2), F.size(at) - 1).alias("b"))
        return F.aggregate(both, F.lit(0.0), lambda acc, p: acc + F.get(table, p["a"] * len(_CHARACTERS) + p["b"]) - size)

    return F.when(F.length(F.rtrim(run, F.lit("="))) > 1, F.greatest(F.lit(0.0), _let(places, ratio))).otherwise(0.0)


def _judged(run: Column, pairs: list[float]) -> Column:
    """(c: length class, log_p) of a candidate; log_p is 0 where the battery rejects it."""

    def one(t: Column) -> Column:
        log_p = F.when(t["p"] >= RANDOM_LEVEL, _log_p(run, t["encoding"], pairs)).otherwise(0.0)
        return F.struct(_length_class(t["n"]).alias("c"), F.coalesce(log_p, F.lit(0.0)).alias("log_p"))

    return _let(battery(run), one)


def length_limits(docs: DataFrame, pairs: list[float]) -> dict[int, float]:
    """For each length class the least -ln p of a find, from all documents.

    Only counts by class and bin leave the tasks: a few hundred rows at most for each class.
    """
    runs = docs.select(F.explode(F.regexp_extract_all(F.col("text"), F.lit(CANDIDATE), F.lit(0))).alias("run"))
    binned = runs.select(_judged(F.col("run"), pairs).alias("t")).select("t.c", F.least(F.lit(_BINS - 1), F.floor(F.col("t.log_p") * 10)).cast("int").alias("bin"))
    histogram: dict[int, list[int]] = {}
    for r in binned.groupBy("c", "bin").count().collect():
        histogram.setdefault(r["c"], [0] * _BINS)[r["bin"]] = r["count"]
    limits = {}
    for c, counts in histogram.items():
        total, above, limit = sum(counts), 0, float("inf")
        for b in range(_BINS - 1, 0, -1):  # the largest p that the rule accepts is the last bin that still fulfils it
            above += counts[b]
            if above and math.exp(-b / 10) <= FALSE_FINDS * above / total:
                limit = b / 10
        limits[c] = limit
    return limits


def find(docs: DataFrame) -> DataFrame:
    """Add ``spans`` to every row: array of (start, rank, end, kind), by start and kind; ends are exclusive, in code points.

    Kinds are those of KINDS and ``random`` for finds of the tests, which never overlap known ones. Null and empty texts
    have no spans; repeated rows have the same; other columns stay, a column ``spans`` is replaced.
    """
    pairs = ordinary_pairs(docs)
    limits = length_limits(docs, pairs)
    text = F.coalesce(F.col("text"), F.lit(""))
    known = F.concat(*base_spans(text))
    if limits:
        table = F.create_map(*[F.lit(x) for c, v in limits.items() for x in (c, float(v))])

        def secret(run: Column) -> Column:
            return F.coalesce(_let(_judged(run, pairs), lambda t: t["log_p"] >= F.element_at(table, t["c"])), F.lit(False))

        runs = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
        tested = _spans(text, CANDIDATE, "random", F.transform(runs, secret))
        both = _let(
            F.struct(known.alias("k"), tested.alias("r")),
            lambda v: F.concat(v["k"], F.filter(v["r"], lambda s: ~F.exists(v["k"], lambda k: (k["start"] < s["end"]) & (s["start"] < k["end"])))),
        )
    else:
        both = known
    return docs.withColumn("spans", F.array_sort(both))


def count_of(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def as_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
