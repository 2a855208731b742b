"""Keyed surrogates for personal data, in DataFrame functions only.

Entities are found by pattern; a person's name behind a title, behind a label (Contact:, Name: ...) or by its first name. Words
of the names found in a text are then replaced wherever they stand in it. All mentions of one entity (an e-mail address in any case, a number in any grouping, a
surname with or without the first name) come down to one normal form; each distinct form draws a surrogate from a keyed
hash. A surrogate has the type, script, letter case and layout of what it replaces: digits for digits, the same separators, a
valid check digit where there was one, a first name of the same gender. Surrogates that two entities drew, or that are
themselves an entity of the corpus, are drawn again until all are distinct, so that different entities stay different
and the same stay the same in all documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlet.session import stable

#: Titles by gender; after a title come one or two capitalised words.
TITLES = {
    "m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа"),
    "x": ("Dr", "Prof", "Доктор"),
}
#: First names by gender and script.
FIRST = {
    "m": ("Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leon Martin Noel Oscar Paul Robert Simon Thomas Victor".split()),
    "f": ("Anna Berta Clara Diana Emma Flora Greta Helena Irene Julia Klara Laura Maria Nina Olga Paula Rosa Sara Teresa Vera".split()),
    "x": ("Alex Andrea Chris Dominique Jo Kim Lou Maxime Nikola Robin Sascha Sidney Toni Vanja".split()),
    "mc": ("Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Никита Олег Павел Роман Сергей Тимур".split()),
    "fc": ("Алла Белла Вера Галина Дарья Елена Жанна Инна Кира Лидия Марина Нина Ольга Полина Рита Софья".split()),
    "xc": ("Валя Женя Саша Слава".split()),
}
#: Syllables of surnames, Latin and Cyrillic.
SYLLABLES = {"l": "bar den fal gor hem kol lin mar nor pel ros sten tal ver wil zan".split(), "c": "бар ден фал гор лем кол лин мар нор пел рос тен тал вер вил зан".split()}
#: Further first names that are cues for a name without a title.
KNOWN = {
    "m": "Alexander Andreas Andrew Anthony Antoine Benjamin Bernd Brian Carlos Charles Christian Christopher Daniel Dennis Dieter Dmitri Edward Eric Florian Frank François George Guillaume Günter Hans Heinrich Henri Jack Jacob Jacques James Javier Jean Jens Johann John José Joseph Juan Jürgen Kevin Klaus Lukas Luis Manuel Marc Markus Matthew Matthias Michael Michel Miguel Nicolas Nikolai Otto Patrick Pedro Peter Philipp Pierre Rainer Richard Sebastian Stefan Stephen Steven Tobias Ulrich Uwe William Wolfgang".split(),
    "f": "Alice Amélie Amy Angela Anne Barbara Brigitte Camille Carmen Caroline Catherine Charlotte Christine Claire Claudia Elena Elisabeth Elizabeth Emily Emilia Eva Françoise Gabriele Hannah Heike Ingrid Isabelle Jane Jennifer Jessica Johanna Karen Karin Katharina Lena Linda Lisa Lucia Margaret Marie Marta Mary Michelle Monika Natalie Nicole Patricia Petra Rachel Rebecca Renate Sabine Sandra Sarah Silvia Sophie Stefanie Susan Susanne Svetlana Tatiana Ursula Valérie".split(),
}
LABELS = "Attn Autor Author Auteur Ansprechpartner Ansprechpartnerin Contact Contacto Kontakt Name Nom Nombre Автор Имя Контакт".split()
#: Listed first names by gender; a listed name has the same gender with and without a title.
_LISTED = {g: [*FIRST[g], *FIRST[g + "c"], *KNOWN.get(g, [])] for g in ("m", "f", "x")}
_NAMES = sorted({n for own in _LISTED.values() for n in own})
#: Listed names by their first letter, so that a word is compared with few; a blank follows, so their order does not matter.
_CUE = "(?:" + "|".join(f"{c}(?:{'|'.join(n[1:] for n in _NAMES if n[0] == c)})" for c in sorted({n[0] for n in _NAMES})) + ")"
_TITLE = "(?:" + "|".join(t for own in TITLES.values() for t in own) + ")"
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-])",
    "phone": r"(?<![\w+.,/-])0[1-9](?:[ .]\d{2}){4}(?![\w-])|(?<![\w+.,/-])(?:0[1-9]\d{1,3}[ /]\d{5,8}|0[1-9]\d{1,3}[ /]\d{3,4} \d{2,4}|\(0[1-9]\d{1,3}\) ?\d{5,8})(?![\w-])|(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,5}(?:[ .-]?\d{2,5}){1,4}(?!\d)|(?<![\w(])\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<![\w.-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\w-])",
    "name": r"(?=\p{Lu})(?:(?<!\p{L})(?:" + _TITLE + r"\.? \p{Lu}\p{L}+(?: \p{Lu}\p{L}+)?|" + _CUE + r" \p{Lu}\p{L}+)"
    + r"|(?<=(?<!\p{L})(?:" + "|".join(LABELS) + r"): )\p{Lu}\p{L}+ \p{Lu}\p{L}+)",
}
#: All kinds in order; a digit, sign or bracket begins every number, and a kind is tried only where its first character stands.
_NUMBERS = "|".join(f"(?:{PATTERNS[kind]})" for kind in ("ip", "ssn", "card", "phone"))
PATTERN = f"(?:{PATTERNS['email']})|(?=[0-9+(])(?:{_NUMBERS})|(?:{PATTERNS['name']})"
#: From this draw on, an address may be any one, so that no number of entities exhausts the private ones.
ANY_ADDRESS = 6
_LETTERS = {"[a-z]": (97, 26), "[A-Z]": (65, 26), "[0-9]": (48, 10), "[а-я]": (0x430, 32), "[А-Я]": (0x410, 32), "[α-ρσ-ω]": (0x3B1, 17), "[ぁ-ん]": (0x3042, 80), "[一-龥]": (0x4E00, 20000), "\\p{Lu}": (65, 26), "\\p{L}": (97, 26)}


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), f), 1)


def kind_of(mention: Column) -> Column:
    out = None
    for kind, pattern in PATTERNS.items():
        here = mention.rlike(f"^(?:{pattern})$")
        out = F.when(here, kind) if out is None else out.when(here, kind)
    return out.when(mention.rlike(r"^\p{Lu}\p{L}+ \p{Lu}\p{L}+$"), "name")  # found behind a label, which is no part of it


def _gender(mention: Column) -> Column:
    title = F.regexp_extract(mention, f"^({_TITLE})", 1)
    words = F.split(F.regexp_replace(mention, f"^{_TITLE}\\.? ", ""), " ")
    first = F.when(F.size(words) > 1, F.initcap(F.element_at(words, 1)))
    listed = F.when(first.isin(*_LISTED["m"]), "m").when(first.isin(*_LISTED["f"]), "f").when(first.isin(*_LISTED["x"]), "x")
    return F.coalesce(listed, F.when(title.isin(*TITLES["m"]), "m").when(title.isin(*TITLES["f"]), "f").otherwise("x"))


def _bare(mention: Column) -> Column:
    """Words of a name without its title."""
    return F.split(F.regexp_replace(mention, f"^{_TITLE}\\.? ", ""), " ")


def _words_of_names(names: DataFrame) -> DataFrame:
    """(_wid, _words: map from a name's word to its surrogate, _again: pattern of these words) of each document.

    Words count as they stand, in capitals, and with one capital; of two surrogates of a word the smaller is taken."""
    pair = F.explode(F.arrays_zip(_bare(F.col("mention")).alias("w"), _bare(F.col("new")).alias("s"))).alias("p")
    pairs = names.select("doc_id", pair).select("doc_id", F.col("p.w").alias("w"), F.col("p.s").alias("s"))
    forms = F.array(F.struct("w", "s"), F.struct(F.upper("w").alias("w"), F.upper("s").alias("s")), F.struct(F.initcap("w").alias("w"), F.initcap(F.lower("s")).alias("s")))
    each = pairs.select("doc_id", F.explode(forms).alias("p")).groupBy("doc_id", F.col("p.w").alias("w")).agg(F.min("p.s").alias("s"))
    words = each.groupBy(F.col("doc_id").alias("_wid")).agg(F.map_from_entries(F.collect_set(F.struct("w", "s"))).alias("_words"))  # the names of one document
    return words.withColumn("_again", F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join(F.map_keys("_words"), "|"), F.lit(r")(?!\p{L})")))


def _replaced(text: Column, pattern: Column, by: Column) -> Column:
    """``text`` with every match of ``pattern`` replaced by its value in a map."""
    new = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda m: F.coalesce(F.element_at(by, m), m))
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("b"), F.array_append(new, F.lit("")).alias("n"))
    return F.array_join(F.transform(pairs, lambda p: F.concat(p["b"], p["n"])), "")


def _entities(mention: Column, kind: Column) -> Column:
    """(part, norm) of the entities in a mention: first names carry their gender, other kinds are one entity."""
    words = F.split(F.regexp_replace(mention, f"^{_TITLE}\\.? ", ""), " ")
    last = F.struct(F.lit("surname").alias("part"), F.lower(F.element_at(words, -1)).alias("norm"))
    first = F.struct(F.concat(F.lit("first_"), _gender(mention)).alias("part"), F.lower(F.element_at(words, 1)).alias("norm"))
    digits = F.regexp_replace(mention, "[^0-9]", "")
    norm = F.when(kind == "email", F.lower(mention)).when(kind == "phone", F.substring(digits, -10, 10)).when(kind == "ip", mention).otherwise(digits)
    one = F.array(F.struct(kind.alias("part"), norm.alias("norm")))
    return F.when(kind == "name", F.when(F.size(words) > 1, F.array(first, last)).otherwise(F.array(last))).otherwise(one)


def _number(key: str, *parts: Column) -> Column:
    """A number of 52 bits from a keyed hash."""
    text = F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts], F.lit(key))
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("long")


def _like(text: Column, key: str, *salt: Column) -> Column:
    """Each letter and digit replaced by one of the same script and case, other characters kept."""

    def one(c: Column, i: Column) -> Column:
        n, out = _number(key, *salt, i), None
        for pattern, (base, size) in _LETTERS.items():
            drawn = F.decode(F.unhex(F.lpad(F.hex(F.lit(base) + n % size), 8, "0")), "UTF-32")
            out = F.when(c.rlike(pattern), drawn) if out is None else out.when(c.rlike(pattern), drawn)
        return out.otherwise(c)

    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), one), "")


def _luhn(digits: Column) -> Column:
    """Sum of a number's digits by the check rule of card numbers; a valid number has a multiple of 10."""
    places = F.reverse(F.filter(F.split(digits, ""), lambda c: c != ""))
    value = lambda c, i: _let(c.cast("int") * (1 + i % 2), lambda d: F.when(d > 9, d - 9).otherwise(d))
    return F.aggregate(F.transform(places, value), F.lit(0), lambda a, v: a + v)


def _draw(key: str, part: Column, norm: Column, attempt: Column) -> Column:
    """A surrogate of a normal form; further attempts give other ones, and names grow so that they never run out."""
    at = F.instr(norm, "@")
    local = _like(F.substring(norm, F.lit(1), at - 1), key, part, norm, attempt)
    domain = _like(F.regexp_replace(F.substring_index(norm, "@", -1), "\\.[^.]*$", ""), key, F.lit("domain"), F.substring_index(norm, "@", -1))
    email = F.concat(local, F.when(attempt > 2, F.concat(F.lit("."), (_number(key, norm, attempt) % 1_000_000_007).cast("string"))).otherwise(""), F.lit("@"), domain, F.lit(".example"))
    octet = lambda i: (_number(key, part, norm, attempt, F.lit(i)) % 256).cast("string")
    ip = F.concat_ws(".", F.when(attempt < ANY_ADDRESS, F.lit("10")).otherwise(octet(0)), octet(1), octet(2), octet(3))
    plain = _like(norm, key, part, norm, attempt)
    body = F.concat(F.substring(norm, 1, 1), F.expr("substring(_plain, 2, length(_plain) - 2)"))
    check = F.when(_luhn(norm) % 10 == 0, F.pmod(10 - _luhn(F.concat(body, F.lit("0"))) % 10, F.lit(10)).cast("string")).otherwise(F.substring(F.col("_plain"), -1, 1))
    cyrillic = norm.rlike("[\\u0400-\\u04FF]")
    pick = lambda names, *salt: F.element_at(F.array(*map(F.lit, names)), (_number(key, *salt) % len(names) + 1).cast("int"))
    syllable = lambda script, i: pick(SYLLABLES[script], part, norm, attempt, F.lit(i))
    grown = lambda script: F.array_join(F.transform(F.sequence(F.lit(10), F.lit(10) + attempt), lambda i: pick(SYLLABLES[script], part, norm, attempt, i)), "")
    surname = lambda script: F.initcap(F.concat(*[syllable(script, i) for i in range(3)], F.when(attempt > 1, grown(script)).otherwise("")))
    first = F.lit(None).cast("string")
    for gender in ("m", "f", "x"):
        of = lambda script, names: F.concat(pick(names, part, norm), F.when(attempt > 0, F.concat(F.lit("-"), F.initcap(grown(script)))).otherwise(""))
        drawn = F.when(cyrillic, of("c", FIRST[gender + "c"])).otherwise(of("l", FIRST[gender]))
        first = F.when(part == f"first_{gender}", drawn).otherwise(first)
    return (
        F.when(part == "email", email)
        .when(part == "ip", ip)
        .when(part == "card", F.concat(body, check))
        .when(part == "ssn", F.concat(F.lit("9"), F.substring(plain, 2, 8)))
        .when(part == "phone", plain)
        .when(part == "surname", F.when(cyrillic, surname("c")).otherwise(surname("l")))
        .otherwise(first)
    )


def _drawn(forms: DataFrame, key: str) -> DataFrame:
    plain = forms.withColumn("_plain", _like(F.col("norm"), key, F.col("part"), F.col("norm"), F.col("attempt")))
    return plain.withColumn("surrogate", _draw(key, F.col("part"), F.col("norm"), F.col("attempt"))).drop("_plain")


def surrogate_table(mentions: DataFrame, key: str) -> DataFrame:
    """(part, norm, surrogate) for each distinct entity of ``mentions`` (part, norm): one to one within each part.

    Entities that drew a surrogate which a smaller entity drew too, or which is an entity of the corpus, draw again; only
    those that clash move on, so the loop ends after a few rounds.
    """
    forms = stable(mentions.select("part", "norm").distinct().withColumn("attempt", F.lit(0)))
    real = forms.select("part", F.col("norm").alias("_form"))
    table = stable(_drawn(forms, key))
    while True:
        form = F.lower("surrogate")
        first = table.groupBy("part", form.alias("_form")).agg(F.min("norm").alias("_first"), F.count(F.lit(1)).alias("_n"))
        taken = first.join(real.withColumn("_real", F.lit(True)), ["part", "_form"], "left").filter("_n > 1 or _real")
        clashing = stable(
            table.withColumn("_form", form).join(taken, ["part", "_form"]).filter("_real or norm <> _first").select("part", "norm")
        )
        if clashing.isEmpty():
            return table
        marked = table.join(clashing.withColumn("_again", F.lit(1)), ["part", "norm"], "left")
        table = stable(_drawn(marked.select("part", "norm", (F.col("attempt") + F.coalesce("_again", F.lit(0))).alias("attempt")), key))


def _render(mention: Column, kind: Column, drawn: Column) -> Column:
    """The mention with its entity replaced, in the mention's own layout; ``drawn`` maps parts to surrogates."""
    words = F.split(F.regexp_replace(mention, f"^{_TITLE}\\.? ", ""), " ")
    title = F.regexp_extract(mention, f"^({_TITLE}\\.? )", 1)
    cased = lambda word, value: F.when((word == F.upper(word)) & (F.length(word) > 1), F.upper(value)).otherwise(value)
    surname = cased(F.element_at(words, -1), F.element_at(drawn, "surname"))
    given = cased(F.element_at(words, 1), F.element_at(drawn, F.concat(F.lit("first_"), _gender(mention))))
    name = F.concat(title, F.when(F.size(words) > 1, F.concat(given, F.lit(" "))).otherwise(""), surname)
    value = F.element_at(drawn, kind)
    characters = F.filter(F.split(mention, ""), lambda c: c != "")
    # Digits from the right: those of the surrogate; a country code in front stays.
    offset = F.length(F.regexp_replace(mention, "[^0-9]", "")) - F.length(value)

    def place(acc: Column, c: Column) -> Column:
        digit = c.rlike("[0-9]")
        new = F.when(digit & (acc["i"] >= offset), F.substring(value, acc["i"] - offset + 1, F.lit(1))).otherwise(c)
        return F.struct((acc["i"] + digit.cast("int")).alias("i"), F.concat(acc["t"], new).alias("t"))

    numbers = F.aggregate(characters, F.struct(F.lit(0).alias("i"), F.lit("").alias("t")), place)["t"]
    upper = (kind == "email") & (mention == F.upper(mention))
    return F.when(kind == "name", name).when(upper, F.upper(value)).when(kind.isin("email", "ip"), value).otherwise(numbers)


def replace_entities(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with every entity in ``text`` replaced by its surrogate under ``key``; other columns stay as they are.

    Equal entities get equal surrogates in all documents, different ones different. Null and empty texts, and texts without
    entities, stay. Repeated rows change alike; rows may share a doc_id, a null doc_id is a document like others.
    """
    names = docs.columns
    found = docs.select(F.col("doc_id"), F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(PATTERN), F.lit(0)))).alias("mention"))
    mentions = stable(found.distinct().withColumn("kind", kind_of(F.col("mention"))).filter("kind is not null"))
    forms = mentions.select("mention", "kind").distinct().select("mention", "kind", F.explode(_entities(F.col("mention"), F.col("kind"))).alias("e"))
    forms = stable(forms.select("mention", "kind", "e.part", "e.norm"))
    drawn = forms.join(surrogate_table(forms, key), ["part", "norm"]).groupBy("mention", "kind").agg(
        F.map_from_entries(F.collect_set(F.struct("part", "surrogate"))).alias("drawn")  # two parts at most
    )
    rendered = drawn.select("mention", _render(F.col("mention"), F.col("kind"), F.col("drawn")).alias("new"))
    of_doc = mentions.join(rendered, "mention").groupBy(F.col("doc_id").alias("_id")).agg(
        F.map_from_entries(F.collect_set(F.struct("mention", "new"))).alias("_new")  # the entities of one document
    )
    words = _words_of_names(mentions.filter("kind = 'name'").join(rendered, "mention"))
    of_doc = of_doc.join(words, F.col("_id").eqNullSafe(F.col("_wid")), "left").drop("_wid")
    packed = docs.select(F.struct(*names).alias("_row"), F.col("doc_id").alias("_doc"), F.col(text).alias("_text"))
    joined = packed.join(of_doc, F.col("_doc").eqNullSafe(F.col("_id")), "left")
    between = F.split("_text", PATTERN, -1)
    new = F.transform(F.regexp_extract_all(F.col("_text"), F.lit(PATTERN), F.lit(0)), lambda m: F.coalesce(F.element_at(F.col("_new"), m), m))
    pairs = F.arrays_zip(between.alias("b"), F.array_append(new, F.lit("")).alias("n"))
    rest = lambda b: F.when(F.col("_words").isNull(), b).otherwise(_replaced(b, F.col("_again"), F.col("_words")))
    whole = F.array_join(F.transform(pairs, lambda p: F.concat(rest(p["b"]), p["n"])), "")
    changed = F.when(F.col("_new").isNull(), F.col("_text")).otherwise(whole)
    return joined.select(*[changed.alias(c) if c == text else F.col(f"_row.{c}").alias(c) for c in names])
