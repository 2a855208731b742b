from __future__ import annotations

import random
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from martlet.llm import decontaminate, jaccard_join, line_dedup, sparse_suffix
from martlet.llm.components import components
from martlet.session import ensure_checkpoint_dir
from tests.llm.conftest import prose


def edited(text: str, share: float, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join(f"edit{rng.randrange(10**6)}" if rng.random() < share else w for w in text.split(" "))


def family(seed: int, size: int, share: float, words: int = 120) -> list[str]:
    base = prose(seed, words)
    return [base] + [edited(base, share * (i % 5), seed * 1000 + i) for i in range(1, size)]


def plain_components(rows, percent=75, k=5):
    sets = {}
    for i, text in rows:
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        sets[i] = {tuple(words[j : j + k]) for j in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and sets[a] and sets[b] and label[a] != label[b]:
                    both = len(sets[a] & sets[b])
                    if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                        label[a] = label[b] = min(label[a], label[b])
                        changed = True
    return {i: (len(sets[i]), label[i]) for i in sets}


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(rng.randrange(500, 600), rng.randrange(500, 600)) for _ in range(60)]
    rng.shuffle(edges)
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {n: n for e in edges for n in e}
    for _ in range(100):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert all(got.get(n, n) == parent[n] for n in parent)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_join_matches_brute_force(spark, documents):
    texts = [t for s in range(5) for t in family(s, 12, 0.02)] + [prose(50 + i, 6) for i in range(10)] + ["a b c", "A B  C", "a b", ""]
    texts += [prose(70, 40) + " " + prose(80 + i, 60) for i in range(12)]  # a passage that many share
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join_documents(documents(rows)).collect()}
    assert got == plain_components(rows)


def test_join_does_not_depend_on_how_rows_are_dealt(spark, documents, monkeypatch):
    rows = list(enumerate(t for s in range(4) for t in [*family(s, 8, 0.02), prose(s, 120)]))
    dealt = jaccard_join._bucket_rows  # its job may find other executors, and so other splits, than the job before
    monkeypatch.setattr(jaccard_join, "_bucket_rows", lambda docs, *rest: dealt(docs.repartition(3, "doc_id"), *rest))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join_documents(documents(rows)).collect()}
    assert got == plain_components(rows)


def test_a_large_group_of_near_copies_meets_in_parts(spark):
    schema = "shingle long, block int, sid long, n long, place long, label long, alone long, sketch array<long>, main long"
    own = [int(v) for v in jaccard_join._sketch(np.arange(60, dtype=np.uint64))]
    apart = spark.createDataFrame([(1, 3, i, 60, 0, i, 0, own, 0) for i in range(400)], schema)
    met = jaccard_join._meetings(apart).collect()
    assert len({s for r in met for s in r}) > 390 and len(met) < 8 * 400  # 79,800 pairs of all with all
    together = spark.createDataFrame([(1, 3, i, 60, 0, 0 if i >= 5 else i, 0, own, 0) for i in range(400)], schema)
    left = {(min(r.x, r.y), max(r.x, r.y)) for r in jaccard_join._remaining(together).collect()}
    assert left == {(min(a, b), max(a, b)) for a in range(1, 5) for b in range(400) if a != b}


def test_sketches_and_main_groups_lose_no_pair(spark):
    rng = random.Random(7)
    sets = [set(rng.sample(range(1 << 40), 60))]
    for i in range(1, 80):
        sets.append({*rng.sample(sorted(sets[0]), 60 - i % 20), *rng.sample(range(1 << 40), i % 20)})
    sketches = [[int(v) for v in jaccard_join._sketch(np.array(sorted(s), np.uint64))] for s in sets]
    row = [(1, 3, i, 60, 0, i % 5, 0, sketches[i], 2) for i in range(80)]
    entries = spark.createDataFrame(row, "shingle long, block int, sid long, n long, place long, label long, alone long, sketch array<long>, main long")
    found = {(min(r.x, r.y), max(r.x, r.y)) for r in jaccard_join._remaining(entries).collect()}
    similar = {(a, b) for a in range(80) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    similar = {(min(p), max(p)) for p in similar if p[0] % 5 != p[1] % 5}
    assert similar and similar <= found and len(found) < 4 * len(similar)


def test_join_on_odd_rows(spark, edge, nothing):
    rows = [tuple(r) for r in jaccard_join.join_documents(edge).collect()]
    assert len(rows) == 10 and sorted(r for r in rows if r[0] == 3) == [(3, 76, 3)] * 2
    by_id = {r[0]: r for r in rows}
    assert by_id[4][2] == by_id[8][2] == 3 and by_id[1] == (1, 0, 1) and by_id[2] == (2, 0, 2) and by_id[6] == (6, 0, 6)
    assert by_id[7] == (7, 1, 7) and by_id[None][2] is None
    kept = jaccard_join.keep_first_of_each(edge)
    assert kept.columns == edge.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 5, 6, 7]
    assert jaccard_join.join_documents(nothing).count() == 0


def plain_lines(rows, percent=75, least=8):
    seen, out = [], set()
    for i, text in sorted(rows):
        for p, line in enumerate((text or "").split("\n")):
            listed = [w for w in re.split("[ \t\x0b\f\r]+", line.lower()) if w]
            if len(listed) < least:
                continue
            words = {tuple(listed[j : j + 5]) for j in range(len(listed) - 4)}
            if any(100 * len(words & o) >= percent * len(words | o) for o in seen):
                out.add((i, p))
            seen.append(words)
    return out


def test_lines_match_brute_force(spark, documents):
    lines = [prose(s, 40).replace("\n", " ").strip() for s in range(30)]
    rng, rows = random.Random(3), []
    for i in range(60):
        rows.append((i, "\n".join(edited(rng.choice(lines), rng.choice([0, 0.03, 0.2]), i * 100 + j) for j in range(rng.randint(1, 6)))))
    got = {(r.doc_id, r.line) for r in line_dedup.duplicate_lines(documents(rows)).collect()}
    assert got == plain_lines(rows)


def test_short_lines_match_brute_force(spark, documents):
    rng, rows = random.Random(4), []
    lines = [" ".join(prose(s, 40).split()[: s % 9 + 1]) for s in range(40)] + ["", " \t ", "}", "a b a b a b", "b a b a b a"]
    for i in range(80):
        rows.append((i, "\n".join(edited(rng.choice(lines), rng.choice([0, 0, 0.1]), i * 100 + j) for j in range(rng.randint(1, 6)))))
    rows += [(90, " ALL  rights reserved "), (91, "all rights\tReserved\nall rights"), (92, "all rights reserved x")]

    def sets(line):
        w = [x for x in re.split("[ \t\x0b\f\r]+", line.lower()) if x]
        return {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else None

    seen, want = [], set()
    for i, text in rows:
        for p, line in enumerate(text.split("\n")):
            if own := sets(line):
                if any(100 * len(own & o) >= 75 * len(own | o) for o in seen):
                    want.add((i, p))
                seen.append(own)
    got = {(r.doc_id, r.line) for r in line_dedup.duplicate_lines(documents(rows)).collect()}
    assert got == want and (91, 0) in got and (92, 0) not in got


def test_lines_on_odd_rows(spark, edge, nothing):
    kept = line_dedup.drop_duplicate_lines(edge)
    assert kept.columns == edge.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 3, 5, 6, 7]
    assert {r.text for r in kept.collect() if r.doc_id in (1, 2, 6, 7)} == {"", None, " \n\n\t ", "Hi."}
    assert line_dedup.drop_duplicate_lines(nothing).count() == 0


def test_rows_with_one_id_and_different_texts_lose_their_own_lines(spark, documents):
    common, own = "this licence line stands in very many different files", [prose(i, 40).replace("\n", " ") for i in range(6)]
    rows = [(1, common + "\n" + own[0]), (2, common + "\n" + own[1]), (2, own[2] + "\n" + own[3]), (None, own[4] + "\n" + own[0]), (None, own[5]), (None, own[5])]
    kept = sorted((r.doc_id or 0, r.text) for r in line_dedup.drop_duplicate_lines(documents(rows)).collect())
    # Rows without an id come first, so the first document loses its own line and keeps the common one.
    assert kept == sorted([(1, common), (2, own[1]), (2, own[2] + "\n" + own[3]), (0, rows[3][1]), (0, own[5]), (0, own[5])])


def test_a_document_keeps_its_other_lines(spark, documents):
    common = "this licence line stands in very many different files"
    own = [prose(i, 40).replace("\n", " ") for i in range(3)]
    rows = line_dedup.drop_duplicate_lines(documents([(i, own[i] + "\n" + common) for i in range(3)])).collect()
    assert {r.doc_id: r.text for r in rows} == {0: own[0] + "\n" + common, 1: own[1], 2: own[2]}
    assert all(r.n_chars == len(r.text) for r in rows)


def test_a_document_goes_only_without_words(spark, documents):
    licence = [prose(100 + i, 30).replace("\n", " ") for i in range(6)]
    own = [prose(i, 20).replace("\n", " ") for i in range(3)]
    texts = ["\n".join([*licence, w]) for w in own] + ["\n".join([*licence, " ", "", "\t"])]
    rows = line_dedup.drop_duplicate_lines(documents(list(enumerate(texts)))).collect()
    assert {r.doc_id: r.text for r in rows} == {0: texts[0], 1: own[1], 2: own[2]}


def test_wand_finds_all_above_the_threshold():
    rng = random.Random(2)
    index = decontaminate.BlockMaxIndex([(i, prose(i, 30) + " " + prose(1000 + i % 7, 9)) for i in range(150)])
    terms = list(index.term.values())
    for _ in range(150):
        query, threshold = rng.sample(terms, rng.choice([2, 15, 80])), rng.choice([0.05, 0.2, 0.5])
        scores = [0.0] * len(index.ids)
        for t in query:
            for number, impact in zip(*index.postings[t]):
                scores[number] += impact
        assert sorted(n for n, _ in index.search(query, threshold)) == [n for n, s in enumerate(scores) if s >= threshold - 1e-9]


def test_leaks_in_long_and_odd_documents(spark, documents, benchmark, edge, nothing):
    items = [(i, f"What is {prose(900 + i, 12).replace(chr(10), ' ')}? It is {prose(950 + i, 6).strip()}.") for i in range(20)] + [(50, None), (51, "..."), (None, "null id item words here")]
    docs = [(1, prose(1, 9000) + " " + items[3][1].upper() + " " + prose(2, 500)), (2, prose(3, 300)), (3, items[4][1]), (4, items[5][1].split("?")[0] + "? " + prose(7, 40)), (3, items[4][1])]
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(documents(docs), benchmark(items)).collect()}
    assert got == {(1, 3), (3, 4)}
    clean = decontaminate.clean_documents(documents(docs), benchmark(items))
    assert clean.columns == documents([]).columns and sorted(r.doc_id for r in clean.collect()) == [2, 4]
    assert decontaminate.clean_documents(edge, benchmark([])).count() == 10
    assert decontaminate.leaks(edge, benchmark(items)).count() == 0 and decontaminate.leaks(nothing, benchmark(items)).count() == 0


def test_leaks_score_alike_in_one_index_or_many(spark, documents, benchmark, monkeypatch):
    items = [(i, f"What is {prose(900 + i % 25, 12 + i % 5).replace(chr(10), ' ')} {i}? It is {prose(950 + i, 6 + i % 9).strip()}.") for i in range(60)]
    docs = documents([(i, prose(i, 40) + " " + items[i][1] + " " + prose(100 + i, 40)) for i in range(0, 60, 2)])

    def found():
        return {(r.doc_id, r.item_id): round(r.score, 9) for r in decontaminate.leaks(docs, benchmark(items)).collect()}

    once = found()
    monkeypatch.setattr(decontaminate, "INDEX_BYTES", 2_500)
    assert len(list(decontaminate._indexes(benchmark(items)))) > 2
    assert found() == once and {(i, i) for i in range(0, 60, 2)} <= once.keys()


def plain_passages(rows, n=50):
    words = {}
    for i, text in rows:
        words[i] = (text or "").encode().split()
    owners = {}
    for i, w in words.items():
        for j in range(len(w) - n + 1):
            owners.setdefault(tuple(w[j : j + n]), set()).add(i)
    out = {}
    for i, w in words.items():
        spans = []
        for j in range(len(w) - n + 1):
            if len(owners[tuple(w[j : j + n])]) > 1:
                if spans and j <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], j + n)
                else:
                    spans.append((j, j + n))
        if spans:
            out[i] = spans
    return out


def test_passages_match_brute_force(spark, documents):
    passage, short = prose(500, 60), prose(501, 49)
    texts = [prose(i, 30) + " " + (passage if i % 2 else short) + " " + prose(100 + i, 40) for i in range(8)]
    texts += [edited(prose(502, 400), 0.015, i) for i in range(8)] + ["of " * 120, "of " * 70, prose(503, 50), prose(503, 50), prose(504, 10)]
    rows = list(enumerate(texts))
    got = {r.doc_id: [(s.start, s.end) for s in r.passages] for r in sparse_suffix.repeated_passages(documents(rows)).collect()}
    assert got == plain_passages(rows)


def test_passages_on_odd_rows(spark, edge, nothing):
    got = {r.doc_id: r.n_repeated for r in sparse_suffix.repeated_passages(edge).collect()}
    assert got == {3: 80, 4: 80, 8: 80} or got == {3: 80, 4: 80, 8: 79}
    assert sparse_suffix.repeated_passages(nothing).count() == 0


def test_tokens_are_hashed_without_copies_of_words(spark):
    lines = spark.createDataFrame([("A b\tc d  e\x0bf g",), ("a b c d",), (" ",), (None,)], "line string")
    got = [r.h for r in lines.select(line_dedup._runs(line_dedup._words(F.col("line"))).alias("h")).collect()]
    words = spark.createDataFrame([(list("abcdefg"[i : i + 5]),) for i in range(3)], "w array<string>")
    assert got == [[r.h for r in words.select(F.xxhash64("w").alias("h")).collect()], None, None, None]


def test_the_sieve_keeps_all_named_lines_and_few_others(spark):
    lines = spark.range(20_000).select(F.struct(F.lit(True).alias("known"), F.col("id").alias("doc")).alias("ord"), F.lit("x").alias("line"))
    left = line_dedup._sieved(lines, lines.filter("ord.doc % 50 = 0").select("ord"))
    assert left.columns == ["ord", "line"] and left.filter("ord.doc % 50 = 0").count() == 400 and left.count() < 420
    plan = left.join(lines.filter("ord.doc % 50 = 0").select("ord"), "ord")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("getbit") > plan.index("Join Inner, (ord")  # the sieve stays below the join that moves texts


def test_large_classes_of_equal_lines_give_one_entry(spark, documents):
    line = [prose(i, 30).replace("\n", " ").strip() for i in range(3)]
    near = line[0] + " end"
    rows = [(i, "\n".join([line[0], line[1 + i % 2], prose(50 + i, 8).replace("\n", " ")])) for i in range(300)] + [(300, near)]
    slim = line_dedup._prefixes(documents(rows).select(F.col("doc_id").alias("ord"), F.explode(F.split("text", "\n")).alias("line")), bytes(1 << 15))
    classes = slim.groupBy("mark").agg(F.min("ord").alias("first"), F.max("ord").alias("last"), F.count(F.lit(1)).alias("rows"))
    assert line_dedup._without_many_copies(slim, classes, 100).count() == 304
    got = {(r.doc_id, r.line) for r in line_dedup.duplicate_lines(documents(rows)).collect()}
    assert got == plain_lines(rows, least=1)


def test_line_dedup_leaves_only_what_its_result_reads(spark, documents):
    ensure_checkpoint_dir(spark)
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    before = set(folder.glob("*-*"))
    lines = [prose(s, 40).replace("\n", " ").strip() for s in range(6)]
    rows = [(i, "\n".join(edited(lines[(i + j) % 6], 0.03 * (j % 2), i * 10 + j) for j in range(3))) for i in range(30)]
    found = line_dedup.duplicate_lines(documents(rows))
    names = {f.name.split("-")[0] for f in set(folder.glob("*-*")) - before if len(f.name) > 36 and f.name[-32:].isalnum()}
    assert names <= {"copies", "settled"} and {(r.doc_id, r.line) for r in found.collect()} == plain_lines(rows)


def test_sketches_rule_out_only_pairs_that_are_not_similar(spark):
    rng = random.Random(5)
    keys = [sorted(rng.sample(range(1 << 49), 80))]
    for i in range(1, 60):  # half of them similar to the first, half not
        keys.append(sorted({*rng.sample(keys[0], 80 - i), *rng.sample(range(1 << 49), i)}))
    bodies = line_dedup.written(spark.createDataFrame(list(enumerate(keys)), "ord long, keys array<long>"), "bodies")
    pairs = spark.createDataFrame([(i, 0) for i in range(1, 60)], "x long, y long")
    thin = line_dedup._thinned(pairs, bodies)
    similar = {tuple(r) for r in line_dedup._verified(pairs, bodies).collect()}
    assert similar == {tuple(r) for r in line_dedup._verified(thin, bodies).collect()} and len(similar) == 11
    assert {tuple(r) for r in thin.collect()} >= similar and thin.count() < 30


def test_rarity_is_counted_in_compiled_code(spark):
    text = prose(9, 400).replace("\n", " ").lower()
    lines = spark.createDataFrame([(i, text) for i in range(3)] + [(3, "a b"), (4, None), (5, "")], "ord long, line string")
    old = lines.select(F.explode(line_dedup._runs(line_dedup._words(F.col("line")))).alias("h"))
    want = {r.k: r["count"] for r in old.groupBy(line_dedup._class(F.col("h")).alias("k")).count().collect()}
    assert line_dedup._rarity(lines) == bytes(want.get(k, 0).bit_length() for k in range(1 << line_dedup.RARITY_BITS))
    plan = line_dedup._tokens(lines)._jdf.queryExecution().executedPlan().toString()
    assert "lambdafunction" not in plan and "*(1) Generate" in plan


@pytest.mark.parametrize("at_once", [0, 25, 10_000])
def test_links_settled_by_one_task_are_those_of_all_rounds(spark, at_once):
    rng = random.Random(3)
    order = rng.sample(range(1000), 120)
    pairs = [*zip(order[:60], order[1:61]), *((rng.choice(order[61:]), rng.choice(order[61:])) for _ in range(40))]
    label = {x: x for p in pairs for x in p}
    for _ in label:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    spark.sparkContext.setJobGroup(f"settled {at_once}", "")
    got = dict(map(tuple, components(spark.createDataFrame(pairs, "a long, b long"), at_once=at_once).collect()))
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"settled {at_once}"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == {x: m for x, m in label.items() if any(x in p and p[0] != p[1] for p in pairs)}
    assert at_once < 10_000 or jobs <= 8  # the driver remembers every job


def test_entries_of_lines_in_rounds_give_the_same_lines(documents, monkeypatch):
    base = [prose(s, 60).replace("\n", " ") for s in range(6)]
    texts = [base[i % 6] + "\n" + " ".join(base[(i + 1) % 6].split(" ")[:-1] + [f"end{i}"]) for i in range(18)]
    docs, made, write = documents(list(enumerate(texts))), [], line_dedup.written
    monkeypatch.setattr(line_dedup, "written", lambda df, name: made.append(name) or write(df, name))
    once = {(r["doc_id"], r["line"]) for r in line_dedup.duplicate_lines(docs).collect()}
    assert len(once) > 12 and made.count("lists") == 1
    monkeypatch.setattr(line_dedup, "ROUND", 50)
    assert {(r["doc_id"], r["line"]) for r in line_dedup.duplicate_lines(docs).collect()} == once
    assert made.count("lists") == 1 + line_dedup.ROUNDS


def test_texts_are_not_sorted_to_lose_lines(documents):
    kept = line_dedup.drop_duplicate_lines(documents([(1, "one two\nthree"), (2, "one two\nfour"), (None, "five"), (3, None)]))
    assert {(r["doc_id"], r["text"]) for r in kept.collect()} == {(1, "one two\nthree"), (2, "four"), (None, "five"), (3, None)}
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
