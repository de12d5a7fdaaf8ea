"""Exact and near duplicates, lines, and the helpers they share, against brute force."""

import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from tallyroute.llm import common, exact_dedup, line_dedup, queries, simhash

from ..conftest import DATA
from .samples import AWKWARD, WORDS, documents, read


def bare(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def check_exact(rows, source):
    by_text = {}
    for doc_id, text in source:
        by_text.setdefault(bare(text), []).append((-len(text or ""), doc_id is None, doc_id if doc_id is not None else 0))
    assert len(rows) == len(source)
    kept = 0
    sizes = {hashlib.sha256(k.encode()).hexdigest(): (len(v), min(v)) for k, v in by_text.items()}
    for r in rows:
        size, best = sizes[r.text_sha256]
        assert (r.group_size, r.keep_id) == (size, None if best[1] else best[2])
        kept += r.kept
    assert kept == len(by_text)


def test_exact_groups(spark):
    docs = read(spark, DATA, "documents")
    source = [(r.doc_id, r.text) for r in docs.collect()]
    check_exact(queries.op2_exact_dedup(spark, DATA).collect(), source)
    awkward = documents(spark, AWKWARD, extra=True)
    check_exact(exact_dedup.duplicate_groups(awkward, digest_all=True).collect(), [(i, t) for i, t, _ in AWKWARD])


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    cursor = con.execute(queries.ORACLES[name])
    names = [d[0] for d in cursor.description]
    df = queries.QUERIES[name](spark, DATA)
    assert sorted(names) == sorted(df.columns)
    assert sorted(cursor.fetchall()) == sorted(tuple(r[n] for n in names) for r in df.collect())


def test_texts_that_share_length_and_prefix_are_told_apart(spark):
    start = "p" * exact_dedup.PREFIX
    rows = exact_dedup.duplicate_groups(documents(spark, [start + "ab", start + "ba", start + " ab"])).collect()
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in rows) == [(0, 2, False), (1, 1, True), (2, 2, True)]


def test_exact_stage_keeps_one_row_of_each_text(spark):
    docs = documents(spark, [*AWKWARD, (20, "one"), (21, "t w o"), (22, "two"), (22, "two")], extra=True)
    out = exact_dedup.drop_exact_duplicates(docs)
    assert out.columns == docs.columns
    rows = out.filter("doc_id is not null").collect()
    # texts whose best row has no id keep that row beside
    assert sorted(bare(r.text) for r in rows) == sorted({bare(t) for i, t, *_ in AWKWARD if i} | {"two"})
    assert exact_dedup.drop_exact_duplicates(docs.filter(F.lit(False))).count() == 0


def mark(text):
    words = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_components(source):
    marks = {i: mark(t) for i, t in source}
    seen, names = {}, {}
    for i in sorted(marks):
        if i in seen:
            continue
        seen[i], front = i, [i]
        while front:
            a = front.pop()
            for b in marks:
                if b not in seen and (marks[a] ^ marks[b]).bit_count() <= 3:
                    seen[b] = i
                    front.append(b)
    names.update(seen)
    return marks, names


def test_near_duplicates_equal_brute_force(spark):
    source = [(r.doc_id, r.text) for r in read(spark, DATA, "documents").collect()]
    marks, names = near_components(source)
    rows = queries.op5_simhash(spark, DATA).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {i: (f"{marks[i]:016x}", names[i]) for i in marks}
    assert len(set(names.values())) < len(names)


def test_spark_hashes_shingles_alike(spark):
    text = "ä one two"
    assert spark.createDataFrame([(text,)], "t string").select(F.xxhash64("t")).first()[0] % 2**64 == mark(text)


def test_golay_keys_meet_for_every_pattern_of_errors(spark):
    import numpy as np

    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(400)]
    pairs = [(m, m ^ sum(1 << b for b in rng.sample(range(64), rng.choice([0, 1, 2, 3, 3, 3])))) for m in base]

    def keys(marks):
        found = [set() for _ in marks]
        for key, row in simhash._keys_of(np.array(marks, np.uint64)):
            for k, r in zip(key.tolist(), row.tolist()):
                found[r].add(k)
        return found

    assert all(a & b for a, b in zip(keys([p[0] for p in pairs]), keys([p[1] for p in pairs])))


@pytest.mark.parametrize("rows", [simhash.BUCKET_ROWS, 40])
def test_links_of_a_dense_cluster(spark, monkeypatch, rows):
    monkeypatch.setattr(simhash, "BUCKET_ROWS", rows)  # 40: hot buckets are split
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    marks = {centre} | {centre ^ (1 << rng.randrange(8)) ^ (1 << rng.randrange(20, 24)) ^ (1 << rng.randrange(50, 60)) for _ in range(300)}
    marks |= {rng.getrandbits(64) for _ in range(300)}
    signed = [m - 2**64 if m >= 2**63 else m for m in marks]
    edges = simhash.near_edges(spark.createDataFrame([(m,) for m in signed], "mark long"))
    got = {r.node: r.component for r in common.components(edges).collect()}
    group, seen = {}, set()
    for m in sorted(signed):
        if m not in seen:
            front, members = [m], {m}
            while front:
                a = front.pop()
                fresh = {b for b in signed if b not in members and ((a ^ b) % 2**64).bit_count() <= 3}
                members |= fresh
                front += fresh
            seen |= members
            group |= dict.fromkeys(members, min(members)) if len(members) > 1 else {}
    assert got == group


def test_near_stage_and_awkward_rows(spark):
    docs = documents(spark, [*AWKWARD, (30, "ONE")], extra=True)
    out = simhash.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    ids = sorted(r.doc_id for r in out.collect() if r.doc_id is not None)
    assert 4 in ids and 30 not in ids and 1 in ids and 2 not in ids
    assert simhash.near_duplicate_groups(docs.filter(F.lit(False))).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101 + i) for i in range(50)] + [(7, 7)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(41), 0) | dict.fromkeys(range(100, 151), 100)


def test_bitmap_and_anti_join(spark):
    docs = documents(spark, [f"t{i}" for i in range(500)])
    gone = spark.createDataFrame([(i,) for i in range(0, 500, 7)], "doc_id long")
    assert sorted(r.doc_id for r in common.without_ids(docs, gone).collect()) == [i for i in range(500) if i % 7]
    marked = common.with_maybe(docs, [F.col("doc_id")], common.key_bitmap(gone), "maybe").filter("maybe").count()
    assert 72 <= marked <= 75


def test_hot_groups_join_as_others(spark):
    rows = [(i, "hot" if i % 3 else f"g{i % 30}") for i in range(3000)]
    members = spark.createDataFrame(rows, "id long, key string")
    groups = members.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    got = {(r.id, r.key, r.n, r["first"]) for r in common.join_groups(members, groups, "key", "n").collect()}
    counts = {k: [i for i, g in rows if g == k] for k in {g for _, g in rows}}
    assert got == {(i, g, len(counts[g]), min(counts[g])) for i, g in rows}


# ---- lines ----------------------------------------------------------------------

def edit_at_most_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    if len(a) == len(b):
        return a[same + 1 :] == b[same + 1 :]
    a, b = sorted((a, b), key=len)
    return a[same:] == b[same + 1 :]


def brute_lines(source):
    lines = []
    for doc_id, text in source:
        for number, line in enumerate((text or "").split("\n")):
            if words := WORDS.findall(line):
                lines.append(((doc_id is None, doc_id or 0, number), words))
    lines.sort(key=lambda x: x[0])
    out = {}
    for i, (place, words) in enumerate(lines):
        equal = next((p for p, w in lines[:i] if w == words and p < place), None)
        near = None
        if equal is None and len(words) >= 5:
            near = next((p for p, w in lines[:i] if p < place and len(w) >= 5 and w != words and edit_at_most_one(w, words)), None)
        if equal or near:
            out[place[1:]] = ((equal or near)[1:], equal is None)
    return out


def line_rows(df):
    return {(r.doc_id or 0, r.number): ((r.first_id or 0, r.first_number), r.near) for r in df.collect()}


@pytest.fixture(scope="module")
def line_texts():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(12)]
    base = [[rng.choice(words) for _ in range(rng.randint(3, 9))] for _ in range(25)]
    texts = []
    for i in range(60):
        lines = []
        for _ in range(rng.randint(0, 4)):
            line = list(rng.choice(base))
            if rng.random() < 0.6:
                at = rng.randrange(len(line))
                line[at : at + rng.randint(0, 1)] = [rng.choice(words)] * rng.randint(0, 1)
            lines.append("  ".join(line))
        texts.append((i, "\n".join(lines)))
    return texts


def test_repeated_lines_equal_brute_force(spark, line_texts):
    got = line_rows(line_dedup.duplicate_lines(documents(spark, line_texts)))
    want = brute_lines(line_texts)
    assert got == want and {near for _, near in want.values()} == {True, False}


def test_line_query_equals_brute_force(spark):
    source = [(r.doc_id, r.text) for r in read(spark, DATA, "documents").collect()]
    want = brute_lines(source)
    for r in queries.op8_line_dedup(spark, DATA).collect():
        numbers = sorted(n for i, n in want if i == r.doc_id)
        assert r.dropped == ",".join(map(str, numbers))
        assert r.n_near == sum(want[r.doc_id, n][1] for n in numbers) and r.n_equal + r.n_near == len(numbers)


def test_line_rewriting_and_awkward_rows(spark):
    rows = [(1, "a b c d e\nkeep me\n\nkeep me"), (2, "a b X d e\nother"), (3, None), (4, ""), (None, "other")]
    docs = documents(spark, rows, extra=True)
    out = line_dedup.drop_duplicate_lines(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in out.collect() if r.text) == [(0, "other"), (1, "a b c d e\nkeep me\n"), (2, "other")]
    assert line_dedup.line_report(docs.filter(F.lit(False))).count() == 0
