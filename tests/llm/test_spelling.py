"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

from tallyroute.llm import queries, spelling

from ..conftest import DATA
from .samples import AWKWARD, documents, read

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def brute_words(source):
    counts = Counter()
    for doc_id, text in source:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def near(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) != 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i:] == b[i + 1 :]


def brute_groups(counts):
    # words within one edit have one half in common, at its place from the front or the back
    words, partners = sorted(counts), {w: set() for w in counts}
    halves = {}
    for w in words:
        for size in (len(w) - 1, len(w), len(w) + 1):
            if abs(size - len(w)) <= 1:
                m = max(size, len(w)) // 2
                halves.setdefault(("front", m, w[:m]), []).append(w)
                rest = max(size, len(w)) - m - 1
                halves.setdefault(("back", rest, w[len(w) - rest :]), []).append(w)
    for members in halves.values():
        members = sorted(set(members))
        for i, a in enumerate(members):
            for b in members[i + 1 :]:
                if b not in partners[a] and near(a, b):
                    partners[a].add(b)
                    partners[b].add(a)
    forms = {}
    for w in words:
        best = min(partners[w], key=lambda o: (-counts[o], o), default=None)
        forms[w] = best if best is not None and counts[best] >= 10 * counts[w] else None
    out = set()
    for w in words:
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.add((w, forms[w], root, counts[w], len(partners[w]), counts[forms[w]] if forms[w] else None))
    return out


def rows_of(df):
    rows = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def counted(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long")


def test_brute_force_halves_miss_no_pair():
    rng = random.Random(5)
    counts = {"".join(rng.choice("ab") for _ in range(rng.randint(3, 7))): rng.choice([1, 10, 100]) for _ in range(120)}
    found = {w: r[4] for r in brute_groups(counts) for w in [r[0]]}
    assert found == {w: sum(near(w, o) for o in counts if o != w) for w in counts}


def test_words_of_texts(spark):
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choice("abcÀéZ") for _ in range(rng.randint(5, 9))) for _ in range(40)) for _ in range(60)]
    source = [(i if i % 7 else None, t if i % 5 else t.replace(" ", "9")) for i, t in enumerate(texts * 2)]
    df = documents(spark, [(i, t, "s") for i, t in source])
    assert {r.word: r.n for r in spelling.words_of(df).collect()} == brute_words(source)


def test_groups_equal_brute_force(spark):
    rng = random.Random(2)
    counts = {}
    for alphabet, size in (("ab", 9), ("abcé", 8), ("ÀÿÞ", 7)):
        for _ in range(400):
            counts["".join(rng.choice(alphabet) for _ in range(rng.randint(size - 1, size + 1)))] = rng.choice([2, 3, 20, 30, 200, 2000, 20_000])
    assert rows_of(spelling.spelling_groups(counted(spark, counts))) == brute_groups(counts)


def test_long_words_and_the_border_between_both_forms(spark):
    rng = random.Random(3)
    counts = {}
    for size in (63, 64, 65, 66, 300):
        for _ in range(6):
            word = [rng.choice("ab") for _ in range(size)]
            for _ in range(12):
                counts["".join(word)] = rng.choice([2, 20, 30, 300, 3000])
                edit, at = rng.randrange(3), rng.randrange(len(word))
                if edit == 0:
                    word[at] = rng.choice("abé")
                elif edit == 1:
                    word.insert(at, rng.choice("ab"))
                else:
                    del word[at]
    want = brute_groups(counts)
    assert sum(r[4] > 0 for r in want) > 100
    assert rows_of(spelling.spelling_groups(counted(spark, counts))) == want


def test_a_chain_of_forms_and_ties(spark):
    counts = {"abcdefg": 2, "abcdefgh": 20, "abcdefghi": 200, "abcdefghij": 2000, "bbcdefghij": 2000, "aaaaaaa": 5, "aaaaaaaa": 50, "aaaaaab": 50}
    got = {r[0]: r for r in rows_of(spelling.spelling_groups(counted(spark, counts)))}
    assert got["abcdefg"][1:3] == ("abcdefgh", "abcdefghij") and got["abcdefghi"][2] == "abcdefghij"
    assert got["aaaaaaa"] == ("aaaaaaa", "aaaaaaaa", "aaaaaaaa", 5, 2, 50)
    assert set(got.values()) == brute_groups(counts)


def test_rotations_hold_every_letter_once(spark):
    rows = spelling.rotations(counted(spark, {"abbc": 2})).collect()
    assert sorted(r.shared + r.last for r in rows if r.last) == sorted(["bbc$a", "bc$ab", "c$abb", "$abbc"])
    assert sorted(r.shared for r in rows if not r.last) == sorted(["abbc$", "bbc$a", "bc$ab", "c$abb", "$abbc"])
    assert sum(r.first for r in rows) == 3


def test_awkward_rows(spark):
    long = [(20, "y" * 5000), (21, "y" * 5000 + " " + "y" * 4999), (22, "y" * 4999 + "z")]
    rows = [*AWKWARD, *[(i, t, "a") for i, t in long], (23, "x" * 30_000, "a")]
    source = [(r[0], r[1]) for r in rows]
    got = rows_of(spelling.spelling_variants(documents(spark, rows, extra=True)))
    assert got == brute_groups(brute_words(source)) and any(len(r[0]) > 20_000 for r in got)
    assert spelling.spelling_variants(documents(spark, [])).count() == 0


@pytest.mark.parametrize("folder", [DATA, DATA.replace("0.001", "0.01")])
def test_query_equals_brute_force(spark, folder):
    source = [(r.doc_id, r.text) for r in read(spark, folder, "documents").collect()]
    assert rows_of(queries.op13_spelling(spark, folder)) == brute_groups(brute_words(source))
