"""The language model against plain arithmetic, and its gain on documents it has not seen."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tallyroute.llm import language_model as L, queries

from ..conftest import DATA
from .samples import AWKWARD, WORDS, documents, read

LOWER = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
NAMES = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def fold(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7


def tokens(text):
    return [w.translate(LOWER) for w in WORDS.findall(text or "")] + [""]


def counted(source):
    return Counter(w for i, t in source if fold(i) != 2 for w in tokens(t))


def brute_base(source):
    counts = counted(source)
    n, v = sum(counts.values()), len(counts)
    return sorted((
        (i, fold(i) == 2, len(ws), sum(w in counts for w in ws), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 6))
        for i, t in source for ws in [tokens(t)]
    ), key=repr)


def base_of(rows):
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows), key=repr)


def summary(counts, vocabulary_bits=L.VOCABULARY_BITS, count_bits=L.COUNT_BITS):
    """``count_summary`` by hand."""
    total = sum(counts.values())
    held = {w: n for w, n in counts.items() if n << vocabulary_bits >= total or not w}
    words = sorted(held, key=lambda w: (-held[w], w.encode()))
    rest = np.ones(L.ENDINGS)
    for w, n in counts.items():
        if w not in held:
            rest[zlib.crc32(w.encode()[-2:]) % L.ENDINGS] += n + 1
    known = {w.encode(): n for w, n in counts.items() if w not in held and n << count_bits >= total}
    return L.Counts(total, len(counts), [w.encode() for w in words], np.array([held[w] for w in words], np.int64), known, rest)


def brute_score(model, summary_, counts, text):
    """Word by word: softmax over all classes, softmax over the words of one."""
    number = {w.decode(): i for i, w in enumerate(summary_.words)}
    rest = lambda w: zlib.crc32(w.encode()[-2:]) % L.ENDINGS
    ids = [number.get(w, model.size + rest(w)) for w in tokens(text)]
    total = 0.0
    tables = {n: t.astype(np.float64) for n, t in model.tables.items()}
    for at, (w, i) in enumerate(zip(tokens(text), ids)):
        before = [ids[at - k - 1] if at > k else model.start for k in range(L.CONTEXT)]
        q = sum(tables["inputs"][b] * tables["places"][k] for k, b in enumerate(before))
        total += math.log10(chances(model, tables, q, i))
        if i >= model.size:
            total += math.log10((counts[w] + 1) / summary_.rest[rest(w)])
    return total


def chances(model, tables, q, i):
    scores = tables["classes"][:, :-1] @ q + tables["classes"][:, -1]
    classes = np.exp(scores - scores.max()) / np.exp(scores - scores.max()).sum()
    if i >= model.size:
        return classes[model.n_classes + i - model.size]
    c = model.class_of[i]
    part = tables["outputs"][model.starts[c] : model.starts[c + 1]]
    inner = part[:, :-1] @ q + part[:, -1]
    inner = np.exp(inner - inner.max()) / np.exp(inner - inner.max()).sum()
    return classes[c] * inner[i - model.starts[c]]


def texts(seed, count):
    rng = random.Random(seed)
    half = [[f"{p}{k}" for k in range(60)] for p in ("de", "En")]
    return [" ".join(rng.choice(half[i % 2])[: rng.choice([2, 9])] for _ in range(rng.randint(0, 60))) for i in range(count)]


@pytest.fixture(scope="module")
def source():
    return [(i if i % 50 else None, t) for i, t in enumerate(texts(1, 300) + ["Ünï ÀB\x1fc ab", "日本 日本"] * 2)]


def test_base_and_summary_equal_brute_force(spark, source):
    df = documents(spark, [(i, t, "s") for i, t in source], extra=True)
    got = L.language_model_scores(df)
    assert got.columns == NAMES
    assert base_of(got.collect()) == brute_base(source)
    counts = counted(source)
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    for bits in ((15, 18), (4, 6), (0, 0)):
        one, two = L.count_summary(table, *bits), summary(counts, *bits)
        assert (one.tokens, one.distinct, one.words, one.known) == (two.tokens, two.distinct, two.words, two.known)
        assert np.array_equal(one.rest, two.rest) and np.array_equal(one.numbers, two.numbers)
        assert len(one.words) <= (1 << bits[0]) + 1


def test_scores_equal_a_walk_over_the_words(spark, source):
    """Of the model that the query trains, whose rounds repeat to the same tables."""
    df = documents(spark, [(i, t, "s") for i, t in source])
    counts = counted(source)
    held = summary(counts)
    model = L.fit(df.filter(L.crc_fold(df.doc_id, 7) != 2), held)
    again = L.fit(df.filter(L.crc_fold(df.doc_id, 7) != 2), held)
    assert all(np.array_equal(model.tables[n], again.tables[n]) for n in model.tables)
    want = sorted((repr(i), brute_score(model, held, counts, t)) for i, t in source)
    got = sorted((repr(r.doc_id), r.score) for r in L.language_model_scores(df).collect())
    assert [i for i, _ in got] == [i for i, _ in want]
    assert [x for _, x in got] == pytest.approx([x for _, x in want], abs=0.01)


def test_probabilities_add_up_to_one():
    counts = Counter({f"w{k}": 2000 // (k + 1) + 1 for k in range(3000)} | {"": 500})
    held = summary(counts, vocabulary_bits=9)
    model = L.LogBilinear(held)
    rng = np.random.default_rng(3)
    for table in model.tables.values():
        table += rng.normal(0, 0.5, table.shape).astype(np.float32)
    ids = np.arange(model.size + L.ENDINGS)
    for _ in range(3):
        context = rng.integers(0, model.start, L.CONTEXT)
        logs = np.concatenate([model.log_probability(np.append(context, i))[-1:] for i in ids])
        assert abs(np.exp(logs).sum() - 1) < 1e-5
    # in an ending's class: every rare word by its smoothed count, and one unseen word
    rare = Counter(L.ending_of(w.encode()) for w in counts if w.encode() not in held.words for _ in range(counts[w] + 1))
    assert all(held.rest[e] == rare[e] + 1 for e in range(L.ENDINGS))


def test_untrained_model_is_the_unigram_model():
    counts = Counter({f"w{k}": 100 - k for k in range(90)} | {"": 9})
    held = summary(counts)
    model = L.LogBilinear(held)
    logs = model.log_probability(np.append([model.start] * L.CONTEXT, np.arange(model.size)))[L.CONTEXT :]
    total = sum(counts.values()) + len(counts) + held.rest.sum()
    assert np.allclose(np.exp(logs), (held.numbers + 1) / total, rtol=1e-4)


def test_training_reaches_what_the_words_before_tell():
    """A word that depends on the one before it alone: the chance rises towards the true one."""
    rng = np.random.default_rng(5)
    size = 200  # large enough for classes whose noise is drawn
    counts = Counter({f"w{k:03}": 1000 for k in range(size)} | {"": 1})
    held = summary(counts)
    model = L.LogBilinear(held)
    trainer = L.Trainer(model, seed=1)
    walk = [0]
    for _ in range(60_000):
        walk.append((walk[-1] * 7 + int(rng.integers(0, 4))) % size)
    ids = np.array(walk)
    before = model.log_probability(ids[-5000:])[L.CONTEXT :].mean()
    for _ in range(4):
        for at in range(L.CONTEXT, 55_000, 1000):
            trainer.step(ids[at - L.CONTEXT : at + 1000])
    after = model.log_probability(ids[-5000:])[L.CONTEXT :].mean()
    assert before < -5 and after > before + 1.5


def test_awkward_rows(spark):
    source = [(r[0], r[1]) for r in AWKWARD]
    rows = L.language_model_scores(documents(spark, AWKWARD, extra=True)).collect()
    assert base_of(rows) == brute_base(source) and all(math.isfinite(r.score) and r.score < 0 for r in rows)
    assert L.language_model_scores(documents(spark, [])).count() == 0


def test_without_training_rows_all_words_are_alike(spark):
    held = [i for i in range(200) if fold(i) == 2][:5]
    rows = L.language_model_scores(documents(spark, [(i, "a b c", "s") for i in held])).collect()
    assert {(r.base_score, r.train_tokens, r.n_known) for r in rows} == {(0.0, 0, 0)}
    assert all(r.score == pytest.approx(4 * math.log10(1 / L.ENDINGS)) for r in rows)


@pytest.mark.parametrize("folder", [DATA, DATA.replace("0.001", "0.01")])
def test_query_base_and_held_out_gain(spark, folder):
    source = [(r.doc_id, r.text) for r in read(spark, folder, "documents").collect()]
    rows = queries.op11_language_model(spark, folder).collect()
    assert base_of(rows) == brute_base(source)
    unseen = [r for r in rows if r.held_out]
    tokens_ = sum(r.n_tokens for r in unseen)
    gain = sum(r.score - r.base_score for r in unseen) / tokens_
    assert gain > (0.2 if "0.001" in folder else 0.3)
    # the smallest table has 27 such documents
    assert sum(r.score > r.base_score for r in unseen) > (0.9 if "0.001" in folder else 0.98) * len(unseen)
