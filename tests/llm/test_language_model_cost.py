"""What training reads, and a training step against plain arithmetic."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyroute.llm import language_model as L

from .samples import documents
from .test_language_model import summary


def test_training_reads_each_text_once(spark):
    texts = [f"w{k % 7} w{k % 5} last" for k in range(40)]
    counts = summary(Counter(w for t in texts for w in [*t.split(), ""]))
    seen = spark.sparkContext.accumulator(0)

    def read(text):
        seen.add(1)
        return text

    df = documents(spark, texts).withColumn("text", F.udf(read, "string")("text"))
    model = L.fit(df, counts, rounds=3)
    assert seen.value == len(texts)
    assert np.abs(model.tables["places"] - 1).max() > 0


def test_counts_do_not_depend_on_when_they_are_sent(spark, monkeypatch):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("aA éÉ b\x1fc \t\x0b日本 x").split(" ")[0] + str(rng.randint(0, 9)) for _ in range(30)) for _ in range(50)] + ["", None]
    want = Counter(w for t in texts for w in [*L.words_of(t), b""])
    whole = {r.word.encode(): r.n for r in L.token_counts(documents(spark, texts)).collect()}
    assert whole == want
    monkeypatch.setattr(L, "_COUNTED", 5)
    monkeypatch.setattr(L, "_ROWS_OUT", 3)
    got = Counter()
    for batch in L._count_part(iter([L.pa.RecordBatch.from_arrays([L.pa.array([t or "" for t in texts])], ["text"])])):
        assert len(batch) <= 3
        for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            got[word.encode()] += n
    assert got == want


def plain_step(model, stream, rng):
    """One step token by token, in doubles; classes of many words are not in it."""
    tables = {n: t.astype(np.float64) for n, t in model.tables.items()}
    gradient = {n: np.zeros_like(t) for n, t in tables.items()}

    def slopes(name, first, last, share, q, target):
        own = tables[name][first:last]
        scores = own[:, :-1] @ q + own[:, -1]
        odds = 1 / (1 + np.exp(-(scores - np.log(L.NOISE * share))))
        slope = -L.NOISE * share * odds
        slope[target] += 1 - odds[target]
        gradient[name][first:last] += slope[:, None] * np.append(q, 1)
        return slope @ own[:, :-1]

    for at in range(L.CONTEXT, len(stream)):
        i = int(stream[at])
        if i == model.start:
            continue
        before = [int(stream[at - 1 - k]) for k in range(L.CONTEXT)]
        q = sum(tables["inputs"][b] * tables["places"][k] for k, b in enumerate(before))
        own = int(model.classes_of(np.array([i]))[0])
        to_q = slopes("classes", 0, len(tables["classes"]), model.class_share, q, own)
        if own < model.n_classes:
            first, last = model.starts[own], model.starts[own + 1]
            if last - first > 1:
                to_q = to_q + slopes("outputs", first, last, model.word_share[first:last], q, i - first)
        for k, b in enumerate(before):
            gradient["inputs"][b] += to_q * tables["places"][k]
            gradient["places"][k] += to_q * tables["inputs"][b]
    for name, g in gradient.items():
        tables[name] += g * (L.RATE / np.sqrt(1e-6 + (g * g).mean(axis=1)))[:, None]
    return tables


@pytest.mark.parametrize("length", [1, 64, 1500])
@pytest.mark.parametrize("kind", [np.int64, np.uint16])
def test_a_step_is_that_of_plain_arithmetic(length, kind):
    counts = Counter({f"w{k}": 3000 // (k + 1) + 1 for k in range(300)} | {"": 500})
    held = summary(counts, vocabulary_bits=8)
    model = L.LogBilinear(held)
    assert 2 <= np.diff(model.starts).max() <= L.DRAWN
    rng = np.random.default_rng(length)
    for table in model.tables.values():
        table += rng.normal(0, 0.3, table.shape).astype(np.float32)
    stream = rng.integers(0, model.start + 1, length + L.CONTEXT).astype(kind)
    stream[-1] = 1
    want = plain_step(model, stream, rng)
    trainer = L.Trainer(model, seed=1)
    trainer.step(stream)
    for name, table in want.items():
        assert np.allclose(trainer.tables[name], table, rtol=1e-3, atol=2e-4), name
    real = stream[L.CONTEXT :] != model.start
    assert trainer.weights["classes"].sum() == real.sum() and trainer.weights["inputs"].sum() == len(stream)


def test_far_scores_keep_finite_logs():
    one = np.ones((3, L.DIMENSIONS + 1), np.float32)
    table = np.zeros((4, L.DIMENSIONS + 1), np.float32)
    table[:, -1] = [-200, 300, 299, -400]
    logs = L._log_softmax_at(one, table, np.array([1, 2, 3]))
    top = -np.log1p(np.exp(-1.0))
    assert logs == pytest.approx([top, top - 1, top - 700], abs=1e-3)
    table[:, -1] = [-200, -300, -201, -400]
    logs = L._log_softmax_at(one, table, np.array([0, 2, 1]))
    assert logs == pytest.approx([top, top - 1, top - 100], abs=1e-3)
