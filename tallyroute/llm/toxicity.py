"""Toxicity from class-conditional Kneser-Ney models over the letters of words.

Two interpolated models of order ORDER, one of toxic and one of ordinary training
text, give each word of a document a log-likelihood under either class. Rare
expressions lean on the orders below, whose continuation counts both classes
share, so an inflected form never seen before still gets its stem's odds. The
length-normalised log ratio of the document and of its strongest words goes
through a logistic curve fitted on training rows that the counts have not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import crc_fold, map_batches, saved, small_side, text_of, text_runs

ORDER = 5
DISCOUNT = 0.75
# letter sequences are identified by a hash of BUCKET_BITS bits: 2^21 rows at most
BUCKET_BITS = 21
# labels are broadcast up to this many rows; beyond it the join shuffles
LABEL_BOUND = 4_000_000
# documented bound of the sample that fits the logistic curve over FEATURES
CURVE_ROWS = 50_000
FEATURES = ("mean", "second", "three", "length")
HELD_OUT_FOLD, CURVE_FOLD = 0, 1
# words whose ratio a task remembers before it starts afresh
WORD_CACHE = 250_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_START, _END = "\x02", "\x03"


# ---- letter sequences -----------------------------------------------------------

def _bucket(hashes: np.ndarray) -> np.ndarray:
    mixed = (hashes ^ (hashes >> np.uint64(31))) * _MIX
    return (mixed >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _grams(words: list[str]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Over all letters of the words, each word padded in front and ended: the word's
    number, and per order 1..ORDER the buckets of the sequence and of its context."""
    pad = _START * (ORDER - 1)
    codes = np.frombuffer("".join([pad + w + _END for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = codes.astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    owner = np.repeat(np.arange(len(words)), lengths)
    at = np.arange(lengths.sum()) + (owner + 1) * (ORDER - 1)
    sequence, context = [], []
    before = np.full(len(codes), 7, np.uint64)  # hash of the empty sequence
    for order in range(1, ORDER + 1):
        earlier = np.roll(before, 1)
        now = (earlier * np.uint64(1_000_003) + codes + np.uint64(order)) * _MIX
        now ^= now >> np.uint64(29)
        sequence.append(_bucket(now[at]))
        context.append(_bucket(earlier[at]))
        before = now
    return owner, sequence, context


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, ordinary, toxic) rows to counts per top sequence; repeats within a batch are summed."""
    names = ["gram", "ordinary", "toxic", *(f"c{k}" for k in range(1, ORDER + 1)), *(f"s{k}" for k in range(1, ORDER))]
    for batch in batches:
        if not batch.num_rows:
            continue
        owner, sequence, context = _grams(batch.column(0).to_pylist())
        gram, first, back = np.unique(sequence[-1], return_index=True, return_inverse=True)
        sums = [np.bincount(back, batch.column(k).to_numpy()[owner]).astype(np.int64) for k in (1, 2)]
        columns = [gram, *sums, *(c[first] for c in context), *(s[first] for s in sequence[:-1])]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names)


@dataclass
class Model:
    """Arrays over buckets: discounted probability of a sequence, weight passed down by its context."""

    top: tuple[np.ndarray, np.ndarray]      # per class, of the top order
    top_down: tuple[np.ndarray, np.ndarray]
    shared: np.ndarray                      # of all lower orders, both classes together
    shared_down: np.ndarray
    curve: np.ndarray | None = None         # logistic weights, the constant first

    # only buckets in use are sent to the tasks
    def __getstate__(self) -> dict:
        sparse = lambda arrays, rest: [(i := np.flatnonzero(a != rest).astype(np.uint32), a[i]) for a in arrays]
        return {
            "kept": sparse([*self.top, self.shared], 0), "down": sparse([*self.top_down, self.shared_down], 1),
            "curve": self.curve,
        }

    def __setstate__(self, state: dict) -> None:
        def full(pairs: list, rest: int) -> list[np.ndarray]:
            arrays = [np.full(1 << BUCKET_BITS, rest, np.float32) for _ in pairs]
            for array, (places, values) in zip(arrays, pairs):
                array[places] = values
            return arrays

        *self.top, self.shared = full(state["kept"], 0)
        *self.top_down, self.shared_down = full(state["down"], 1)
        self.curve = state["curve"]

    def word_ratios(self, words: list[str]) -> np.ndarray:
        """Log-likelihood of each word under the toxic model less that under the ordinary one."""
        owner, sequence, context = _grams(words)
        lower = np.full(len(owner), 1 / 512)
        for k in range(ORDER - 1):
            lower = self.shared[sequence[k]] + self.shared_down[context[k]] * lower
        by_class = [
            self.top[x][sequence[-1]] + self.top_down[x][context[-1]] * lower for x in (0, 1)
        ]
        return np.bincount(owner, np.log(by_class[1] / by_class[0]), len(words))


def _level(sequence: np.ndarray, context: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Absolute discounting of one order: kept probabilities and the context's weight for the order below."""
    size = 1 << BUCKET_BITS
    seen = counts > 0
    totals = np.bincount(context, counts, size)
    kinds = np.bincount(context[seen], minlength=size)
    kept, down = np.zeros(size, np.float32), np.ones(size, np.float32)
    kept[sequence] = np.maximum(counts - DISCOUNT, 0) / np.maximum(totals[context], 1)
    known = totals > 0
    down[known] = DISCOUNT * kinds[known] / totals[known]
    return kept, down


def build_model(grams: dict[str, np.ndarray]) -> Model:
    """From one row per top sequence to the arrays; lower orders count distinct left extensions."""
    top = [_level(grams["gram"], grams[f"c{ORDER}"], grams[name].astype(float)) for name in ("ordinary", "toxic")]
    kept, down = np.zeros(1 << BUCKET_BITS, np.float32), np.ones(1 << BUCKET_BITS, np.float32)
    for k in range(ORDER - 1, 0, -1):
        # distinct sequences of order k+1 that end in each sequence of order k
        longer = grams["gram"] if k == ORDER - 1 else grams[f"s{k + 1}"]
        _, one = np.unique(longer, return_index=True)
        sequence, first, back = np.unique(grams[f"s{k}"][one], return_index=True, return_inverse=True)
        counts = np.bincount(back, minlength=len(sequence)).astype(float)
        own, own_down = _level(sequence, grams[f"c{k}"][one][first], counts)
        # the orders' hashes differ, so one array holds them all
        np.maximum(kept, own, out=kept)
        np.minimum(down, own_down, out=down)
    return Model((top[0][0], top[1][0]), (top[0][1], top[1][1]), kept, down)


# ---- documents ------------------------------------------------------------------

class _Scorer:
    def __init__(self, model: Model) -> None:
        self.model, self.known = model, {}

    def features(self, texts: list[str]) -> np.ndarray:
        """FEATURES of each text: the mean word ratio, the second highest, the mean of the
        three highest, and the log of the number of words, among which those were the highest."""
        if len(self.known) > WORD_CACHE:
            self.known = {}
        # bytes.split cuts at the six contract spaces
        split = [t.encode("utf-8", "surrogatepass").split() for t in texts]
        ratios = [np.array(list(map(self.known.get, words)), float) for words in split]  # unknown: nan
        missing = [np.flatnonzero(np.isnan(ratio)).tolist() for ratio in ratios]
        fresh = list({words[i] for words, places in zip(split, missing) for i in places})
        for at in range(0, len(fresh), 20_000):
            part = fresh[at : at + 20_000]
            names = [w.decode("utf-8", "surrogatepass") for w in part]
            self.known |= zip(part, self.model.word_ratios(names).tolist())
        out = np.zeros((len(texts), len(FEATURES)))
        for row, (words, ratio, places) in enumerate(zip(split, ratios, missing)):
            if words:
                if places:
                    ratio[places] = [self.known[words[i]] for i in places]
                high = np.zeros(3)
                top = ratio if len(ratio) <= 3 else np.partition(ratio, len(ratio) - 3)[-3:]
                high[: len(top)] = np.sort(top)[::-1]
                out[row] = min(1.0, max(-1.0, ratio.mean())), high[1], high.mean(), np.log1p(len(words))
        return out


def fit_curve(x: np.ndarray, y: np.ndarray, penalty: float = 2e-5) -> np.ndarray:
    """Logistic weights, the constant first, by Newton steps with a small ridge.

    Without both classes the curve is flat, on the side of the class there is
    (the ordinary one if there is none).
    """
    if len(y) == 0 or y.min() == y.max():
        return np.array([4.0 if len(y) and y[0] else -4.0, *[0.0] * x.shape[1]])
    middle, spread = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack((np.ones(len(x)), (x - middle) / spread))
    ridge = penalty * np.diag([0.0, *[1.0] * x.shape[1]])
    weights = np.zeros(z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ weights, -30, 30)))
        slope = z.T @ (p - y) / len(y) + ridge @ weights
        bend = (z * (p * (1 - p) / len(y))[:, None]).T @ z + ridge + 1e-9 * np.eye(len(weights))
        step = np.linalg.solve(bend, slope)
        weights -= step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return np.array([weights[0] - (weights[1:] * middle / spread).sum(), *(weights[1:] / spread)])


def _training_rows(docs: DataFrame, labels: DataFrame, id_column: str, text_column: str, label: str) -> DataFrame:
    """(fold, toxic, text) of the labelled rows outside the held-out fold; an id with several labels takes the largest."""
    marks = labels.filter(F.col(id_column).isNotNull() & F.col(label).isNotNull())
    marks = marks.groupBy(F.col(id_column).alias("labelled")).agg(F.max(label).cast("int").alias("toxic"))
    marks = marks.filter(crc_fold(F.col("labelled")) != HELD_OUT_FOLD)
    rows = docs.select(F.col(id_column).alias("labelled"), F.lower(text_of(text_column)).alias("text"))
    return rows.join(small_side(marks, LABEL_BOUND), "labelled").select(
        "labelled", crc_fold(F.col("labelled")).alias("fold"), "toxic", "text"
    )


def train(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label: str = "toxic"
) -> Model:
    """Counts over all labelled rows outside the held-out and curve folds, then the curve.

    Words are counted map-side and by one shuffle; the letter counts that reach
    the driver have at most 2^BUCKET_BITS rows. Only the curve of five numbers
    is fitted on a bounded sample (CURVE_ROWS labelled rows by hash).
    """
    rows = _training_rows(docs, labels, id_column, text_column, label)
    learn = rows.filter(F.col("fold") != CURVE_FOLD)
    words = learn.select("toxic", F.explode(F.split("text", "[ \\t-\\r]+")).alias("word")).filter("word <> ''")
    words = words.groupBy("word").agg(
        F.sum(F.expr("if(toxic = 1, 0L, 1L)")).alias("ordinary"), F.sum(F.expr("if(toxic = 1, 1L, 0L)")).alias("toxic")
    )
    more = [f"c{k}" for k in range(1, ORDER + 1)] + [f"s{k}" for k in range(1, ORDER)]
    kinds = ", ".join(f"{n} bigint" for n in ["gram", "ordinary", "toxic", *more])
    counted = map_batches(words, _count_grams, kinds).groupBy("gram").agg(
        F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"), *(F.min(n).alias(n) for n in more)
    )
    table = counted.toArrow()
    model = build_model({n: table.column(n).to_numpy() for n in table.column_names})
    sample = rows.filter(F.col("fold") == CURVE_FOLD).select("labelled", "toxic", "text")
    counted_model = docs.sparkSession.sparkContext.broadcast(model)
    features = saved(map_batches(sample, _feature_rows(counted_model), _FEATURE_ROWS), "curve")
    counted_model.destroy()
    few = features.orderBy(F.xxhash64("id"), "id").limit(CURVE_ROWS).toArrow()
    x = np.column_stack([few.column(n).to_numpy() for n in FEATURES])
    model.curve = fit_curve(x, few.column("toxic").to_numpy().astype(float))
    return model


_FEATURE_ROWS = "id string, toxic int, " + ", ".join(f"{n} double" for n in FEATURES)


def _feature_rows(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(model.value)
        for batch in batches:
            for start, texts in text_runs(batch.column(2).to_pylist()):
                x = scorer.features(texts)
                part = batch.slice(start, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.string()), part.column(1), *map(pa.array, x.T)],
                    ["id", "toxic", *FEATURES],
                )
    return run


def _score_rows(model, place: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(model.value)
        for batch in batches:
            texts_of = [(t or "").lower() for t in batch.column(place).to_pylist()]
            for start, texts in text_runs(texts_of):
                x = np.column_stack((np.ones(len(texts)), scorer.features(texts)))
                score = 1 / (1 + np.exp(-np.clip(x @ model.value.curve, -30, 30)))
                rest = batch.slice(start, len(texts))
                yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(score)], [*rest.schema.names, "__score"])
    return run


def with_toxicity(docs: DataFrame, model: Model, text_column: str = "text", name: str = "toxicity") -> DataFrame:
    """``docs`` with a score from 0 to 1 beside each row, in place: no join, no shuffle.

    The score depends on the text alone. Null and empty texts have no words and
    score by the curve's constant; repeated rows score alike; a column called
    ``name`` is replaced.
    """
    keep = docs.drop(name)
    if text_column in keep.columns:  # lowered in the task, so the text is sent once
        place, send = keep.columns.index(text_column), keep
    else:
        raise ValueError(f"no text column {text_column}")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep.schema.fields)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = map_batches(send, _score_rows(shared, place), f"{fields}, __score double")
    return scored.withColumnRenamed("__score", name)


def held_out(id_column: Column) -> Column:
    return crc_fold(id_column) == HELD_OUT_FOLD


def drop_toxic(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = 0.5
) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more, all columns as they were."""
    model = train(docs, labels, id_column, text_column)
    return with_toxicity(docs, model, text_column, "__toxicity").filter(f"__toxicity < {threshold}").drop("__toxicity")
