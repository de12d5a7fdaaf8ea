"""Language-model scores by a log-bilinear neural model with noise-contrastive training.

The vectors of the words before a token, each times the weights of its place, add up to
a prediction; a class, and in it a word, scores the product of the prediction with its own
vector plus a bias. Classes of about equal probability hold the words of the
vocabulary: those that make up a fixed share of all training tokens, so their number
is bounded. Rarer words, and words never seen, belong to a class by their ending; in it
they share the class's probability by their smoothed counts, which are taken over
all training documents and joined word by word. All probabilities add up to one.

Each round every partition of the training documents streams through a copy of the
model; the copies are averaged row by row, weighted by how often each was trained.
Training separates tokens from noise words of the unigram distribution, and needs
no normalisation; scores are normalised over all classes and over the words of a
class, by matrix products over batches of tokens.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import crc_fold, map_batches, saved, text_of, text_runs

FOLDS, HELD_OUT = 7, 2
# a word of the vocabulary is at least 1 / 2^15 of all training tokens, so there are 2^15 at most
VOCABULARY_BITS = 15
# words of at least 1 / 2^20 of all tokens have their counts broadcast, 2^20 at most
COUNT_BITS = 20
DIMENSIONS = 32
CONTEXT = 5
CLASSES = 32
ENDINGS = 64
# passes over all training documents
ROUNDS = 2
BATCH = 4096
RATE = 0.15
# noise words to each token, and how many are drawn in a class that has more words
NOISE = 64
DRAWN = 64
_RUN = 1_000_000
# rows that numpy multiplies in one loop, and tokens whose scores of all classes are held at once
_GROUP = 64
_ROWS_AT_ONCE = 1024
# tokens that are scored together, and how many scores are held at once
_SCORED_AT_ONCE = 1 << 14
_SCORES_AT_ONCE = 1 << 17
_BLOCK = 512
# words that a task counts, or characters that it reads, before it sends counts on; rows that it sends at once
_COUNTED = 1 << 18
_COUNTED_CHARS = 1 << 24
_ROWS_OUT = 1 << 15


# ---- counts ---------------------------------------------------------------------

def words_of(text: str | None) -> list[bytes]:
    """The words of a text, A-Z lowered, in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def ending_of(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % ENDINGS


def _count_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of a task's texts with their counts, sent on whenever many words or characters were counted."""
    found, ends, chars = Counter(), 0, 0

    def rows() -> Iterator[pa.RecordBatch]:
        words = pa.array(found.keys(), pa.binary()).cast(pa.string())
        both = pa.RecordBatch.from_arrays([words, pa.array(found.values(), pa.int64())], ["word", "n"])
        found.clear()
        for at in range(0, len(both), _ROWS_OUT):
            yield both.slice(at, _ROWS_OUT)

    for batch in batches:
        for text in batch.column(0).to_pylist():
            ends += 1
            chars += len(text)
            found.update(words_of(text))
            if len(found) > _COUNTED or chars > _COUNTED_CHARS:
                yield from rows()
                chars = 0
    if found:
        yield from rows()
    if ends:
        yield pa.RecordBatch.from_arrays([pa.array([""]), pa.array([ends], pa.int64())], ["word", "n"])


def token_counts(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """(word, n) of all texts; the token that ends each text is the empty word."""
    texts = docs.select(text_of(text_column).alias("text"))
    return map_batches(texts, _count_part, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Counts:
    """What a task needs to know of the counts; all parts are bounded."""

    tokens: int
    distinct: int
    words: list[bytes]  # the vocabulary, most frequent first
    numbers: np.ndarray  # its counts
    known: dict[bytes, int]  # counts of the next most frequent words
    rest: np.ndarray  # smoothed count of all rarer words by ending, with one for the unseen


def count_summary(counts: DataFrame, vocabulary_bits: int = VOCABULARY_BITS, count_bits: int = COUNT_BITS) -> Counts:
    """From the saved table of counts; what it brings to the driver is bounded by the two shares."""
    ending = (F.crc32(F.expr("substring(cast(word as binary), -2)")) % ENDINGS).cast("int")
    tokens, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    often = [(bytes(r.word), r.n) for r in counts.filter(F.col("n") * (1 << count_bits) >= tokens).select(
        F.col("word").cast("binary").alias("word"), "n").collect()]
    held = {w: n for w, n in often if n << vocabulary_bits >= tokens}
    if tokens:
        held[b""] = counts.filter("word = ''").first().n
    words = sorted(held, key=lambda w: (-held[w], w))
    rest = np.ones(ENDINGS, np.float64)
    for r in counts.groupBy(ending.alias("e")).agg((F.sum("n") + F.count("*")).alias("mass")).collect():
        rest[r.e] += r.mass
    for w in words:
        rest[ending_of(w)] -= held[w] + 1
    known = {w: n for w, n in often if w not in held}
    return Counts(tokens, distinct, words, np.array([held[w] for w in words], np.int64), known, rest)


# ---- model ----------------------------------------------------------------------

class LogBilinear:
    """Tables of rows: ``inputs`` (words, endings, the start), ``places``, ``classes`` and
    ``outputs``; the last column of the latter two is the bias."""

    def __init__(self, counts: Counts, seed: int = 42) -> None:
        mass = counts.numbers + 1.0
        size, total = len(mass), mass.sum() + counts.rest.sum()
        # words in order of frequency, cut where another share of the probability is full
        share = np.cumsum(mass) - mass
        label = np.minimum((share / max(mass.sum(), 1.0) * CLASSES).astype(np.int64), CLASSES - 1)
        fresh = np.flatnonzero(np.append(True, label[1:] != label[:-1])) if size else np.empty(0, np.int64)
        self.starts = np.append(fresh, size)
        self.n_classes = len(fresh)
        self.class_of = np.repeat(np.arange(self.n_classes), np.diff(self.starts))
        class_mass = np.add.reduceat(mass, fresh) if size else np.empty(0)
        self.class_share = np.concatenate((class_mass, counts.rest)) / total
        self.word_share = mass / class_mass[self.class_of] if size else mass
        self.size, self.start = size, size + ENDINGS
        rng = np.random.default_rng(seed)
        normal = lambda rows: (rng.standard_normal((rows, DIMENSIONS)) * 0.1).astype(np.float32)
        biased = lambda share: np.hstack([np.zeros((len(share), DIMENSIONS)), np.log(share)[:, None]]).astype(np.float32)
        self.tables = {
            "inputs": normal(size + ENDINGS + 1), "places": np.ones((CONTEXT, DIMENSIONS), np.float32),
            "classes": biased(self.class_share), "outputs": biased(self.word_share),
        }

    def sorted_tokens(self, ids: np.ndarray) -> np.ndarray:
        """Where tokens that are not the start stand, by their ids and so by their classes."""
        order = np.argsort(ids, kind="stable")
        return order[: np.count_nonzero(ids != self.start)]

    def classes_of(self, ids: np.ndarray) -> np.ndarray:
        """The class of each token: of its word, or of its ending."""
        out = ids.astype(np.int64) - self.size + self.n_classes
        own = ids < self.size
        out[own] = self.class_of[ids[own]]
        return out

    def predictions(self, stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the CONTEXT tokens before each token from CONTEXT on add up to, and the vectors of all.

        After the stream's own rows follow some of the start, which fill the last group of _GROUP.
        """
        count = -(-(len(stream) - CONTEXT) // _GROUP) * _GROUP
        filled = np.full(count + CONTEXT, self.start, stream.dtype)
        filled[: len(stream)] = stream
        vectors, tiles = self.tables["inputs"].take(filled, axis=0), _tiles(self.tables["places"])
        total, part = np.empty((count, DIMENSIONS), np.float32), np.empty((min(count, _ROWS_AT_ONCE), DIMENSIONS), np.float32)
        for at in range(0, count, _ROWS_AT_ONCE):
            own = _wide(total[at : at + _ROWS_AT_ONCE])
            more = _wide(part)[: len(own)]
            for k, tile in enumerate(tiles):
                first = at + CONTEXT - 1 - k
                np.multiply(_wide(vectors[first : first + min(_ROWS_AT_ONCE, count - at)]), tile, out=more if k else own)
                if k:
                    own += more
        return total, vectors

    def log_probability(self, stream: np.ndarray) -> np.ndarray:
        """Natural log of the probability of each token of a stream; zero where a text starts.

        Before every text the stream holds the start CONTEXT times. A rare word's
        is that of its ending's class.
        """
        out = np.zeros(len(stream), np.float64)
        for at in range(CONTEXT, len(stream), _SCORED_AT_ONCE):
            stop = min(at + _SCORED_AT_ONCE, len(stream))
            own = self.sorted_tokens(stream[at:stop])
            q, _ = self.predictions(stream[at - CONTEXT : stop])
            out[at + own] = self._log_batch(stream[at + own].astype(np.int64), q.take(own, axis=0))
        return out

    def _log_batch(self, ids: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Of tokens in the order of their ids, which is that of their classes."""
        own = self.classes_of(ids)
        one = _with_one(q)
        out = _log_softmax_at(one, self.tables["classes"], own)
        bounds = np.searchsorted(own, np.arange(self.n_classes + 1)).tolist()
        for c in range(self.n_classes):
            words, rows = slice(self.starts[c], self.starts[c + 1]), slice(bounds[c], bounds[c + 1])
            if words.stop - words.start > 1 and rows.stop > rows.start:
                out[rows] += _log_softmax_at(one[rows], self.tables["outputs"][words], ids[rows] - words.start)
        return out


def _log_softmax_at(one: np.ndarray, table: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log of the target's share in the exponentials of the scores of a table's rows."""
    ones, out = np.ones(len(table), np.float32), np.empty(len(one), np.float64)
    # a matrix that stays in a core's cache
    step = max(1, _SCORES_AT_ONCE // len(table))
    for at in range(0, len(one), step):
        part = one[at : at + step]
        scores = part @ table.T
        chosen = scores.reshape(-1)[np.arange(0, scores.size, len(table)) + target[at : at + step]].astype(np.float64)
        with np.errstate(over="ignore", under="ignore"):
            total = np.exp(scores, out=scores) @ ones
        far = np.flatnonzero(~((total > 1e-30) & (total < 1e30)))
        if len(far):  # by its own largest score
            scores = part[far] @ table.T
            top = scores.max(axis=1)
            chosen[far] -= top
            total[far] = np.exp(scores - top[:, None]).sum(axis=1)
        out[at : at + step] = chosen - np.log(total)
    return out


def _wide(rows: np.ndarray) -> np.ndarray:
    """_GROUP rows as one, over which numpy loops faster than over short ones."""
    return rows.reshape(-1, _GROUP * DIMENSIONS)


def _tiles(places: np.ndarray) -> np.ndarray:
    return np.tile(places, (1, _GROUP))


def _total(rows: np.ndarray) -> np.ndarray:
    """The sum of the rows, as a matrix product."""
    return np.ones(len(rows), np.float32) @ rows


def _with_one(q: np.ndarray) -> np.ndarray:
    one = np.ones((len(q), DIMENSIONS + 1), np.float32)
    one[:, :-1] = q
    return one


def _squares(rows: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", rows, rows)


class Trainer:
    """Noise-contrastive training of a copy of the model, with step sizes that fall row by row.

    A row's chance to be a token and not noise is (1 + t) / 2, where t is the hyperbolic tangent of
    half its score's distance from the noise's log share. So t alone is made for each token and row,
    and all other factors are applied to the tables, which are small.
    """

    def __init__(self, model: LogBilinear, seed: int) -> None:
        self.m, self.rng = model, np.random.default_rng(seed)
        self.tables = {n: t.copy() for n, t in model.tables.items()}
        model.tables = self.tables
        self.squares = {n: np.full(len(t), 1e-6, np.float64) for n, t in self.tables.items()}
        self.weights = {n: np.zeros(len(t), np.float64) for n, t in self.tables.items()}
        sizes = np.diff(model.starts).tolist()
        # classes whose noise is taken in expectation, and those whose noise is drawn
        self.few = [c for c, n in enumerate(sizes) if 2 <= n <= DRAWN]
        self.many = [c for c, n in enumerate(sizes) if n > DRAWN]
        self.upto = {c: np.cumsum(model.word_share[model.starts[c] : model.starts[c + 1]]) for c in self.many}

    def _move(self, name: str, rows, gradient: np.ndarray, weight) -> None:
        self.squares[name][rows] += _squares(gradient) / gradient.shape[1]
        size = (RATE / np.sqrt(self.squares[name][rows])).astype(np.float32)
        self.tables[name][rows] += gradient * size[:, None]
        self.weights[name][rows] += weight

    def step(self, stream: np.ndarray) -> None:
        """Train on the tokens of a stretch of a stream; its first CONTEXT tokens are context only."""
        m, tables = self.m, self.tables
        order = m.sorted_tokens(stream[CONTEXT:])
        if not len(order):
            return
        q, vectors = m.predictions(stream)
        ids = stream[CONTEXT:][order].astype(np.int64)
        one = _with_one(q.take(order, axis=0))
        own = m.classes_of(ids)
        # classes are few: their noise is not drawn, its expectation is taken
        moved = np.zeros_like(tables["classes"])
        to_q = np.zeros((len(ids), DIMENSIONS), np.float32)
        for at in range(0, len(ids), _ROWS_AT_ONCE):
            some = slice(at, at + _ROWS_AT_ONCE)
            _slopes(one[some], tables["classes"], m.class_share, own[some], to_q[some], moved)
        bounds = np.searchsorted(own, np.arange(m.n_classes + 1)).tolist()
        self._few(bounds, ids, one, to_q)
        many = [c for c in self.many if bounds[c] < bounds[c + 1]]
        if many:
            self._noise(many, bounds, one, to_q)
            # the tokens themselves, of all classes whose noise was drawn
            self._tokens(np.concatenate([np.arange(bounds[c], bounds[c + 1]) for c in many]), ids, one, to_q)
        self._move("classes", slice(None), moved, np.bincount(own, minlength=len(moved)))
        full = np.zeros_like(q)
        full[order] = to_q
        to_inputs, to_places = self._backwards(full, vectors)
        order = np.argsort(stream, kind="stable")
        rows, summed, counted = _sum_sorted(stream[order], to_inputs.take(order, axis=0))
        self._move("inputs", rows, summed, counted)
        self._move("places", slice(None), to_places, len(ids))

    def _backwards(self, full: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From the slopes of predictions to those of the vectors before them and of the places."""
        tiles, count = _tiles(self.tables["places"]), len(full)
        to_inputs, part = np.zeros_like(vectors), np.empty((min(count, _ROWS_AT_ONCE), DIMENSIONS), np.float32)
        to_places = np.zeros_like(tiles)
        for at in range(0, count, _ROWS_AT_ONCE):
            own = _wide(full[at : at + _ROWS_AT_ONCE])
            more = _wide(part)[: len(own)]
            for k, tile in enumerate(tiles):
                first = at + CONTEXT - 1 - k
                before = slice(first, first + min(_ROWS_AT_ONCE, count - at))
                np.multiply(own, tile, out=more)
                there = _wide(to_inputs[before])
                there += more
                to_places[k] += np.einsum("ij,ij->j", own, _wide(vectors[before]))
        return to_inputs, to_places.reshape(CONTEXT, _GROUP, DIMENSIONS).sum(axis=1)

    def _few(self, bounds: list[int], ids: np.ndarray, one: np.ndarray, to_q: np.ndarray) -> None:
        """Classes of few words, each by the expected noise of all its words."""
        m, few = self.m, [c for c in self.few if bounds[c] < bounds[c + 1]]
        if not few:
            return
        last = int(m.starts[few[-1] + 1])
        outputs, share = self.tables["outputs"][:last], m.word_share[:last]
        halved, scaled = _halved(outputs, share), _scaled(outputs, share)
        sums = scaled[:, :-1]
        base = np.add.reduceat(sums, m.starts[few[0] : few[-1] + 1], axis=0)
        gradient, weight = np.zeros_like(outputs), np.zeros(last, np.int64)
        stands, at = [], 0
        for c in few:
            a, b, n = bounds[c], bounds[c + 1], int(m.starts[c + 1] - m.starts[c])
            stands.append((c, a, b, int(m.starts[c]), n, at))
            at += (b - a) * n
        flat = np.empty(at, np.float32)
        for _, a, b, first, n, at in stands:
            np.matmul(one[a:b], halved[first : first + n].T, out=flat[at : at + (b - a) * n].reshape(b - a, n))
        np.tanh(flat, out=flat)
        rows = np.concatenate([np.arange(a, b) for _, a, b, _, _, _ in stands])
        mine = np.concatenate([np.arange(b - a) * n + at - first for _, a, b, first, n, at in stands]) + ids[rows]
        flat[mine] -= (1 - flat[mine]) / (NOISE * share[ids[rows]]).astype(np.float32)
        for c, a, b, first, n, at in stands:
            part = flat[at : at + (b - a) * n].reshape(b - a, n)
            to_q[a:b] += part @ sums[first : first + n]
            to_q[a:b] += base[c - few[0]]
            gradient[first : first + n] = part.T @ one[a:b]
            gradient[first : first + n] += _total(one[a:b])
        gradient *= (-0.5 * NOISE * share).astype(np.float32)[:, None]
        np.add.at(weight, ids[rows], 1)
        self._move("outputs", slice(0, last), gradient, weight)

    def _noise(self, many: list[int], bounds: list[int], one: np.ndarray, to_q: np.ndarray) -> None:
        """Noise words of classes of many words, drawn by their share, the same for all tokens of a class."""
        m = self.m
        draws = self.rng.random((len(many), DRAWN))
        drawn = np.concatenate([
            m.starts[c] + np.minimum(np.searchsorted(self.upto[c], draw), len(self.upto[c]) - 1) for c, draw in zip(many, draws)
        ])
        noise = self.tables["outputs"][drawn]
        halved = _halved(noise, m.word_share[drawn])
        noise *= -0.5 * NOISE / DRAWN
        gradient, stands = np.empty_like(noise), np.cumsum([0] + [bounds[c + 1] - bounds[c] for c in many])
        odds = np.empty((stands[-1], DRAWN), np.float32)
        parts = [
            (slice(k * DRAWN, (k + 1) * DRAWN), one[bounds[c] : bounds[c + 1]], to_q[bounds[c] : bounds[c + 1]], odds[a:b])
            for k, (c, a, b) in enumerate(zip(many, stands, stands[1:]))
        ]
        for some, x, _, part in parts:
            np.matmul(x, halved[some].T, out=part)
        np.tanh(odds, out=odds)
        odds += 1
        for some, x, q, part in parts:
            q += part @ noise[some, :-1]
            np.matmul(part.T, x, out=gradient[some])
        gradient *= -0.5 * NOISE / DRAWN
        order = np.argsort(drawn, kind="stable")
        rows, summed, _ = _sum_sorted(drawn[order], gradient[order])
        self._move("outputs", rows, summed, 0)

    def _tokens(self, rows: np.ndarray, ids: np.ndarray, one: np.ndarray, to_q: np.ndarray) -> None:
        own, x = ids[rows], one[rows]
        mine = self.tables["outputs"][own]
        scores = np.einsum("ij,ij->i", x, mine) - np.log(NOISE * self.m.word_share[own])
        near = (0.5 - 0.5 * np.tanh(0.5 * scores)).astype(np.float32)
        to_q[rows] += near[:, None] * mine[:, :-1]
        x *= near[:, None]
        self._move("outputs", *_sum_sorted(own, x))


def _halved(table: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Rows whose product is half the distance of a score from the log share of the noise."""
    out = 0.5 * table
    out[:, -1] -= 0.5 * np.log(NOISE * share)
    return out


def _scaled(table: np.ndarray, share: np.ndarray) -> np.ndarray:
    return table * (-0.5 * NOISE * share).astype(np.float32)[:, None]


def _slopes(
    one: np.ndarray, table: np.ndarray, share: np.ndarray, target: np.ndarray, to_q: np.ndarray, moved: np.ndarray
) -> None:
    """Adds how the objective changes with predictions and table: tokens against NOISE times the expected noise."""
    odds = one @ _halved(table, share).T
    np.tanh(odds, out=odds)
    at = np.arange(0, odds.size, odds.shape[1]) + target
    flat = odds.reshape(-1)
    mine = flat[at]
    # the token's own odds count as its gain and as noise
    flat[at] = mine - (1 - mine) / (NOISE * share[target]).astype(np.float32)
    scaled = _scaled(table, share)[:, :-1]
    to_q += odds @ scaled
    to_q += _total(scaled)
    summed = odds.T @ one
    summed += _total(one)
    moved += _scaled(summed, share)


def _sum_sorted(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(rows, first, axis=0), np.diff(np.append(first, len(keys)))


# ---- texts to numbers -----------------------------------------------------------

class _Endings(dict):
    """Ids of endings by a word's last two bytes, of which there are few."""

    def __init__(self, size: int) -> None:
        self.size = size

    def __missing__(self, tail: bytes) -> int:
        self[tail] = found = self.size + ending_of(tail)
        return found


class Reader:
    def __init__(self, counts: Counts) -> None:
        self.get = {w: i for i, w in enumerate(counts.words)}.get
        self.size = len(counts.words)
        self.endings = _Endings(self.size)
        # numpy sorts 16-bit numbers by their digits
        self.kind = np.dtype("<u2" if self.size + ENDINGS < 1 << 16 else "<i8")

    def ids(self, words: list[bytes]) -> list[int]:
        """Numbers of a text's words and its end; an ending's for words outside the vocabulary."""
        get, endings = self.get, self.endings
        found = list(map(get, words))
        if None in found:
            found = [endings[w[-2:]] if i is None else i for i, w in zip(found, words)]
        end = get(b"")
        found.append(endings[b""] if end is None else end)
        return found

    def batch(self, texts: list[str]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
        """(words, stream, the row of each token): before each text the start stands CONTEXT times."""
        words = [words_of(t) for t in texts]
        lead = [self.size + ENDINGS] * CONTEXT
        lists = [lead + self.ids(w) for w in words]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        stream = np.fromiter(chain.from_iterable(lists), self.kind, int(sizes.sum()))
        return words, stream, np.repeat(np.arange(len(lists)), sizes)


# ---- training -------------------------------------------------------------------

def _number_part(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value[0])
        for batch in batches:
            for _, texts in text_runs(batch.column(0).to_pylist(), _RUN):
                yield pa.RecordBatch.from_arrays([pa.array([reader.batch(texts)[1].tobytes()], pa.binary())], ["stream"])

    return run


def _train_part(shared, round_: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, tables = shared.value
        part = TaskContext.get().partitionId()
        model, kind = LogBilinear(counts), Reader(counts).kind
        model.tables = tables
        trainer = Trainer(model, seed=1000 * round_ + part)
        left = np.empty(0, kind)

        def stretches(stream: np.ndarray, last: bool) -> np.ndarray:
            """Train on whole batches; the rest waits, behind the tokens it follows."""
            at = CONTEXT
            while len(stream) - at >= (1 if last else BATCH):
                stop = min(at + BATCH, len(stream))
                trainer.step(stream[at - CONTEXT : stop])
                at = stop
            return stream[at - CONTEXT :]

        for batch in batches:
            for stream in batch.column(0):
                left = stretches(np.concatenate((left, np.frombuffer(stream.as_buffer(), kind))), False)
        stretches(left, True)
        out = []
        for name, table in trainer.tables.items():
            weights = trainer.weights[name]
            for at in range(0, len(table), _BLOCK):
                weight = weights[at : at + _BLOCK]
                if weight.any():
                    out.append((f"{name}:{at}", part, table[at : at + _BLOCK].tobytes(), weight.tobytes()))
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out), (pa.string(), pa.int32(), pa.binary(), pa.binary()))], _FIELDS
            )

    return run


_FIELDS = ["block", "part", "data", "weight"]
_ROWS = "block string, part int, data binary, weight binary"


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block: one averaged block at a time is held."""
    name, total, weights = None, None, None

    def row() -> pa.RecordBatch:
        mean = total / np.maximum(weights, 1e-300)[:, None]
        return pa.RecordBatch.from_arrays([
            pa.array([name]), pa.array([0], pa.int32()), pa.array([mean.astype(np.float32).tobytes()]), pa.array([weights.tobytes()]),
        ], _FIELDS)

    for batch in batches:
        for block, _, data, weight in zip(*(c.to_pylist() for c in batch.columns)):
            own = np.frombuffer(weight, np.float64)
            rows = np.frombuffer(data, np.float32).reshape(len(own), -1).astype(np.float64) * own[:, None]
            if block != name:
                if name is not None:
                    yield row()
                name, total, weights = block, rows, own.copy()
            else:
                total += rows
                weights += own
    if name is not None:
        yield row()


def fit(docs: DataFrame, counts: Counts, text_column: str = "text", rounds: int = ROUNDS) -> LogBilinear:
    """The model after ``rounds`` passes over all rows of ``docs``.

    The texts are read once: their numbers, two bytes a token, stay on the executors' disks.
    Of each round the driver sees the averaged tables only, whose size the
    vocabulary's share bounds; a lost task trains its partition again to the same result.
    """
    spark: SparkSession = docs.sparkSession
    model = LogBilinear(counts)
    if not counts.tokens:
        return model
    known = spark.sparkContext.broadcast((counts,))
    texts = docs.select(text_of(text_column).alias("text"))
    streams = map_batches(texts, _number_part(known), "stream binary").persist(StorageLevel.DISK_ONLY)
    for round_ in range(rounds):
        shared = spark.sparkContext.broadcast((counts, model.tables))
        copies = map_batches(streams, _train_part(shared, round_), _ROWS)
        # blocks of all copies meet in order, so sums do not depend on who ends first
        means = map_batches(copies.repartition("block").sortWithinPartitions("block", "part"), _average, _ROWS)
        for row in means.collect():
            name, at = row.block.split(":")
            weight = np.frombuffer(row.weight, np.float64)
            data = np.frombuffer(row.data, np.float32).reshape(len(weight), -1)
            trained = np.flatnonzero(weight)
            model.tables[name][int(at) + trained] = data[trained]
        shared.unpersist()
    streams.unpersist()
    known.unpersist()
    return model


# ---- scores ---------------------------------------------------------------------

_RARE = pa.list_(pa.struct([("word", pa.string()), ("m", pa.int32())]))
_SCORED = ["row", "doc_id", "n_tokens", "n_often", "n_rare", "base_log", "score_log", "rare"]


def _by_row(rows: np.ndarray, out: np.ndarray, count: int) -> tuple[range, Iterator[list[int]]]:
    """For each row its number and the places of its words outside the vocabulary."""
    sizes = np.bincount(rows, minlength=count)
    place = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    rare = np.flatnonzero(out & (place < np.repeat(sizes, sizes) - 1))  # the end is no word
    bounds = np.searchsorted(rows[rare], np.arange(count + 1)).tolist()
    places = place[rare].tolist()
    return range(count), (places[a:b] for a, b in zip(bounds, bounds[1:]))


def _score_part(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, tables = shared.value
        model, reader = LogBilinear(counts), Reader(counts)
        model.tables = tables
        size = len(counts.words)
        known = {w: math.log10(n + 1) for w, n in counts.known.items()}.get
        # log10 of smoothed counts, and what a rare token loses to the others of its ending
        often_log = np.log10(np.append(counts.numbers, np.zeros(ENDINGS)) + 1.0)
        rest_log = np.concatenate((np.zeros(size), np.log10(counts.rest)))
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids_of = batch.column(0)
            for first, texts in text_runs(batch.column(1).to_pylist(), _RUN):
                count = len(texts)
                words, ids, rows = reader.batch(texts)
                logs = model.log_probability(ids) / math.log(10)
                own = ids != model.start
                ids, rows = ids[own], rows[own]
                logs = logs[own] - rest_log[ids]
                sum_by = lambda x: np.bincount(rows, x, count)
                base, score = sum_by(often_log[ids]), sum_by(logs)
                out = ids >= size
                n_rest = np.bincount(rows[out], minlength=count)
                often = np.bincount(rows[~out], minlength=count)
                tail_words: list[str] = []
                tail_times: list[int] = []
                ends = [0]
                for text, base_of, place in zip(words, *_by_row(rows, out, count)):
                    found = [text[k] for k in place]
                    logs_of = list(map(known, found))
                    if None in logs_of:
                        tail = Counter(w for w, log in zip(found, logs_of) if log is None)
                        tail_words += [w.decode("utf-8", "surrogatepass") for w in tail]
                        tail_times += tail.values()
                        logs_of = [log for log in logs_of if log is not None]
                    log = math.fsum(logs_of)
                    base[base_of] += log
                    score[base_of] += log
                    often[base_of] += len(logs_of)
                    ends.append(len(tail_words))
                rare = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(
                    [pa.array(tail_words, pa.string()), pa.array(tail_times, pa.int32())], fields=list(_RARE.value_type)
                ))
                tokens = np.bincount(rows, minlength=count)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(row, row + count)), ids_of.slice(first, count),
                    *(pa.array(x.astype(np.int64)) for x in (tokens, often, n_rest)), pa.array(base), pa.array(score),
                    rare,
                ], _SCORED)
                row += count

    return run


def language_model_scores(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``.

    The model learns from the rows whose id's checksum does not leave HELD_OUT of
    FOLDS. ``base_score`` is the add-one unigram model's log10 probability of the
    text, ``score`` the neural model's. A null text is empty and has its end
    alone; a null id counts as the empty text; repeated rows are trained on and scored as
    often as they occur. Without training rows all words are alike.
    """
    fold = crc_fold(F.col(id_column), FOLDS)
    training = docs.filter(fold != HELD_OUT)
    table = saved(token_counts(training, text_column), "token-counts")
    counts = count_summary(table)
    model = fit(training, counts, text_column)
    shared = docs.sparkSession.sparkContext.broadcast((counts, model.tables))
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("doc_id"), text_of(text_column).alias("text"))
    schema = (
        f"row bigint, doc_id {kind}, n_tokens bigint, n_often bigint, n_rare bigint, base_log double, score_log double,"
        " rare array<struct<word: string, m: int>>"
    )
    scored = saved(map_batches(rows, _score_part(shared), schema), "scored-texts")
    # rare words meet their counts one by one; none of them is a large share of the tokens
    seldom = table.filter(F.col("n") * (1 << COUNT_BITS) < counts.tokens).filter("word <> ''")
    found = scored.select("row", F.inline("rare")).join(seldom, "word")
    sums = found.groupBy("row").agg(F.sum("m").alias("seen"), F.sum(F.col("m") * F.log10(F.col("n") + 1)).alias("rare_log"))
    every = math.log10(counts.tokens + counts.distinct + 1)
    rare_log = F.coalesce("rare_log", F.lit(0.0))
    return scored.drop("rare").join(sums, "row", "left").select(
        F.col("doc_id").alias(id_column), (crc_fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "n_tokens",
        (F.col("n_often") + F.coalesce("seen", F.lit(0))).alias("n_known"), F.lit(counts.tokens).cast("long").alias("train_tokens"),
        (F.col("base_log") + rare_log - F.col("n_tokens") * F.lit(every)).alias("base_score"),
        (F.col("score_log") + rare_log).alias("score"),
    )
