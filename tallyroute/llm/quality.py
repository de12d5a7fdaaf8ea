"""Quality rules judged by an isolation forest.

Rule statistics are taken from every whole text. Each statistic has a forest of its
own, whose trees split a bounded sample of documents at random values; the path
length at which a document ends up alone tells how unusual its value is. Labelled
rows calibrate, for each statistic, the longest path that still counts as an
anomaly: a document that is odd in a harmless statistic is not rejected for it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_batches, saved, small_side, text_of

WINDOW = 3
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
# documented bounds: the forests are fitted on TREES * SAMPLE documents at most
TREES, SAMPLE, DEPTH = 48, 256, 8
# a threshold may reject this share of the labelled good rows, and at most one of them for so many bad ones
GOOD_LOST, BAD_PER_GOOD = 0.0003, 20
# bins per unit of path length in the calibration
PER_STEP = 64
LABEL_BOUND = 4_000_000

_WORD = re.compile(r"[^ \t-\r]+")
_SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE_COUNTS = ("n_lines", "n_upper", "n_digits", "n_marks", "n_distinct_words")


def rule_counts(text: str) -> tuple[int, ...]:
    """COUNTS and MORE_COUNTS of one text, in that order."""
    words = _WORD.findall(text)
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        often = {w for w, n in Counter(windows).items() if n > 1}
        inside = -1  # last word of a repeated window so far
        for at, window in enumerate(windows):
            if window in often:
                repeated += at + WINDOW - max(inside + 1, at)
                inside = at + WINDOW - 1
    lines = [line for line in text.split("\n") if _WORD.search(line)]
    # code points at a time, without a loop over them
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    small = np.bincount(points[points < 256], minlength=256)
    upper = int(small[65:91].sum() + small[192:223].sum() - small[215])
    return (
        len(words), sum(map(len, words)), int(small[[ord(c) for c in _SYMBOLS]].sum()), len(lines) - len(set(lines)),
        repeated, len(lines), upper, int(small[48:58].sum()), int(small[33:48].sum() + small[58:65].sum()), len(set(words)),
    )


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [rule_counts(text) for text in batch.column(1).to_pylist()]
        columns = zip(*rows) if rows else [[]] * len(COUNTS + MORE_COUNTS)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(list(c), pa.int64()) for c in columns)], ["id", *COUNTS, *MORE_COUNTS]
        )


def rule_statistics(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, counts) of every row, in place. Null texts have no words and no lines."""
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), text_of(text_column).alias("text"))
    return map_batches(rows, _count_rows, f"id {kind}, " + ", ".join(f"{n} bigint" for n in COUNTS + MORE_COUNTS))


STATISTICS = ("symbols", "marks", "upper", "digits", "repeats", "dup_lines", "length", "variety")


def features(c: dict[str, np.ndarray]) -> np.ndarray:
    """STATISTICS of the rule counts: shares, comparable between short and long texts."""
    words, chars, lines = (np.maximum(c[n], 1).astype(float) for n in ("n_words", "word_chars", "n_lines"))
    return np.column_stack((
        c["n_symbols"] / words, c["n_marks"] / words, c["n_upper"] / chars, c["n_digits"] / chars,
        c["n_repeat_words"] / words, c["n_dup_lines"] / lines, c["word_chars"] / words,
        c["n_distinct_words"] / words ** 0.9,
    ))


@dataclass
class Forest:
    """Complete binary trees of DEPTH levels over one statistic: node k has children 2k+1 and 2k+2."""

    split: np.ndarray   # (trees, inner nodes)
    depth: np.ndarray   # (trees, leaves): path length, with the expected rest of an unsplit leaf

    def paths(self, x: np.ndarray) -> np.ndarray:
        total, inner = np.zeros(len(x)), self.split.shape[1]
        for split, depth in zip(self.split, self.depth):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x > split[node])
            total += depth[node - inner]
        return total / len(self.split)


def _expected(n: int) -> float:
    """Mean path length of an unsuccessful search among ``n`` rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def fit_forest(x: np.ndarray, seed: int = 5) -> Forest:
    """Trees over the values ``x`` of one statistic; with no value every path has length 0."""
    rng = np.random.default_rng(seed)
    inner = (1 << DEPTH) - 1
    split, depth = np.full((TREES, inner), np.inf), np.zeros((TREES, inner + 1))
    for tree in range(TREES):
        members, level, ended = {0: x[rng.permutation(len(x))[:SAMPLE]]}, np.zeros(2 * inner + 1), {}
        for node in range(inner):
            own = members.pop(node, x[:0])
            children = (2 * node + 1, 2 * node + 2)
            if node in ended or len(own) == 0 or own.min() == own.max():
                # a leaf above the last level: its value goes down both ways
                ended |= dict.fromkeys(children, ended.get(node, level[node] + _expected(len(own))))
                continue
            split[tree, node] = cut = rng.uniform(own.min(), own.max())
            members |= {children[0]: own[own <= cut], children[1]: own[own > cut]}
            level[list(children)] = level[node] + 1
        for leaf in range(inner + 1):
            node = leaf + inner
            depth[tree, leaf] = ended.get(node, level[node] + _expected(len(members.get(node, x[:0]))))
    return Forest(split, depth)


def _path_rows(forests):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features({n: batch.column(n).to_numpy() for n in COUNTS + MORE_COUNTS})
            paths = [pa.array(forest.paths(x[:, j])) for j, forest in enumerate(forests.value)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *paths], [*batch.schema.names, *PATHS])
    return run


PATHS = tuple(f"path_{n}" for n in STATISTICS)


def judge(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label: str = "quality"
) -> DataFrame:
    """(id, counts, base_failed, paths, kept) for every row of ``docs``.

    The forests see TREES * SAMPLE rows by hash at most. The thresholds come from
    all labelled rows that pass the base rules: per statistic, of the path
    lengths that lose few enough good rows (GOOD_LOST, BAD_PER_GOOD) the longest
    that gains bad ones. Without both kinds of label no row is an anomaly. Null
    and empty texts fail the base rules. Repeated rows are judged alike, a null
    id is judged like any other; an id with several labels counts as its worst.
    """
    spark = docs.sparkSession
    stats = saved(rule_statistics(docs, id_column, text_column), "rule-counts")
    failed = F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words")
    sample = stats.filter(~failed).orderBy(F.xxhash64("id", "word_chars"), "id").limit(TREES * SAMPLE).toArrow()
    x = features({n: sample.column(n).to_numpy() for n in COUNTS + MORE_COUNTS})
    forests = [fit_forest(x[:, j], seed=j) for j in range(len(STATISTICS))]
    schema = f"id {stats.schema['id'].dataType.simpleString()}"
    schema += "".join(f", {n} bigint" for n in COUNTS + MORE_COUNTS) + "".join(f", {n} double" for n in PATHS)
    scored = saved(map_batches(stats, _path_rows(spark.sparkContext.broadcast(forests)), schema), "paths")
    marks = labels.filter(F.col(id_column).isNotNull() & F.col(label).isNotNull())
    marks = marks.groupBy(F.col(id_column).alias("id")).agg(F.min(label).alias("good"))
    labelled = scored.filter(~failed).join(small_side(marks, LABEL_BOUND), "id")
    # one histogram per statistic: some 1,500 rows each
    each = F.explode(F.array(*[
        F.struct(F.lit(n).alias("statistic"), F.floor(F.col(n) * PER_STEP).cast("int").alias("bin")) for n in PATHS
    ]))
    steps = labelled.select("good", each.alias("at")).groupBy("at.statistic", "at.bin").agg(
        F.sum(F.expr("if(good = 1, 1, 0)")).alias("good"), F.sum(F.expr("if(good = 1, 0, 1)")).alias("bad")
    ).orderBy("bin").collect()
    usual = F.lit(True)
    for name in PATHS:
        first = calibrated([s for s in steps if s["statistic"] == name])
        usual = usual & (F.col(name) >= F.lit(first / PER_STEP))
    return scored.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & usual
    ).withColumnRenamed("id", id_column)


def calibrated(steps: list) -> int:
    """The first bin that is kept, of rows (bin, good, bad) in the order of their bins."""
    good, bad = sum(s["good"] for s in steps), sum(s["bad"] for s in steps)
    if not good or not bad:
        return 0
    lost = gained = best = first = 0
    for s in steps:
        lost, gained = lost + s["good"], gained + s["bad"]
        if lost > GOOD_LOST * good:
            break
        if gained > best and gained >= BAD_PER_GOOD * lost:
            best, first = gained, s["bin"] + 1
    return first
