"""Spelling variants by permuterm rotations.

A word is marked with a terminator and all its rotations are sorted. A rotation that
ends in the edited character begins with everything else, so words that differ by
one replaced character share all of such a rotation but its last character, and a
word that lacks the character is that shared part itself, as a rotation of its own.
Both are prefix ranges of the sorted rotations. A range holds at most one word per
letter of the alphabet and one shorter word, whatever the size of the table.

Rotations of long words would take the square of their length, so beyond
LONG code points a rotation is named by digests, which a running sum gives for
all rotations of a word at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import map_batches, saved, text_of

# fixed values: the alphabet of runs, the letters that are lowered
LETTERS = "[A-Za-z\\u00C0-\\u00FF]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_LENGTH = 7
MIN_COUNT = 2
# one run in NOISE loses a letter, chosen by a checksum
NOISE = 31
# a form is at least this many times as frequent as the word
FORM_RATIO = 10
# code points of a word whose rotations are kept as text
LONG = 64
END = "$"
# (prime, base) of the digests of long rotations: products fit 64 bits
_DIGESTS = ((2_147_483_647, 1_103_515_245), (2_147_483_629, 69_069_069), (2_147_483_587, 822_587_341))


# ---- words ----------------------------------------------------------------------

def words_of(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_length: int = MIN_LENGTH,
    min_count: int = MIN_COUNT, noise: int = NOISE,
) -> DataFrame:
    """(word, n): the distinct words of all texts, with map-side partial counts.

    A run of letters whose checksum with its document's id is divisible by ``noise``
    loses one letter. Runs too short for a word are never taken out of the text. A
    null id counts as the empty text, a null text has no words.
    """
    lowered = F.translate(text_of(text_column), UPPER, LOWER)
    # the longest match from the left: a run, or nothing of a run that is too short
    runs = F.regexp_extract_all(lowered, F.lit(f"({LETTERS}{{{min_length},}})"), 1)
    name = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    each = docs.select(name.alias("id"), F.explode(runs).alias("run"))
    checked = each.select("run", F.crc32(F.concat_ws(":", "id", "run").cast("binary")).alias("h"))
    place = "cast(h % length(run) as int)"
    word = F.expr(f"if(h % {noise} = 0, concat(substring(run, 1, {place}), substring(run, {place} + 2)), run)")
    counted = checked.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter((F.length("word") >= min_length) & (F.col("n") >= min_count))


# ---- rotations ------------------------------------------------------------------
# rows: shared (the part of a rotation that two near words have in common), word, n,
# last (the character that follows it, empty if the rotation ends there), first
# (the character does not repeat the one before it, so a deletion is found once)

def rotations(words: DataFrame) -> DataFrame:
    """The rotations of words of up to LONG code points, in both roles."""
    at = words.filter(F.length("word") <= LONG).select("word", "n", F.explode(F.expr("sequence(0, length(word))")).alias("i"))
    whole = at.selectExpr(
        f"concat(substring(word, i + 1), '{END}', substring(word, 1, i)) as shared", "word", "n", "'' as last", "false as first"
    )
    cut = at.filter("i > 0").selectExpr(
        f"concat(substring(word, i + 1), '{END}', substring(word, 1, i - 1)) as shared", "word", "n",
        "substring(word, i, 1) as last", "i = 1 or substring(word, i, 1) <> substring(word, i - 1, 1) as first",
    )
    return whole.unionByName(cut)


def rotation_digests(codes: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Digests of a word's whole rotations (one per start), and of those without their last character."""
    size = len(codes)
    whole, cut = [], []
    for prime, base in _DIGESTS:
        p = np.uint64(prime)
        power = np.ones(1, np.uint64)
        while len(power) < size + 1:
            power = np.concatenate((power, power * np.uint64(pow(base, len(power), prime)) % p))
        back = np.ones(1, np.uint64)
        inverse = pow(base, -1, prime)
        while len(back) < size + 1:
            back = np.concatenate((back, back * np.uint64(pow(inverse, len(back), prime)) % p))
        terms = codes.astype(np.uint64) % p * power[:size] % p
        before = np.concatenate(([np.uint64(0)], np.cumsum(terms) % p))  # 2^31 characters stay below 2^64
        at = np.arange(size + 1)
        end = np.uint64(ord(END))

        def joined(tail: np.ndarray, head: np.ndarray) -> np.ndarray:
            """Digest of word[tail:] + END + word[:head]."""
            left = (before[size] + p - before[tail]) % p * back[tail] % p
            gap = size - tail
            return (left + end * power[gap] % p + before[head] * (power[gap] * np.uint64(base) % p) % p) % p

        whole.append(joined(at, at))
        cut.append(joined(at[1:], at[:-1]))
    return whole, cut


def _long_rotations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["shared", "word", "n", "last", "first"]
    for batch in batches:
        for word, rank, n in zip(*(c.to_pylist() for c in batch.columns)):
            codes = np.frombuffer(word.encode("utf-32-le"), "<u4").astype(np.int64)
            whole, cut = rotation_digests(codes)
            fresh = np.concatenate(([True], codes[1:] != codes[:-1]))
            # a word of LONG letters meets its own length among the short words
            roles = [(whole, len(codes), None)] + ([(cut, len(codes) - 1, codes)] if len(codes) > LONG else [])
            for digests, size, last in roles:
                count = len(digests[0])
                for at in range(0, count, 10_000):
                    part = [d[at : at + 10_000].tolist() for d in digests]
                    shared = [f"{size}:{a:x}:{b:x}:{c:x}" for a, b, c in zip(*part)]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(shared), pa.array([rank] * len(shared)), pa.array([n] * len(shared), pa.int64()),
                        pa.array([""] * len(shared) if last is None else [chr(c) for c in last[at : at + 10_000]]),
                        pa.array([False] * len(shared) if last is None else fresh[at : at + 10_000]),
                    ], names)


# ---- ranges ---------------------------------------------------------------------

def near_parts(rows: DataFrame) -> DataFrame:
    """(word, near, best) per word and range: how many near words, and the most frequent one.

    ``best`` is (-n, word), so that the smallest is the best. One sort brings the
    rotations of a range together; a row looks at those before and behind it, of
    which there are at most as many as the alphabet has letters.
    """
    whole = Window.partitionBy("shared")
    other = F.struct((-F.col("n")).alias("n"), F.col("word").alias("word"))
    is_cut = F.col("last") != ""
    held = rows.withColumns({
        "cuts": F.count_if(is_cut).over(whole), "firsts": F.count_if(F.col("first")).over(whole),
        "full": F.min(F.when(~is_cut, other)).over(whole), "size": F.count("*").over(whole),
    }).filter("size > 1")
    order = whole.orderBy("last")
    around = [order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)]
    replaced = F.least(*(F.min(F.when(is_cut, other)).over(w) for w in around))
    longer = F.min(F.when(F.col("first"), other)).over(whole)
    shorter = F.when(F.col("first"), F.col("full"))
    found = held.select(
        "word",
        F.when(is_cut, F.col("cuts") - 1 + F.when(shorter.isNotNull(), 1).otherwise(0)).otherwise(F.col("firsts")).alias("near"),
        F.when(is_cut, F.least(replaced, shorter)).otherwise(longer).alias("best"),
    )
    return found.filter("near > 0")


def _long_parts(words: DataFrame) -> DataFrame | None:
    """``near_parts`` of the words of LONG code points or more; ranks stand for them on the way."""
    from ..operators.ordering import with_positions

    some = words.filter(F.length("word") >= LONG)
    if not some.filter(F.length("word") > LONG).take(1):
        return None
    ranked = with_positions(some, "word").withColumn("rank", F.lpad(F.col("position").cast("string"), 19, "0"))
    ranked = saved(ranked.select("word", "rank", "n"), "long-words")
    rows = map_batches(ranked, _long_rotations, "shared string, word string, n bigint, last string, first boolean")
    parts = near_parts(rows).select(F.col("word").alias("rank"), "near", F.col("best.n").alias("m"), F.col("best.word").alias("of"))
    other = ranked.select(F.col("rank").alias("of"), F.col("word").alias("of_word"))
    joined = parts.join(ranked.select("rank", "word"), "rank").join(other, "of")
    return joined.select("word", "near", F.struct(F.col("m").alias("n"), F.col("of_word").alias("word")).alias("best"))


# ---- forms ----------------------------------------------------------------------

def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from saved (word, form): each round doubles the steps taken.

    Counts grow by FORM_RATIO a step, so a chain has at most 19 steps and five rounds end.
    """
    reach = forms.select("word", F.col("form").alias("root"))
    while True:
        on = reach.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ahead = reach.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        ahead = saved(ahead, "roots")
        if not ahead.filter("moved").take(1):
            return ahead.select("word", "root")
        reach = ahead.select("word", "root")


def spelling_groups(words: DataFrame, form_ratio: int = FORM_RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every row of ``words`` (word, n; words distinct).

    Two words are near if exactly one inserted, deleted or replaced code point tells
    them apart. ``form`` is the near word with the largest n (ties: the first in
    code-point order) if that is at least ``form_ratio`` times the word's, else
    null; ``root`` ends the chain of forms. An empty table gives an empty table.
    """
    words = saved(words.select("word", F.col("n").cast("long")), "words")
    parts = near_parts(rotations(words))
    if (more := _long_parts(words)) is not None:
        parts = parts.unionByName(more)
    near = parts.groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    best_n = -F.col("best.n")
    enough: Column = best_n >= form_ratio * F.col("n")
    judged = saved(
        words.join(near, "word", "left").select(
            "word", F.when(enough, F.col("best.word")).alias("form"), "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, best_n).alias("form_n"),
        ), "forms",
    )
    ends = roots(judged.filter("form is not null"))
    return judged.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def spelling_variants(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``spelling_groups`` of the words of all texts; repeated rows count as often as they occur."""
    return spelling_groups(words_of(docs, id_column, text_column))
