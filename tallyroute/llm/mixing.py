"""Mixing sources to target weights by Sainte-Laguë apportionment.

Targets are filled by weight up to a multiple of each source's size. The words of
the mix are equal blocks; Sainte-Laguë quotients give each source, and then each
of its shards, a whole number of blocks. Inside a shard the documents stand in a
seeded order and the first blocks are taken, as often round as the quota asks.
"""

from __future__ import annotations

from collections.abc import Sequence
from heapq import heapify, heapreplace

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import WORD, saved, small_side, text_of

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
BLOCK_WORDS = 64
# documents per shard, about; a hot source has more shards, not larger ones
SHARD_ROWS = 16_384
SOURCE_BOUND = 100_000


def targets_of(sizes: Sequence[int], weights: Sequence[float], most: float = MOST_REPEATS) -> list[float]:
    """The total shared by weight; no target above ``most`` times its size, the excess reshared."""
    targets, open_, left = [0.0] * len(sizes), list(range(len(sizes))), float(sum(sizes))
    while open_:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / total > most * sizes[i]]
        if not full:
            for i in open_:
                targets[i] = left * weights[i] / total
            break
        for i in full:
            targets[i] = float(most * sizes[i])
        left -= sum(targets[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return targets


def apportion(seats: int, votes: Sequence[float]) -> list[int]:
    """``seats`` given one by one to the highest quotient votes / (2 * seats held + 1).

    The rounds before the last few are taken at once: rounding all votes by one
    divisor is a state the rounds pass through. Ties go to the earlier entry.
    """
    total = float(sum(votes))
    if total <= 0:
        return [0] * len(votes)
    low, high = 0.0, (seats + len(votes) + 1) / total
    rounded = lambda rate: [max(0, -int(-(v * rate - 0.5) // 1)) if v * rate > 0.5 else 0 for v in votes]
    for _ in range(80):
        middle = (low + high) / 2
        if sum(rounded(middle)) <= seats:
            low = middle
        else:
            high = middle
    held = rounded(low)
    heap = [(-v / (2 * h + 1), i) for i, (v, h) in enumerate(zip(votes, held)) if v > 0]
    heapify(heap)
    for _ in range(seats - sum(held)):
        _, i = heap[0]
        held[i] += 1
        heapreplace(heap, (-votes[i] / (2 * held[i] + 1), i))
    return held


def word_count(text: Column) -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def mix(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST_REPEATS, seed: int = 7,
    block: int = BLOCK_WORDS, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
) -> DataFrame:
    """(id, size, source_size, target, taken) for every row of ``docs``.

    Sources in code-point order, null last, take ``weights`` in turn. ``taken``
    counts the words the mix takes from a row, repeats included: never more than
    ``most`` times its size. Texts without words, null ones too, take none; a
    null id is passed on; repeated rows are rows of their own. All choices hang
    on hashes of the data, so reruns agree. The driver holds one row per source
    and about one per SHARD_ROWS documents.
    """
    spark = docs.sparkSession
    rows = saved(
        docs.select(F.col(id_column).alias("id"), F.col(source_column).alias("source"), word_count(F.col(text_column)).alias("size")),
        "mix-rows",
    )
    sources = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).collect()
    sources.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["size"] for r in sources]
    targets = targets_of(sizes, [weights[i % len(weights)] for i in range(len(sources))], most)
    catalogue = spark.createDataFrame(
        [(r["source"], i, r["size"], t, max(1, -(-r["rows"] // SHARD_ROWS))) for i, (r, t) in enumerate(zip(sources, targets))],
        "name string, number int, source_size long, target double, shards int",
    )
    order = F.xxhash64(F.col("id"), F.col("size"), F.lit(seed))
    known = rows.join(small_side(catalogue, SOURCE_BOUND), F.col("source").eqNullSafe(F.col("name"))).select(
        "id", "size", "number", "source_size", "target",
        F.pmod(F.xxhash64(F.col("id"), F.lit(seed + 1)), F.col("shards")).cast("int").alias("shard"), order.alias("order"),
    )
    shards = known.groupBy("number", "shard").agg(F.sum("size").alias("words")).orderBy("number", "shard").collect()
    blocks = apportion(round(sum(sizes) / block), targets)
    quotas, at = [], 0
    for number in range(len(sources)):
        own = []
        while at < len(shards) and shards[at]["number"] == number:
            own.append(shards[at])
            at += 1
        for r, seats in zip(own, apportion(blocks[number], [r["words"] for r in own])):
            quotas.append((number, r["shard"], min(seats * block, most * r["words"]), r["words"]))
    table = spark.createDataFrame(quotas, "number int, shard int, quota long, words long")
    # ties in the seeded order fall to the id; rows equal in both are interchangeable
    before = Window.partitionBy("number", "shard").orderBy("order", "id").rowsBetween(Window.unboundedPreceding, -1)
    placed = known.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)))
    placed = placed.join(small_side(table, SOURCE_BOUND), ["number", "shard"])
    rounds = F.expr("if(words = 0, 0L, quota div words)")
    rest = F.col("quota") - rounds * F.col("words")
    taken = rounds * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start")))
    return placed.select(
        F.col("id").alias(id_column), "size", "source_size", "target", taken.cast("long").alias("taken")
    )


def mixed_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The mix itself, in the columns of ``docs``: each row as often as it is taken whole,
    and once more cut after its last taken word. Rows the mix takes nothing from go.

    The counts meet the texts by id and size, in one shuffle of the texts. Rows that
    share both, as repeated rows do, take the mean of what the mix takes from them,
    rounded down; null ids are ids like others.
    """
    counts = mix(docs, id_column=id_column, text_column=text_column, **options)
    counts = counts.groupBy(F.col(id_column).alias("of_id"), F.col("size").alias("of_size")).agg(
        F.expr("sum(taken) div count(*)").alias("taken")
    ).filter("taken > 0")
    # all of a row in one column, so that no name of it can clash
    rows = docs.select(F.struct("*").alias("row"), F.col(id_column).alias("id"), word_count(F.col(text_column)).alias("size"))
    joined = rows.join(counts, (F.col("size") == F.col("of_size")) & F.col("id").eqNullSafe(F.col("of_id")))
    whole, part = F.expr("taken div size"), F.expr("taken % size")
    text = F.col("row").getField(text_column)
    copies = joined.withColumn("copy", F.explode(F.sequence(F.lit(1), whole + F.when(part > 0, 1).otherwise(0))))
    # pieces of a word and the space after it; leading space is a piece of its own
    pieces = F.split(text, "(?<=[ \\t-\\r])(?=[^ \\t-\\r])")
    lead = F.when(F.regexp_like(text, F.lit("^[ \\t-\\r]")), 1).otherwise(0)
    cut = F.array_join(F.slice(pieces, F.lit(1), part.cast("int") + lead), "")
    kept = F.when(F.col("copy") > whole, cut).otherwise(text)
    return copies.select(*[(kept if c == text_column else F.col("row").getField(c)).alias(c) for c in docs.columns])
