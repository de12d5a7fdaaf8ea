"""Shards of near-equal bytes by a minimax contiguous partition, in DataFrame functions only.

Equal texts form a group, the atom of the search; groups are ordered by a hash of
their text. A binary search finds the smallest shard capacity for which a greedy
walk needs no more shards than asked for; the shards are cut there.

The driver never sees all groups. It starts from at most 2^RANGE_BITS ranges of hashes
and splits by further digits those that are heavy and those in which some cut can fall,
until every one of them is a single group. What is left of the ranges lies between the
cuts as a whole, so the result is that of a search over all groups.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import saved, text_of

RANGE_BITS = 16
# hash digits by which a range is split at a time
_DIGITS = 1
# a range above this part of a shard is split before the search begins
_HEAVY = 1024
# parts of a hash range that number their rows on their own, so no hot text is one task
SALTS = 256


def _walk(sums: list[int], shards: int, capacity: int) -> list[int]:
    """Greedy: the first position behind shards 1, 2, ..., one more of them than asked for at most."""
    starts, at = [], 0
    while at < len(sums) - 1 and len(starts) <= shards:
        at = bisect_right(sums, sums[at] + capacity) - 1
        starts.append(at)
    return starts


def cuts_for(sizes: list[int], shards: int) -> tuple[int, list[int]]:
    """The smallest capacity, and the first position of shards 1, 2, ... of the ordered ``sizes``.

    Trailing shards may stay empty when single sizes exceed an equal share.
    """
    sums = [0, *accumulate(sizes)]
    low, high = max(max(sizes, default=0), -(-sums[-1] // shards)), sums[-1]
    while low < high:
        middle = (low + high) // 2
        if len(_walk(sums, shards, middle)) <= shards:
            high = middle
        else:
            low = middle + 1
    return low, [cut for cut in _walk(sums, shards, low) if cut < len(sizes)]


@dataclass(frozen=True)
class Atom:
    """All groups whose hash begins with ``prefix``."""

    prefix: str
    size: int
    single: bool  # one group only


def _atoms(rows: DataFrame, prefix: Column) -> list[Atom]:
    sums = rows.groupBy(prefix.alias("prefix")).agg(
        F.sum("size").alias("size"), (F.min("hash") == F.max("hash")).alias("single")
    )
    return [Atom(r["prefix"], r["size"], r["single"]) for r in sums.collect() if r["prefix"] is not None]


def _split(rows: DataFrame, atoms: list[Atom], chosen: set[str]) -> list[Atom]:
    """The atoms in order, the ``chosen`` ones by further digits."""
    by_depth = defaultdict(list)
    for prefix in chosen:
        by_depth[len(prefix)].append(prefix)
    child = F.coalesce(*(
        F.when(F.substring("hash", 1, depth).isin(prefixes), F.substring("hash", 1, depth + _DIGITS))
        for depth, prefixes in sorted(by_depth.items())
    ))
    parts = _atoms(rows.filter(child.isNotNull()), child)
    return sorted([a for a in atoms if a.prefix not in chosen] + parts, key=lambda a: a.prefix)


def _windows(atoms: list[Atom], shards: int, low: int, high: int) -> Iterable[Atom]:
    """The atoms in which a greedy walk over groups can end a shard, for capacities of ``low`` to ``high``.

    A walk over atoms ends its shards no later than one over groups; with a capacity
    that is larger by the largest divisible atom it ends them no earlier.
    """
    sums = [0, *accumulate(a.size for a in atoms)]
    slack = max((a.size for a in atoms if not a.single), default=0)
    late = _walk(sums, shards, high + slack)
    early = _walk(sums, shards, low)
    late += [len(atoms)] * (len(early) - len(late))
    for first, last in zip(early, late):
        yield from atoms[first : last + 1]


def group_cuts(rows: DataFrame, shards: int) -> tuple[int, list[str]]:
    """Capacity, and the hash prefixes at which shards 1, 2, ... begin, over all groups of ``rows`` (hash, size).

    The capacity over ranges is above the one over groups by the largest divisible range
    at most, which bounds where the cuts can fall.
    """
    atoms = sorted(_atoms(rows, F.substring("hash", 1, RANGE_BITS // 4)), key=lambda a: a.prefix)
    share = sum(a.size for a in atoms) // shards
    while heavy := {a.prefix for a in atoms if not a.single and a.size * _HEAVY > share}:
        atoms = _split(rows, atoms, heavy)
    # only ranges in which a cut can fall are read again, as one row per group
    inside: DataFrame | None = None
    low = max(max((a.size for a in atoms if a.single), default=0), share)
    while True:
        capacity, cuts = cuts_for([a.size for a in atoms], shards)
        low = max(low, capacity - max((a.size for a in atoms if not a.single), default=0))
        open_ = {a.prefix for a in _windows(atoms, shards, low, capacity) if not a.single}
        if not open_:
            return capacity, [atoms[cut].prefix for cut in cuts]
        if inside is None:
            depth = min(map(len, open_))
            near = rows.filter(F.substring("hash", 1, depth).isin(sorted({p[:depth] for p in open_})))
            inside = saved(near.groupBy("hash").agg(F.sum("size").alias("size")), "shard-groups")
        atoms = _split(inside, atoms, open_)


def shard_documents(
    docs: DataFrame, shards: int = 16, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) for every row of ``docs``.

    Size is the text's UTF-8 bytes plus one, a null text has none and shares the
    group of empty texts. ``slot`` counts the rows of a shard from 0 without
    gaps. Repeated rows are rows of their own; a null id is passed on. No text
    is shuffled: one narrow pass takes sizes and hashes.
    """
    text = text_of(text_column)
    rows = docs.select(
        F.col(id_column).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"), F.md5(text.cast("binary")).alias("hash"),
    )
    rows = saved(rows, "shard-rows")
    _, cuts = group_cuts(rows, shards)
    shard = F.lit(0)
    for cut in cuts:
        shard = shard + (F.col("hash") >= cut).cast("int")
    placed = rows.select(
        "id", "size", "crc", shard.alias("shard"), F.substring("hash", 1, RANGE_BITS // 4).alias("range"),
        F.pmod(F.xxhash64("id", F.lit(11)), F.lit(SALTS)).cast("int").alias("salt"),
    )
    keys = ["shard", "range", "salt"]
    parts = saved(placed.groupBy(*keys).agg(F.count("*").alias("rows")), "shard-parts")
    # rows before a part: whole ranges of its shard first, then the parts of its range
    by_range = parts.groupBy("shard", "range").agg(F.sum("rows").alias("rows"))
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    by_range = by_range.select("range", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("range_base"))
    inside = Window.partitionBy("shard", "range").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select(*keys, F.coalesce(F.sum("rows").over(inside), F.lit(0)).alias("part_base"))
    bases = bases.join(by_range, ["shard", "range"]).select(
        *keys, (F.col("range_base") + F.col("part_base")).alias("base")
    )
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("id", "crc"))
    numbered = placed.withColumn("number", number).join(bases, keys)
    return numbered.select(
        F.col("id").alias(id_column), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"),
        F.col("shard").cast("int"), (F.col("base") + F.col("number") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
