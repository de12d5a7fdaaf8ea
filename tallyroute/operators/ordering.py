"""Positions, batches, samples and first-of-each operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as TY

from ..session import saved
from .selection import smallest_rows

# monotonically_increasing_id: the partition above these bits, the row's place in them
_PLACE_BITS = 33
SALTS = 64


def first_rows(df: DataFrame, n: int, id_column: str = "query_id") -> DataFrame:
    """The ``n`` rows of the smallest ids; null ids come last."""
    return smallest_rows(df, n, [id_column])


def top_counts(df: DataFrame, column: str, k: int) -> DataFrame:
    counts = df.groupBy(column).agg(F.count("*").alias("count"))
    return counts.orderBy(F.desc("count"), column).limit(k)


def with_positions(df: DataFrame, by: str | list[str] = "query_id") -> DataFrame:
    """Add the 0-based ``position`` of each row in the order of ``by``, without a global window.

    Keys may be of any type that sorts; nulls come last, and rows of equal keys
    follow a hash of their content, so that the numbers do not depend on how the
    table is partitioned. Rows are dealt into ranges by sampled boundaries and sorted
    there; a row's place in its range is counted as it is written, and ranges
    start where the sizes of those before them end. No window holds more than one
    row per range. Equal rows are told apart by their place in their sorted input
    partition, which a repeated task finds again, so a key or even a row that fills
    a third of the table is spread over ranges like any other. The numbered rows
    are a written table: what reads them sees the same positions each time.
    """
    keys = [by] if isinstance(by, str) else list(by)
    digest, tie, at, part, start = unused_names(df, "digest", "tie", "at", "part", "start")
    order = [F.col(k).asc_nulls_last() for k in keys]
    told = df.withColumn(digest, content_hash(df)).sortWithinPartitions(*order, digest)
    told = told.withColumn(tie, F.monotonically_increasing_id())
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = told.repartitionByRange(ranges, *order, F.col(digest), F.col(tie))
    ranged = ranged.sortWithinPartitions(*order, digest, tie).drop(digest, tie)
    # the number of the range above the low bits, the place in it in them
    numbered = saved(ranged.withColumn(at, F.monotonically_increasing_id()), "positions")
    of_range = F.shiftright(at, _PLACE_BITS).alias(part)
    sizes = numbered.select(of_range).groupBy(part).agg(F.count("*").alias(at))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(part, F.coalesce(F.sum(at).over(before), F.lit(0)).alias(start))
    place = F.col(at).bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    return (
        numbered.withColumn(part, F.shiftright(at, _PLACE_BITS))
        .join(F.broadcast(starts), part)
        .withColumn("position", F.col(start) + place)
        .drop(part, start, at)
    )


def unused_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that ``df`` does not have, one for each of ``wanted``."""
    taken = {c.lower() for c in df.columns}
    names = []
    for name in wanted:
        name = f"_{name}"
        while name.lower() in taken:
            name += "_"
        names.append(name)
    return names


def content_hash(df: DataFrame) -> Column:
    """A 64-bit hash of all columns; maps and variants are hashed as JSON."""
    def hashable(kind: TY.DataType) -> bool:
        if isinstance(kind, TY.ArrayType):
            return hashable(kind.elementType)
        if isinstance(kind, TY.StructType):
            return all(hashable(f.dataType) for f in kind.fields)
        return not isinstance(kind, (TY.MapType, TY.VariantType))

    parts = [
        F.col(f"`{f.name}`") if hashable(f.dataType) else F.to_json(F.struct(F.col(f"`{f.name}`")))
        for f in df.schema.fields
    ]
    return F.xxhash64(*parts) if parts else F.lit(0).cast("long")


def with_batch_ids(
    df: DataFrame, size: int, id_column: str = "query_id", dense: bool = False
) -> DataFrame:
    """Fixed-size batches in id order, null ids last. Dense ids (0, 1, 2, ...) need no shuffle."""
    if dense:
        return df.withColumn("batch_id", F.expr(f"{id_column} div {size}"))
    return with_positions(df, id_column).withColumn(
        "batch_id", F.expr(f"position div {size}")
    ).drop("position")


def seeded_hash(id_column: str, seed: int) -> Column:
    return F.xxhash64(F.col(id_column), F.lit(seed))


def portable_hash(id_column: str, seed: int) -> Column:
    """A multiplicative hash any SQL engine can repeat; ids of any size fit."""
    return F.expr(f"(pmod({id_column}, 2147483648) * 2654435761 + {seed}) % 4294967296")


def sample_rows(
    df: DataFrame, n: int, seed: int = 42, id_column: str = "query_id", order: Column | None = None
) -> DataFrame:
    """Uniform sample of ``min(n, rows)`` rows, repeatable for a seed."""
    (key,) = unused_names(df, "order")
    keyed = df.withColumn(key, seeded_hash(id_column, seed) if order is None else order)
    return smallest_rows(keyed, n, [key, id_column]).drop(key)


def first_per_group(
    df: DataFrame, group: str, order: list[Column], limits: dict[str, int] | int,
    salt_by: str = "query_id", salts: int = SALTS,
) -> DataFrame:
    """The first rows of each group, in two exact rounds.

    Each group is first cut per salt, so one hot group is spread over ``salts``
    tasks and leaves at most ``limit`` rows per salt for the second round. With
    a mapping, groups that are not listed are dropped.
    """
    if isinstance(limits, int):
        largest, quota = limits, F.lit(limits)
    else:
        if not limits:
            return df.limit(0)
        df = df.filter(F.col(group).isin(*limits))
        largest = max(limits.values())
        quota = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])[F.col(group)]

    def cut(rows: DataFrame, *keys: str) -> DataFrame:
        window = Window.partitionBy(*keys).orderBy(*order)
        ranked = rows.withColumn("_rank", F.row_number().over(window))
        # the literal bound lets Spark drop rows before the shuffle
        return ranked.filter((F.col("_rank") <= largest) & (F.col("_rank") <= quota)).drop("_rank")

    salted = df.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(salts)))
    return cut(cut(salted, group, "_salt").drop("_salt"), group)


def stratified_sample(
    df: DataFrame, category: str, quotas: dict[str, int], seed: int = 42,
    id_column: str = "query_id", order: Column | None = None,
) -> DataFrame:
    """Up to a quota per category (short ones whole), with a shuffled ``sample_order``.

    The threshold of each category is found by counting digits of the order, so
    no task ever holds a quota.
    """
    order = seeded_hash(id_column, seed) if order is None else order
    listed = df.filter(F.col(category).isin(*quotas)) if quotas else df.limit(0)
    return smallest_rows(listed.withColumn("sample_order", order), quotas, ["sample_order", id_column], category)


def until_critical(df: DataFrame, id_column: str = "query_id", word: str = "critical") -> DataFrame:
    """Rows up to and including the first whose error mentions ``word``."""
    stop = (
        df.filter(F.lower("error").contains(word))
        .agg(F.min(id_column).alias("stop")).scalar()
    )
    return df.filter(F.col(id_column) <= F.coalesce(stop, F.lit(2**63 - 1)))
