"""Helpers the operators share: saved tables, hot-group joins, id bitmaps, components."""

from __future__ import annotations

import ctypes
import gc
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import new_path

# white space of the contracts: space and the controls 9 to 13
SPACES = " \t\n\x0b\x0c\r"
WORD = "[^ \\t-\\r]+"
# a group above 1/HOT_SHARE of all rows is hot, so there are at most HOT_SHARE of them
HOT_SHARE = 500
# bits of a broadcast bitmap: 2^25 bits are 4 MB whatever the table's size
BITMAP_BITS = 1 << 25
_BUCKET_BITS = 32_768
# bytes of an Arrow batch between the JVM and Python, unless the session says otherwise
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_of(column: str | Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def give_back() -> None:
    """Return freed memory of Arrow and of the C library to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def map_batches(
    df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """``mapInArrow``; a worker gives its spare memory back when its task ends.

    Batches are bounded by bytes as well as rows, so very long texts make small batches.
    A bound that the session sets itself is left as it is.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH_SETTING, None) is None:
        conf.set(_BATCH_SETTING, str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        give_back()

    return df.mapInArrow(run, schema)


def join_groups(members: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """Join saved ``members`` with the one row of their group.

    Groups of more than 1/HOT_SHARE of all rows (at most HOT_SHARE of them) are
    broadcast, so their members stay where they are; the others meet in a shuffle.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    is_hot = F.col(size) * HOT_SHARE > F.lit(total)
    hot, cold = F.broadcast(groups.filter(is_hot)), groups.filter(~is_hot)
    rest = members.join(F.broadcast(groups.filter(is_hot).select(key)), key, "left_anti")
    return members.join(hot, key).unionByName(rest.join(cold, key))


def small_side(df: DataFrame, bound: int) -> DataFrame:
    """A broadcast hint if ``df`` has at most ``bound`` rows; else the join shuffles.

    The result of the join is the same either way.
    """
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df


def key_bitmap(keys: DataFrame, bits: int = BITMAP_BITS) -> DataFrame:
    """A bitmap of the hashed rows of ``keys``: at most ``bits`` / 32,768 rows of 4 KB."""
    place = F.pmod(F.xxhash64(*keys.columns), F.lit(bits))
    return (
        keys.select(place.alias("__place"))
        .groupBy(F.expr(f"__place div {_BUCKET_BITS}").alias("__bucket"))
        .agg(F.expr(f"bitmap_construct_agg(__place % {_BUCKET_BITS})").alias("__bitmap"))
    )


def with_maybe(df: DataFrame, keys: list[Column], bitmap: DataFrame, name: str, bits: int = BITMAP_BITS) -> DataFrame:
    """Add boolean ``name``: false says for certain that the row's key is not in the bitmap."""
    place = F.pmod(F.xxhash64(*keys), F.lit(bits))
    marked = df.withColumn("__place", place).withColumn("__bucket", F.expr(f"__place div {_BUCKET_BITS}"))
    joined = marked.join(F.broadcast(bitmap), "__bucket", "left")
    byte = f"cast(conv(hex(substring(__bitmap, cast(__place % {_BUCKET_BITS} div 8 as int) + 1, 1)), 16, 10) as int)"
    bit = F.expr(f"shiftright({byte}, cast(__place % 8 as int)) & 1")
    return joined.withColumn(name, F.coalesce(bit == 1, F.lit(False))).drop("__place", "__bucket", "__bitmap")


def without_ids(docs: DataFrame, dropped: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id is not in ``dropped`` (a saved one-column table).

    A bitmap lets most rows pass in place; only rows that may be dropped are
    shuffled, for an exact anti-join. Rows with a null id are kept.
    """
    dropped = dropped.select(F.col(id_column).alias("__dropped_id"))
    marked = with_maybe(docs, [F.col(id_column)], key_bitmap(dropped), "__maybe")
    passed = marked.filter(~F.col("__maybe")).drop("__maybe")
    checked = marked.filter("__maybe").drop("__maybe").join(
        dropped, F.col(id_column) == F.col("__dropped_id"), "left_anti"
    )
    return passed.unionByName(checked)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is its smallest node.

    Alternating large-star and small-star rounds: every round links nodes to the
    smallest neighbour known, by aggregates that combine map-side and joins with
    one row per node. Each round is written to the shared folder.
    """
    both = edges.filter("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    ).distinct()
    current, state = saved(both, "edges"), None
    while True:
        now = current.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state or now[0] == 0:
            break
        state = now
        # large star: every larger neighbour of u goes to the smallest neighbour of u
        ways = current.select("u", "v").union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ways.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = ways.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        # small star: u and its smaller neighbours go to the smallest of them
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(smallest, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = saved(moved.union(smallest.select("u", F.col("m").alias("v"))).distinct(), "edges")
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots).distinct()


def crc_fold(id_column: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % folds


def crc_fold_of(value: object, folds: int = 5) -> int:
    return zlib.crc32(("" if value is None else str(value)).encode()) % folds


def text_runs(texts: list[str], size: int = 2_000_000) -> Iterator[tuple[int, list[str]]]:
    """Slices of a batch with a bounded number of characters, one text at least."""
    start, length = 0, 0
    for row, text in enumerate(texts):
        if row > start and length + len(text) > size:
            yield start, texts[start:row]
            start, length = row, 0
        length += len(text)
    if texts:
        yield start, texts[start:]
