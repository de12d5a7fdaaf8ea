"""Exact duplicates by progressive refinement: length, prefix hash, full hash.

One narrow pass takes the length and the hash of a short prefix of each text.
Only rows that share both with another row have their whole content hashed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACES, join_groups, key_bitmap, saved, text_of, with_maybe, without_ids

PREFIX = 256


def normalised(text: Column) -> Column:
    """The text without white space; null is empty."""
    return F.translate(text_of(text), SPACES, "")


def full_hash(text: Column) -> Column:
    return F.sha2(normalised(text).cast("binary"), 256)


def _refined(docs: DataFrame, text_column: str) -> tuple[DataFrame, list[Column]]:
    """The bitmap of the (length, prefix hash) pairs that several rows have, and a row's pair."""
    bare = normalised(F.col(text_column))
    pair = [F.octet_length(bare).cast("long"), F.xxhash64(F.substring(bare, 1, PREFIX))]
    narrow = docs.select(pair[0].alias("length"), pair[1].alias("prefix"))
    pairs = saved(narrow.groupBy("length", "prefix").agg(F.count("*").alias("n")), "length-prefix")
    # lengths first: a length that one row has needs no look at its prefix
    shared = key_bitmap(pairs.groupBy("length").agg(F.sum("n").alias("n")).filter("n > 1").select("length"))
    left = with_maybe(pairs.filter("n > 1"), [F.col("length")], shared, "shared").filter("shared")
    return saved(key_bitmap(left.select("length", "prefix")), "shared-prefixes"), pair


def duplicate_groups(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", digest_all: bool = False
) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) for every row of ``docs``.

    Of equal texts the one with the most code points stays, then the smallest
    id (null last). A null text is empty. Rows repeated with one id and one text
    count in ``group_size``; one of them is kept. A row that no other can equal
    is not hashed (its hash is null) unless ``digest_all``. Groups are counted
    with map-side partial sums and hot ones are broadcast back.
    """
    bitmap, pair = _refined(docs, text_column)
    marked = with_maybe(docs.select(id_column, text_column), pair, bitmap, "__maybe")
    lone_hash = full_hash(F.col(text_column)) if digest_all else F.lit(None).cast("string")
    lone = marked.filter(~F.col("__maybe")).select(
        F.col(id_column), F.col(id_column).alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), lone_hash.alias("text_sha256"),
    )
    rows = marked.filter("__maybe").select(
        F.col(id_column).alias("id"), F.length(text_of(text_column)).alias("chars"),
        full_hash(F.col(text_column)).alias("text_sha256"),
    )
    members = saved(rows.groupBy("text_sha256", "id", "chars").agg(F.count("*").alias("copies")), "hashed")
    best = F.min(F.struct(-F.col("chars"), F.col("id").isNull(), F.col("id")))
    groups = members.groupBy("text_sha256").agg(
        best["id"].alias("keep_id"), F.min(F.struct(-F.col("chars"), F.col("id").isNull(), F.col("id")))["col1"].alias("most"),
        F.sum("copies").alias("group_size"),
    )
    groups = saved(groups, "groups")
    joined = join_groups(members, groups, "text_sha256", "group_size")
    copy = joined.select("*", F.explode(F.expr("sequence(1L, copies)")).alias("copy"))
    first = F.col("id").eqNullSafe(F.col("keep_id")) & (-F.col("chars") == F.col("most")) & (F.col("copy") == 1)
    equal = copy.select(
        F.col("id").alias(id_column), "keep_id", F.col("group_size").cast("long"), first.alias("kept"), "text_sha256"
    )
    return lone.unionByName(equal)


def drop_exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they were.

    Rows that stay are not shuffled. Rows repeated with one id and text become
    one row; of an id with several texts all rows stay if one does; rows with a
    null id stay.
    """
    groups = duplicate_groups(docs, id_column, text_column).filter("group_size > 1")
    ids = saved(groups.groupBy(id_column).agg(F.max("kept").alias("kept"), F.count("*").alias("n")), "verdicts")
    rows = without_ids(docs, ids.filter("not kept").select(id_column), id_column)
    repeated = ids.filter("kept and n > 1").select(id_column)
    if not repeated.take(1):
        return rows
    marked = with_maybe(rows, [F.col(id_column)], key_bitmap(repeated), "__maybe")
    again = marked.filter("__maybe").drop("__maybe").withColumn("__hash", full_hash(F.col(text_column)))
    again = again.dropDuplicates([id_column, "__hash"]).drop("__hash")
    return marked.filter("not __maybe").drop("__maybe").unionByName(again)
