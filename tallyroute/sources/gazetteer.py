"""Gazetteer: a table of place names stacked from the text columns of any tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F, types as TY

from ..functions import text as T, vocab


def build_gazetteer(*tables: DataFrame) -> DataFrame:
    """``name, name_norm, n_tokens``: distinct names of every string column."""
    def stacked(df: DataFrame) -> DataFrame:
        names = [f.name for f in df.schema if isinstance(f.dataType, TY.StringType)]
        cells = F.array(*[F.col(n) for n in names]) if names else F.expr(T.empty())
        return df.select(F.explode(cells).alias("name"))

    name = F.col("name")
    usable = name.isNotNull() & (name != "") & ~F.lower(name).isin(*vocab.GAZETTEER_PLACEHOLDERS)
    cells = reduce(DataFrame.unionByName, [stacked(df) for df in tables])
    return (
        cells.filter(usable).distinct()
        .withColumn("name_norm", F.expr(T.normalize("name")))
        .filter(F.col("name_norm") != "")
        .withColumn("n_tokens", F.size(F.split("name_norm", " ")))
    )


def list_locations(gazetteer: DataFrame, normalized: bool = False) -> DataFrame:
    column = "name_norm" if normalized else "name"
    return gazetteer.select(F.col(column).alias("location")).distinct()


def count_locations(gazetteer: DataFrame) -> DataFrame:
    return gazetteer.agg(F.countDistinct("name_norm").alias("location_count"))
