"""Row filters over the typed request table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .selection import smallest_rows


def by_domain(df: DataFrame, domain: str) -> DataFrame:
    return df.filter(F.col("knowledge_domain") == domain)


def by_label(df: DataFrame, label: str) -> DataFrame:
    return df.filter(F.array_contains("workers_list", label))


def by_text(df: DataFrame, needle: str, literal: bool = False) -> DataFrame:
    """Case-insensitive search; the needle is a regular expression unless literal."""
    if literal:
        return df.filter(F.lower("query").contains(needle.lower()))
    return df.filter(F.col("query").rlike(f"(?iu){needle}"))


def combined(
    df: DataFrame, text: str | None = None, domain: str | None = None, label: str | None = None
) -> DataFrame:
    """Every criterion that is given; the equality comes first so it is pushed down."""
    if domain:
        df = by_domain(df, domain)
    if label:
        df = by_label(df, label)
    return by_text(df, text) if text else df


def by_joined_labels(df: DataFrame, joined: str) -> DataFrame:
    return df.filter(F.col("workers") == joined)


def failed(df: DataFrame) -> DataFrame:
    return df.filter("error is not null")


def succeeded(df: DataFrame) -> DataFrame:
    return df.filter("error is null")


def split_by_flag(df: DataFrame, flag: str) -> tuple[DataFrame, DataFrame]:
    return df.filter(flag), df.filter(f"not coalesce({flag}, false)")


def prefer_language(
    df: DataFrame, language: str, wanted: int, others: int,
    column: str = "lang", id_column: str = "query_id",
) -> DataFrame:
    """First ``wanted`` rows of a language topped up with others, by id."""
    is_language = F.col(column) == language
    first = smallest_rows(df.filter(is_language), wanted, [id_column])
    rest = smallest_rows(df.filter(~F.coalesce(is_language, F.lit(False))), others, [id_column])
    return first.unionByName(rest)
