"""Cleaning and typing of the labelled-request table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as T
from ..functions.labels import join_labels, parse_labels

TEXT_COLUMNS = ("query", "knowledge_domain", "worker")


def drop_null_rows(df: DataFrame, columns=TEXT_COLUMNS) -> DataFrame:
    return df.na.drop("all", subset=list(columns))


def fill_and_trim(df: DataFrame, columns=TEXT_COLUMNS) -> DataFrame:
    return df.withColumns({
        c: F.expr(T.trim_space(f"coalesce({c}, '')")) for c in columns
    })


def drop_blank_rows(df: DataFrame, columns=TEXT_COLUMNS) -> DataFrame:
    return df.filter(" or ".join(f"{c} <> ''" for c in columns))


def clean_table(df: DataFrame, columns=TEXT_COLUMNS) -> DataFrame:
    """Untyped clean table: three narrow steps over one scan."""
    return drop_blank_rows(fill_and_trim(drop_null_rows(df, columns), columns), columns)


def typed_table(df: DataFrame, separator: str = ",") -> DataFrame:
    """Clean table with the label list as an array and as a joined string."""
    return (
        clean_table(df)
        .withColumn("workers_list", F.expr(parse_labels("worker", separator)))
        .withColumn("workers", F.expr(join_labels("workers_list")))
        .drop("worker")
    )


# a record needs a query, a domain and at least one label
BROKEN = "(query = '' or knowledge_domain = '' or size(workers_list) = 0)"
REASON = (
    "case when query = '' then 'query is empty'"
    " when knowledge_domain = '' then 'knowledge domain is empty'"
    " when size(workers_list) = 0 then 'label list is empty' end"
)


def check_strict(df: DataFrame) -> DataFrame:
    """Fail the job on the first broken record, naming it."""
    message = f"concat('record ', query_id, ': ', {REASON})"
    return df.withColumn(
        "query", F.expr(f"case when {BROKEN} then raise_error({message}) else query end")
    )


def quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sound records, and broken ones with the reason."""
    return df.filter(f"not {BROKEN}"), df.filter(BROKEN).withColumn("reason", F.expr(REASON))


def in_order(df: DataFrame, id_column: str = "query_id") -> DataFrame:
    return df.orderBy(id_column)
