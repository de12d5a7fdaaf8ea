"""Load, profile and export one table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators import statistics as S
from ..operators.cleaning import quarantine, typed_table
from ..sources.sinks import export
from ..sources.tables import TableLayout, rename


@dataclass(frozen=True)
class TableJob:
    """Results of the job: tables stay lazy, exports are done."""

    records: DataFrame
    rejected: DataFrame
    analysis: DataFrame
    domains: DataFrame
    labels: DataFrame
    exported: dict[str, str]


def run_table_job(
    raw: DataFrame, folder: str, formats=("csv", "json"), layout: TableLayout = TableLayout()
) -> TableJob:
    records, rejected = quarantine(typed_table(rename(raw, layout), layout.separator))
    flat = records.select("query_id", "query", "knowledge_domain", "workers")
    return TableJob(
        records, rejected, S.table_analysis(records), S.by_domain(records), S.by_label(records),
        export(flat, folder, formats),
    )
