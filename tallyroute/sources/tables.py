"""Sources: the labelled-request table and the dimension tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import vocab

FORMATS = ("csv", "json", "parquet", "orc")


@dataclass(frozen=True)
class TableLayout:
    """Names of the three text columns in a source, and the label separator."""

    query: str = "query"
    knowledge_domain: str = "knowledge_domain"
    worker: str = "worker"
    separator: str = ","

    @property
    def names(self) -> tuple[str, str, str]:
        return self.query, self.knowledge_domain, self.worker


def check_columns(df: DataFrame, layout: TableLayout = TableLayout()) -> DataFrame:
    """Raise at plan time, naming every missing column."""
    missing = [c for c in layout.names if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}; found: {', '.join(df.columns)}")
    return df


def rename(df: DataFrame, layout: TableLayout = TableLayout()) -> DataFrame:
    """The source's own column names to the standard ones, all as strings."""
    standard = ("query", "knowledge_domain", "worker")
    others = [c for c in df.columns if c not in layout.names]
    return check_columns(df, layout).select(
        *others, *[F.col(c).cast("string").alias(s) for c, s in zip(layout.names, standard)]
    )


def read_requests(
    spark: SparkSession, path: str, fmt: str = "parquet",
    layout: TableLayout = TableLayout(), id_column: str = "query_id", multi_line: bool = False,
) -> DataFrame:
    """Read a labelled-request table: an id and three strings.

    Large CSV files are split among tasks; ``multi_line`` reads records that
    span lines, one task per file. A required column that no record has is an
    error in every format. Extra columns pass. A CSV file whose own header puts other
    names over the columns that are read is an error of the job, never read by position.
    """
    if fmt not in FORMATS:
        raise ValueError(f"unsupported format: {fmt}")
    if fmt == "csv":
        reader = spark.read.options(header=True, enforceSchema=False, multiLine=multi_line, escape='"', emptyValue="")
        found = rename(reader.csv(path), layout)
    elif fmt == "json":
        # the columns are those that occur in the records, so a missing one is seen;
        # values are read as text
        found = rename(spark.read.options(primitivesAsString=True).json(path), layout)
    else:
        found = rename(spark.read.format(fmt).load(path), layout)
    return found.withColumn(id_column, F.col(id_column).cast("bigint")) if id_column in found.columns else found


def label_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(vocab.LABELS)), "idx int, label string")


def domain_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(d,) for d in vocab.DOMAINS], "domain string")
