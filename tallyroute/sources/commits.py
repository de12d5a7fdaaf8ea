"""Tables whose batches appear whole or not at all.

A batch is written to a folder of its own and counts only by its entry in a log: the
folder, the number of rows, a checksum. The entry is a file that Spark's commit
renames into place, so a reader sees the batch as it was before or as it is after,
never a part of it; a batch that is written again gets a new folder and a later entry.
Counts and checksum are observed while the rows are written, so nothing is read
back. Folders without an entry (a job that ended between data and entry) are
never read.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as TY

from ..operators.ordering import content_hash

# a batch of any kind: a file, a day, a micro-batch of a stream
ENTRY = "batch string, folder string, version bigint, processed bigint, failed bigint, checksum bigint"
_FOLDER = "batch_folder"


def observed_write(df: DataFrame, path: str, fmt: str = "parquet", failed: str = "false", mode: str = "error", **options) -> dict[str, int]:
    """Write ``df`` and return processed and failed rows and a checksum of their content, counted on the way.

    The checksum does not depend on the order of rows.
    """
    bad: Column = F.coalesce(F.expr(failed), F.lit(False))
    seen = Observation()
    watched = df.observe(
        seen, F.count(F.lit(1)).alias("processed"), F.count_if(bad).alias("failed"),
        F.coalesce(F.bit_xor(content_hash(df)), F.lit(0).cast("long")).alias("checksum"),
    )
    watched.write.format(fmt).mode(mode).options(**options).save(path)
    return dict(seen.get)


def commit_batch(df: DataFrame, path: str, batch: object, fmt: str = "parquet", failed: str = "false") -> dict[str, int]:
    """Write a batch of the table at ``path``; it takes the place of an earlier one of the same name.

    Returns the metrics of its entry. A table has one writer at a time.
    """
    folder = f"b-{uuid.uuid4().hex}"
    found = observed_write(df, f"{path}/data/{_FOLDER}={folder}", fmt, failed)
    _write_entry(df.sparkSession, path, (str(batch), folder, time.time_ns(), found["processed"], found["failed"], found["checksum"]))
    return found


def _write_entry(spark: SparkSession, path: str, entry: tuple) -> None:
    spark.createDataFrame([entry], ENTRY).coalesce(1).write.mode("append").parquet(f"{path}/log")


def entries(spark: SparkSession, path: str) -> DataFrame:
    """The entry that counts of each batch; none if nothing was ever committed."""
    try:
        log = spark.read.schema(ENTRY).parquet(f"{path}/log")
    except Exception as error:  # noqa: BLE001 - only a log that is not there is an empty one
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], ENTRY)
    names = [f.name for f in TY.StructType.fromDDL(ENTRY)]
    latest = F.max_by(F.struct(*names), F.struct("version", "folder"))
    return log.groupBy("batch").agg(latest.alias("entry")).select("entry.*")


def committed(spark: SparkSession, path: str, schema: TY.StructType | str, fmt: str = "parquet") -> DataFrame:
    """The rows of all committed batches. The log prunes folders while the scan is planned."""
    declared = TY.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    visible = entries(spark, path).select(F.col("folder").alias(_FOLDER))
    if not visible.take(1):
        return spark.createDataFrame([], declared)
    full = TY.StructType([*declared.fields, TY.StructField(_FOLDER, TY.StringType())])
    rows = spark.read.schema(full).format(fmt).load(f"{path}/data")
    return rows.join(visible, _FOLDER, "left_semi").select(*declared.fieldNames())


def damaged_batches(spark: SparkSession, path: str, schema: TY.StructType | str, fmt: str = "parquet") -> DataFrame:
    """Entries whose rows or checksum differ from what their folder holds now."""
    declared = TY.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    log = entries(spark, path)
    if not log.take(1):
        return log
    full = TY.StructType([*declared.fields, TY.StructField(_FOLDER, TY.StringType())])
    rows = spark.read.schema(full).format(fmt).load(f"{path}/data")
    own = rows.groupBy(F.col(_FOLDER).alias("folder")).agg(
        F.count("*").alias("there"), F.bit_xor(content_hash(rows.drop(_FOLDER))).alias("sum")
    )
    same = (F.coalesce("there", F.lit(0)) == F.col("processed")) & (F.coalesce("sum", F.lit(0)) == F.col("checksum"))
    return log.join(own, "folder", "left").filter(~same).drop("there", "sum")


def totals(spark: SparkSession, path: str) -> DataFrame:
    """Processed, successful and failed rows over all committed batches; reads the log alone."""
    def summed(column: Column, name: str) -> Column:
        return F.coalesce(F.sum(column), F.lit(0)).alias(name)

    return entries(spark, path).agg(
        summed(F.col("processed"), "processed"), summed(F.col("processed") - F.col("failed"), "successful"),
        summed(F.col("failed"), "failed"),
    )
