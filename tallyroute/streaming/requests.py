"""Structured Streaming over request files.

The streaming plans are the batch functions applied to a stream. Narrow plans go to
the file sink, whose commit log makes each micro-batch appear exactly once. Plans
that join (a large gazetteer) and runs that are counted go batch by batch into a
table with a log of its batches, where a batch that is delivered again replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.commits import commit_batch, totals


def read_stream(
    spark: SparkSession, folder: str, schema, fmt: str = "parquet",
    files_per_batch: int | None = None,
) -> DataFrame:
    """New files of a folder (or of a glob) as an unbounded table."""
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)


def skip_failed(df: DataFrame) -> DataFrame:
    """Drop rows whose processing failed and go on."""
    return df.filter("error is null")


def run_stream(
    stream: DataFrame, transform: Callable[[DataFrame], DataFrame], output: str, checkpoint: str,
    fmt: str = "parquet", partition_by: list[str] | None = None,
) -> StreamingQuery:
    """Process everything that is available, append the results, and stop."""
    writer = transform(stream).writeStream.format(fmt).outputMode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    query = (
        writer.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start(output)
    )
    query.awaitTermination()
    return query


def write_batch(
    batch: DataFrame, batch_id: int, transform: Callable[[DataFrame], DataFrame], output: str,
    failed: str = "false", fmt: str = "parquet",
) -> dict[str, int]:
    """One micro-batch as a batch of the table at ``output``; returns its counters.

    The batch carries its number, so one that is delivered again takes its own
    place. ``transform`` sees a batch table, so joins of any kind are allowed. Rows
    for which ``failed`` holds are counted while they are written, and stay.
    """
    return commit_batch(transform(batch), output, batch_id, fmt, failed)


def run_batches(
    stream: DataFrame, transform: Callable[[DataFrame], DataFrame], output: str, checkpoint: str, **options,
) -> StreamingQuery:
    """``write_batch`` for every micro-batch that is available, then stop.

    ``sources.commits.committed`` reads the output, also while it is written.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, batch_id, transform, output, **options)

    query = (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def progress_totals(spark: SparkSession, output: str) -> DataFrame:
    """Processed, successful and failed rows over all micro-batches ever written; no data is read."""
    return totals(spark, output)
