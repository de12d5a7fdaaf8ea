"""Sinks and flat reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from ..operators.ordering import with_batch_ids

WRITABLE = ("csv", "json", "parquet")
# files per key at most, when output is split by a column
KEY_FILES = 8


def _write(
    df: DataFrame, fmt: str, path: str, mode: str, keys: list[str], rows: int | None, files: int = KEY_FILES
) -> None:
    if keys:
        # a task writes few folders: rows meet by key and, for hot keys, by one of a few salts
        salt = F.pmod(F.xxhash64(*df.columns), F.lit(files))
        df = df.repartition(*[F.col(k) for k in keys], salt)
    writer = df.write.mode(mode)
    if keys:
        writer = writer.partitionBy(*keys)
    if rows:
        writer = writer.option("maxRecordsPerFile", rows)
    if fmt == "csv":
        writer = writer.options(
            header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
        )
    writer.format(fmt).save(path)


def export(
    df: DataFrame, folder: str, formats=("csv", "json"), mode: str = "overwrite",
    batch_column: str | None = None, batch_size: int | None = None, counted: dict[str, int] | None = None,
) -> dict[str, str]:
    """Write one table in several formats; returns format -> path.

    An unsupported format, or one that fails, is reported under
    ``<format>_error`` and the rest continue. Output may be split by a column
    (one folder per value) or into files of at most ``batch_size`` records. The
    records of each format are counted while they are written, into ``counted``.
    """
    results: dict[str, str] = {}
    for fmt in formats:
        if fmt not in WRITABLE:
            results[f"{fmt}_error"] = f"Unsupported format: {fmt}"
            continue
        path = f"{folder}/{fmt}"
        try:
            seen = Observation()
            watched = df if counted is None else df.observe(seen, F.count(F.lit(1)).alias("records"))
            _write(watched, fmt, path, mode, [batch_column] if batch_column else [], batch_size)
            results[fmt] = path
            if counted is not None:
                counted[fmt] = seen.get["records"]
        except Exception as error:  # noqa: BLE001 - reported, as the other formats go on
            results[f"{fmt}_error"] = str(error)
    return results


def export_batches(df: DataFrame, path: str, size: int, fmt: str = "parquet", id_column: str = "query_id") -> None:
    """Batches of exactly ``size`` records in id order (the last may be short), one folder each."""
    batches = with_batch_ids(df, size, id_column)
    _write(batches, fmt, path, "overwrite", ["batch_id"], None, files=1)


def append_batch(df: DataFrame, path: str, fmt: str = "json") -> None:
    _write(df, fmt, path, "append", [], None)


def manifest(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """``format, path, size_bytes, records`` of every file written by ``export``."""
    parts = []
    for fmt, path in paths.items():
        if fmt.endswith("_error"):
            continue
        # one column is enough to count records, and no schema is inferred
        reader = spark.read if fmt == "parquet" else spark.read.schema("query_id string")
        if fmt == "csv":
            reader = reader.option("header", True).option("enforceSchema", False)
        files = reader.format(fmt).load(path).select(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_size").alias("size_bytes"),
        )
        parts.append(
            files.groupBy("path", "size_bytes").agg(F.count("*").alias("records"))
            .select(F.lit(fmt).alias("format"), "path", "size_bytes", "records")
        )
    if not parts:
        return spark.createDataFrame([], "format string, path string, size_bytes bigint, records bigint")
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def manifest_at_write(spark: SparkSession, paths: dict[str, str], counted: dict[str, int]) -> DataFrame:
    """``format, path, files, size_bytes, records`` of an export, without reading what it wrote.

    Records are those ``export`` counted; files and sizes come from the listing
    (``binaryFile`` opens no file for these columns).
    """
    schema = "format string, path string, files bigint, size_bytes bigint, records bigint"
    whole = spark.createDataFrame([], schema)
    for fmt, path in paths.items():
        if fmt.endswith("_error"):
            continue
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("length")
        whole = whole.unionByName(listed.agg(
            F.lit(fmt).alias("format"), F.lit(path).alias("path"), F.count("*").alias("files"),
            F.sum("length").alias("size_bytes"), F.lit(counted[fmt]).cast("bigint").alias("records"),
        ))
    return whole


def write_envelope(results: DataFrame, folder: str, metadata: DataFrame) -> None:
    """Results as JSON lines beside a one-row metadata table."""
    results.write.mode("overwrite").json(f"{folder}/results")
    metadata.write.mode("overwrite").json(f"{folder}/metadata")


def flat_results(analysis: DataFrame) -> DataFrame:
    """List columns replaced by counts, labels joined, null errors blank."""
    return analysis.selectExpr(
        "query_id", "query as original_query", "knowledge_domain",
        "array_join(workers_list, ', ') as workers", "lang as detected_language",
        "size(tokens) as token_count", "size(entities) as entity_count",
        "sentiment_score", "word_count", "size(keywords) as keyword_count",
        "size(topics) as topic_count", "success", "coalesce(error_message, '') as error_message",
    )


def flat_sentences(analysis: DataFrame) -> DataFrame:
    """Counts plus the first tokens, keywords and issues joined by ``|``."""
    def counts(*names: str) -> list[str]:
        return [f"size({n}) as {n}_count" for n in names]

    return analysis.selectExpr(
        "query_id", "query as original_query", "knowledge_domain", "workers as worker",
        "lang as language", "word_count", "sentence_count",
        "round(avg_word_length, 6) as avg_word_length",
        *counts("tokens", "pos_tags", "entities", "keywords", "topics", "grammar_issues"),
        "sentiment_score",
        "array_join(slice(tokens, 1, 10), '|') as tokens",
        "array_join(slice(keywords, 1, 5), '|') as keywords",
        "array_join(topics, '|') as topics",
        "array_join(slice(grammar_issues, 1, 3), '|') as grammar_issues",
    )
