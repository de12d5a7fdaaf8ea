"""Hooks for user functions (U1-U4). The only place where Python sees rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as TY
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import text as T

Row = dict[str, Any]
# bytes of an Arrow batch between the JVM and Python, unless the session says otherwise
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def map_batches(
    df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | TY.StructType
) -> DataFrame:
    """``mapInArrow`` over batches bounded by bytes as well as rows, so long texts make small ones."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH_SETTING, None) is None:
        conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    return df.mapInArrow(fn, schema)


def apply_rows(df: DataFrame, fn: Callable[[Row], Row], schema: str | TY.StructType) -> DataFrame:
    """``fn`` on each row in Arrow batches; an exception becomes the row's ``error``.

    The result has the declared columns (null where the function failed) and a
    nullable ``error`` string.
    """
    declared = TY.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names = declared.fieldNames()
    out = TY.StructType([*declared.fields, TY.StructField("error", TY.StringType())])

    def one(row: Row) -> Row:
        try:
            return {**fn(row), "error": None}
        except Exception as error:  # noqa: BLE001 - recorded with the row
            kept = {n: row[n] for n in names if n in row}
            return {**kept, "error": str(error) or type(error).__name__}

    arrow = to_arrow_schema(out)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = [one(row) for row in part.to_pylist()]
            yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in arrow.names} for r in rows], arrow)

    return df.mapInArrow(batches, out)


def apply_chunks(
    df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str,
    chunk_column: str = "batch_id",
) -> DataFrame:
    """``fn`` once per fixed-size chunk; the chunk size bounds what a task holds."""
    return df.groupBy(chunk_column).applyInPandas(fn, schema)


def apply_groups(
    df: DataFrame, key: str, partial: Callable[[pd.DataFrame], pd.DataFrame], schema: str | TY.StructType,
    merge: list[Column], rows: int = 10_000, combine: Callable[[pd.DataFrame], pd.DataFrame] | None = None,
    held: int = 50_000,
) -> DataFrame:
    """``partial`` on pieces of each group of a column, then ``merge`` per group.

    The table streams through each task in Arrow batches. ``partial`` sees at most
    ``rows`` rows of one key at a time and returns partial rows with the key (sums,
    counts, extremes); ``merge`` are the aggregates that combine them, first in
    the task and then, after the only shuffle, over all tasks. So neither a batch nor
    a task's memory depends on the size of a group, and no row of the table is
    shuffled. ``combine``, if given, joins partial rows of the same keys in
    the task as soon as ``held`` of them wait; they are passed on when that leaves
    more than half of them. A null key is a group like any other.
    """
    declared = TY.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(declared)

    def called(batch: pa.RecordBatch) -> Iterator[pd.DataFrame]:
        table = pa.Table.from_batches([batch])
        codes = batch.column(key).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        order = np.argsort(codes, kind="stable")
        cuts = np.flatnonzero(np.diff(codes[order])) + 1
        for place in np.split(order, cuts):
            for at in range(0, len(place), rows):
                part = table.take(pa.array(place[at : at + rows]))
                yield partial(part.to_pandas(integer_object_nulls=True))

    def rows_of(frames: list[pd.DataFrame]) -> pa.RecordBatch:
        whole = pd.concat(frames, ignore_index=True) if len(frames) > 1 else frames[0]
        return pa.RecordBatch.from_pandas(whole[arrow.names], arrow, preserve_index=False)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pd.DataFrame] = []
        count = 0
        for batch in parts:
            if not batch.num_rows:
                continue
            for frame in called(batch):
                waiting.append(frame)
                count += len(frame)
                if count > held and combine:
                    waiting = [combine(pd.concat(waiting, ignore_index=True))]
                    count = len(waiting[0])
                if count > (held // 2 if combine and len(waiting) == 1 else held):
                    yield rows_of(waiting)
                    waiting, count = [], 0
        if waiting:
            yield rows_of([combine(pd.concat(waiting, ignore_index=True))] if combine else waiting)

    return df.mapInArrow(batches, declared).groupBy(key).agg(*merge)


ANNOTATION = (
    "tokens array<string>, pos_tags array<struct<token:string,tag:string>>,"
    f" lemmas array<string>, entities {T.ENTITIES},"
    " sentiment struct<compound:double,pos:double,neu:double,neg:double>,"
    " dependencies array<struct<text:string,head:string,dep:string,pos:string>>"
)


def annotate(
    df: DataFrame, make_annotator: Callable[[], Callable[[str], Row]] | None = None,
    text: str = "query",
) -> DataFrame:
    """Tokens, tags, lemmas, entities, sentiment and dependencies of a text column.

    Without an annotator the built-in defaults are used, natively. Otherwise
    ``make_annotator`` runs once per task and its result is called per text; a
    failing text yields a row of nulls with its ``error``.
    """
    if make_annotator is None:
        parts = T.tokens(text)
        return df.withColumns({
            "tokens": F.expr(parts), "pos_tags": F.expr(T.default_tags(parts)),
            "lemmas": F.expr(parts), "entities": F.expr(T.empty(T.ENTITIES)),
            "sentiment": F.expr(T.neutral_sentiment()),
            "dependencies": F.expr(T.default_dependencies(parts)),
            "error": F.lit(None).cast("string"),
        })

    added = TY.StructType.fromDDL(ANNOTATION + ", error string")
    out = TY.StructType([*df.schema.fields, *added.fields])
    arrow = to_arrow_schema(added)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annotator = make_annotator()

        def one(value: str | None) -> Row:
            try:
                return {**annotator(value or ""), "error": None}
            except Exception as error:  # noqa: BLE001 - recorded with the row
                return {"error": str(error) or type(error).__name__}

        for part in parts:
            # the other columns pass as they came
            rows = [one(value) for value in part.column(text).to_pylist()]
            new = pa.RecordBatch.from_pylist([{n: r.get(n) for n in arrow.names} for r in rows], arrow)
            yield pa.RecordBatch.from_arrays([*part.columns, *new.columns], [*part.schema.names, *arrow.names])

    return df.mapInArrow(batches, out)
