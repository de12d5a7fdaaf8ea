"""Small tables the tests share."""

from __future__ import annotations

import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, rows, extra: bool = False):
    """``rows``: texts, or (id, text), or (id, text, source)."""
    full = []
    for number, row in enumerate(rows):
        doc_id, text, source = (row if len(row) == 3 else (*row, "src")) if isinstance(row, tuple) else (number, row, "src")
        full.append((doc_id, text, "en", source, None if text is None else len(text)))
    df = spark.createDataFrame(full, SCHEMA)
    if extra:  # names that operators use themselves
        from pyspark.sql import functions as F

        for name in ("kept", "size", "id", "code", "mark", "word", "path", "shard", "number", "text_sha256"):
            df = df.withColumn(name, F.lit("own"))
    return df


AWKWARD = [
    (1, None, None), (2, "", "a"), (3, " \t\n\x0b\x0c\r ", "a"), (4, "one", "b"), (5, "one", "b"), (5, "one", "b"),
    (6, "o\nne", None), (None, "one two three four five six", "a"), (None, None, "b"), (7, "x" * 30_000, "é"),
    (8, ("ä long text of words " * 3000).strip(), "c"), (9, "a@b.c 1.2.3.4 +1 555 123 4567", "c"), (10, "日本 語 😀", "a"),
]


def read(spark, folder: str, name: str):
    return spark.read.parquet(f"{folder}/{name}.parquet")
