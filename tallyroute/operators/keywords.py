"""Keywords of long texts as a distributed job."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import vocab
from .userfn import map_batches

# characters of a text that are split at a time
PIECE = 1 << 20


def document_keywords(
    df: DataFrame, id_column: str, text: str, language: str, limit: int = vocab.KEYWORD_LIMIT
) -> DataFrame:
    """``id, keywords``: most frequent tokens, ties by first appearance.

    For texts of any length: tokens are counted where the text is read, a piece of
    the text at a time, so neither texts nor tokens are shuffled and a task holds
    the distinct tokens of one text. Copies in a batch are counted once. The one shuffle
    carries a digest and at most ``limit`` words per text; rows then meet the
    keywords of their text, so ids may be null or repeated. Texts without a keyword have no
    row. ``functions.text.keywords`` does the same inside one row for short texts.
    """
    key = F.sha2(F.concat_ws("\0", F.coalesce(F.col(language), F.lit("")), text).cast("binary"), 256)
    keyed = df.filter(F.col(text).isNotNull()).withColumn("_key", F.unhex(key))
    # lower-cased by Spark, as elsewhere; no letter's case depends on those beyond a space
    texts = keyed.select("_key", F.col(language).alias("_lang"), F.lower(text).alias("_text"))

    stop = {code: frozenset(terms) for code, terms in vocab.STOP_WORDS.items()}
    shortest, piece = vocab.KEYWORD_MIN_LENGTH, PIECE

    def top(lowered: str, dropped) -> list[str]:
        counts: Counter[str] = Counter()    # keeps the order of first appearance
        start = 0
        while start < len(lowered):
            end = start + piece
            # no token is cut: a piece ends before white space, or with the text
            while end < len(lowered) and not lowered[end].isspace():
                end += 1
            counts.update(lowered[start:end].split())
            start = end
        kept = [(-n, i, w) for i, (w, n) in enumerate(counts.items()) if len(w) >= shortest and w not in dropped]
        return [w for _, _, w in sorted(kept)[:limit]]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {}
            for at, (digest, code) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if digest not in found:
                    found[digest] = top(batch.column(2)[at].as_py(), stop.get(code, ()))
            found = {digest: words for digest, words in found.items() if words}
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.binary()), pa.array(found.values(), pa.list_(pa.string()))], ["_key", "keywords"])

    found = map_batches(texts, counted, "_key binary, keywords array<string>").dropDuplicates(["_key"])
    return keyed.select(id_column, "_key").join(found, "_key").select(id_column, "keywords")

