"""End-to-end labelling of a text column (batch or stream)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import text as T, vocab
from ..functions.vectors import Vector, rank_labels, round6, sum_vectors
from ..operators.detectors import Detector, TextViews
from ..operators.lookup import (
    INLINE_NAMES, computed_once, inline_names, matched_texts, mentions_location, place_word_list,
    text_key,
)

Reducer = Callable[[Sequence[Vector]], list[str]]
VOTES = [f"vote_{i}" for i in range(len(vocab.LABELS))]


def text_views(
    df: DataFrame, text: str, entities: str | None = None,
    gazetteer: DataFrame | None = None, inline_limit: int = INLINE_NAMES,
) -> tuple[DataFrame, TextViews]:
    """Add the text forms the detectors share, computed once per row.

    A bounded gazetteer is tested inside the row. A larger one is joined with the
    distinct texts, which meet their rows by digest; the flag depends on the
    text alone either way. A stream takes a large one batch by batch (``run_batches``).
    """
    location = None
    df = df.withColumn("_lower", F.expr(f"lower({text})"))
    df = df.withColumn("_spaced", F.expr(T.spaced_words("_lower")))
    added = {"_stripped": T.trim_space("_lower"), "_words": "split(_spaced, ' ')"}
    if gazetteer is not None:
        location = "_location"
        names = inline_names(gazetteer, inline_limit)
        if names is not None:
            df = df.withColumn("_place", F.expr(place_word_list(text, "_spaced")))
            added["_location"] = mentions_location(text, "_place", names)
        else:
            found = matched_texts(df, text, gazetteer).select("_text_key", F.lit(True).alias("_location"))
            df = df.withColumn("_text_key", text_key(text)).join(found, "_text_key", "left").drop("_text_key")
            df = df.withColumn("_location", F.coalesce("_location", F.lit(False)))
    df = df.withColumns({n: F.expr(e) for n, e in added.items()})
    # white space is collapsed where a test needs it only
    return df, TextViews(text, "_lower", "_stripped", T.collapse_space("_lower"), "_words", entities, location)


def detector_flags(
    df: DataFrame, detectors: Sequence[Detector], text: str = "query", **views
) -> DataFrame:
    """The input columns plus one boolean ``<detector>_<flag>`` per flag."""
    keep = df.columns
    df, view = text_views(df, text, **views)
    flags = {
        f"{d.name}_{name}": f"coalesce({flag}, false)"
        for d in detectors for name, flag in d.flags(view).items()
    }
    flagged = df.selectExpr(*keep, *[f"{e} as {n}" for n, e in flags.items()])
    return computed_once(flagged, keep, list(flags))


def spread_rows(df: DataFrame) -> DataFrame:
    """The same rows in as many tasks as a shuffle has, dealt one by one whatever their ids.

    The row groups of a few files make few tasks, and a row takes far longer to
    label than to move.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def label_votes(
    df: DataFrame,
    detectors: Sequence[Detector],
    text: str = "query",
    reducer: Reducer = sum_vectors,
    **views,
) -> DataFrame:
    """The input columns plus ``vote_0`` .. ``vote_7``.

    ``detectors`` are the default set, or any that adds to or replaces it, and
    ``reducer`` may replace the sum; both only compose expressions.
    """
    keep = df.columns
    flagged = detector_flags(df, detectors, text, **views)
    vectors = [d.vector({f: f"{d.name}_{f}" for f in d.weights}) for d in detectors]
    votes = [f"{round6(v)} as {name}" for v, name in zip(reducer(vectors), VOTES)]
    return computed_once(flagged.selectExpr(*keep, *votes), keep, VOTES)


def label_queries(
    df: DataFrame, detectors: Sequence[Detector], text: str = "query", top: int | None = None, **options
) -> DataFrame:
    """Ranked labels and votes of each text; ``top`` keeps the first few."""
    keep = df.columns
    ranked = rank_labels(VOTES)
    if top is not None:
        ranked = f"slice({ranked}, 1, {top})"
    rows = label_votes(df, detectors, text, **options).selectExpr(*keep, f"{ranked} as _ranked")
    votes = F.expr("transform(_ranked.rank, r -> 0D - r)").alias("votes")
    return computed_once(rows, keep, [F.col("_ranked.label").alias("labels"), votes])
