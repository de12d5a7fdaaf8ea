"""Predictions from response records, and the end-to-end evaluation job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T, vocab
from ..functions.labels import category_of, map_labels, top_from_vector
from ..operators import evaluation as E
from ..operators.lookup import pair_predictions
from ..operators.ordering import stratified_sample
from .labelling import label_queries

_LIST_KEYS = ("workers", "predicted_workers", "result")


def predictions_from_responses(df: DataFrame, response: str = "response") -> DataFrame:
    """``predicted``, ``scores`` and ``error`` of response records in any accepted shape (V8).

    In order of precedence: ``labels`` with ``votes``; the first of ``workers`` /
    ``predicted_workers`` / ``result`` that is a list or one text;
    ``prediction_vector`` / ``output_vector``. Labels are cut to two and
    consolidated. A response with ``success: false`` predicts nothing and keeps
    its ``error``. Each record is parsed once.
    """
    def field(name: str, ddl: str) -> str:
        return f"try_variant_get(_record, '$.{name}', '{ddl}')"

    def listed(name: str) -> str:
        kind = f"schema_of_variant({field(name, 'variant')})"
        return (
            f"case when {kind} like 'ARRAY%' then filter({field(name, 'array<variant>')},"
            " x -> schema_of_variant(x) = 'STRING') when"
            f" {kind} = 'STRING' then array({field(name, 'variant')}) end"
        )

    def labels(variants: str) -> str:
        return f"transform(slice({variants}, 1, 2), x -> cast(x as string))"

    vector = f"coalesce({field('prediction_vector', 'array<double>')}, {field('output_vector', 'array<double>')})"
    top = T.empty("array<struct<label:string,vote:double>>")
    df = df.withColumn("_record", F.expr(f"try_parse_json({response})")).withColumns({
        "_labels": F.expr(listed("labels")),
        "_votes": F.expr(field("votes", "array<double>")),
        "_listed": F.expr(f"coalesce({', '.join(listed(k) for k in _LIST_KEYS)})"),
        "_top": F.expr(f"coalesce({top_from_vector(vector)}, {top})"),
        "_failed": F.expr(f"coalesce(not {field('success', 'boolean')}, false)"),
    })
    raw = (
        f"case when _failed then {T.empty()} when size(_labels) > 0 then {labels('_labels')}"
        f" when _listed is not null then {labels('_listed')} else _top.label end"
    )
    none = T.empty("array<double>")
    scores = (
        f"case when _failed then {none} when size(_labels) > 0 then coalesce(slice(_votes, 1, 2), {none})"
        f" when _listed is not null then {none} else _top.vote end"
    )
    error = f"case when _failed then coalesce({field('error', 'string')}, 'failed response') end"
    return (
        df.withColumn("_raw", F.expr(raw))
        .withColumns({"predicted": F.expr(map_labels("_raw")), "scores": F.expr(scores), "error": F.expr(error)})
        .drop("_record", "_labels", "_votes", "_listed", "_top", "_failed", "_raw")
    )


def predictions_from_labelling(df: DataFrame, detectors, top: int = 2, **options) -> DataFrame:
    """Labelling as predictions: the first two ranked labels, consolidated."""
    ranked = label_queries(df, detectors, top=top, **options)
    return ranked.select(
        "query_id", F.expr(map_labels("labels")).alias("predicted"), F.col("votes").alias("scores")
    )


def balanced_sample(
    typed: DataFrame, quotas: dict[str, int] | None = None, seed: int = 42,
    order: Column | None = None,
) -> DataFrame:
    """Quota sample over the evaluation categories (W7), with its ``category`` and ``sample_order``.

    Thresholds are found on ids, categories and hashes; the chosen rows then pass by a
    filter where they are, so rows that share an id or have none count one by one.
    """
    category = category_of(map_labels("workers_list"))
    return stratified_sample(
        typed.withColumn("category", F.expr(category)), "category",
        vocab.SAMPLE_QUOTAS if quotas is None else quotas, seed, order=order,
    )


def evaluate(typed: DataFrame, detectors, **options) -> DataFrame:
    """Label a typed table and compare with its expected labels: matches per row.

    Prediction is a projection over the same rows, so expected and predicted
    labels meet without a join.
    """
    ranked = label_queries(typed, detectors, top=2, **options)
    paired = ranked.select(
        "query_id", "query", "knowledge_domain",
        F.col("workers_list").alias("expected"),
        F.expr(map_labels("labels")).alias("predicted"),
        F.col("votes").alias("scores"),
        F.lit(None).cast("string").alias("error"),
        F.lit(True).alias("success"),
    )
    return E.with_matches(paired)


def evaluation_job(matches: DataFrame) -> dict[str, DataFrame]:
    """Everything an evaluation ends in: accuracy, categories, label scores, averages, report."""
    scores = E.label_scores(E.label_counts(matches))
    return {
        "accuracy": E.accuracy(matches),
        "categories": E.accuracy_by_category(matches),
        "labels": E.rounded_scores(scores),
        "average": E.macro_average(scores),
        "report": E.evaluation_report(matches),
    }


def evaluate_predictions(typed: DataFrame, predicted: DataFrame) -> DataFrame:
    """Compare a typed table with predictions made elsewhere."""
    expected = typed.select(
        "query_id", "query", "knowledge_domain", F.col("workers_list").alias("expected")
    )
    return E.with_matches(pair_predictions(expected, predicted))
