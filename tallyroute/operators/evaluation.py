"""Label-quality evaluation.

Input rows pair expected and predicted label lists (see ``pair_predictions``):
``expected`` raw labels, ``predicted`` consolidated labels, ``success``. Every
comparison is made in consolidated labels: ``with_matches`` adds the consolidated
expectation as ``expected_mapped``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.labels import category_of, map_labels, same_set
from .statistics import rounded


def ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def with_matches(df: DataFrame) -> DataFrame:
    """Consolidated expectation, category, exact (top-1) and partial (top-2) flags."""
    truth = "get(expected_mapped, 0)"
    return (
        df.withColumn("expected_mapped", F.expr(map_labels("expected")))
        .withColumns({
            "category": F.expr(category_of("expected_mapped")),
            "exact_match": F.expr(f"coalesce(get(predicted, 0) = {truth}, false)"),
            "partial_match": F.expr(
                f"coalesce(array_contains(slice(predicted, 1, 2), {truth}), false)"
            ),
        })
    )


def accuracy(matches: DataFrame) -> DataFrame:
    """Success rate over all rows; accuracies over successful rows only."""
    done = F.count_if(F.col("success"))

    def share(flag: str) -> Column:
        return rounded(ratio(F.count_if(F.col("success") & F.col(flag)), done))

    return matches.agg(
        F.count("*").alias("total_queries"), done.alias("successful_requests"),
        rounded(ratio(done, F.count("*"))).alias("success_rate"),
        share("exact_match").alias("exact_match_accuracy"),
        share("partial_match").alias("partial_match_accuracy"),
    )


def accuracy_by_category(matches: DataFrame) -> DataFrame:
    def share(flag: str) -> Column:
        return rounded(ratio(F.count_if(F.col(flag)), F.count("*")))

    return matches.filter("success").groupBy("category").agg(
        F.count("*").alias("total"),
        share("exact_match").alias("exact_accuracy"),
        share("partial_match").alias("partial_accuracy"),
    )


def label_counts(matches: DataFrame) -> DataFrame:
    """True positives, false positives and false negatives per label."""
    seen = F.explode(F.array_union("expected_mapped", "predicted"))
    rows = matches.filter("success").select("expected_mapped", "predicted", seen.alias("label"))
    wanted = F.expr("array_contains(expected_mapped, label)")
    given = F.expr("array_contains(predicted, label)")
    return rows.groupBy("label").agg(
        F.count_if(wanted & given).alias("true_positive"),
        F.count_if(~wanted & given).alias("false_positive"),
        F.count_if(wanted & ~given).alias("false_negative"),
    )


def label_scores(counts: DataFrame) -> DataFrame:
    tp, fp, fn = (F.col(c) for c in ("true_positive", "false_positive", "false_negative"))
    return (
        counts.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn)})
        .withColumn("f1", ratio(
            2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")
        ))
    )


def rounded_scores(scores: DataFrame) -> DataFrame:
    return scores.select(
        "label", *[rounded(F.col(c)).alias(c) for c in ("precision", "recall", "f1")]
    )


def macro_average(scores: DataFrame) -> DataFrame:
    return scores.agg(*[
        rounded(F.coalesce(F.avg(c), F.lit(0.0))).alias(f"average_{c}")
        for c in ("precision", "recall", "f1")
    ])


def best_labels(scores: DataFrame, k: int = 5) -> DataFrame:
    return rounded_scores(scores).orderBy(F.desc("f1"), "label").limit(k)


def exact_set_accuracy(matches: DataFrame) -> DataFrame:
    hit = F.expr(same_set("expected_mapped", "predicted"))
    return matches.filter("success").agg(
        F.count("*").alias("total_predictions"), F.count_if(hit).alias("correct_predictions"),
        rounded(ratio(F.count_if(hit), F.count("*"))).alias("exact_match_accuracy"),
    )


def hit_rates(matches: DataFrame) -> DataFrame:
    """Share of rows expecting a label that also predict it."""
    rows = matches.filter("success").select(
        "predicted", F.explode(F.array_distinct("expected_mapped")).alias("label")
    )
    hit = F.expr("array_contains(predicted, label)")
    return rows.groupBy("label").agg(
        F.count("*").alias("total"), F.count_if(hit).alias("correct"),
        rounded(ratio(F.count_if(hit), F.count("*"))).alias("hit_rate"),
    )


def run_statistics(df: DataFrame, *keys: str) -> DataFrame:
    """Totals of a scoring run, over all rows or per key (such as the batch)."""
    done = F.count_if(F.col("success"))
    return df.groupBy(*keys).agg(
        F.count("*").alias("total_queries"), done.alias("successful_tests"),
        (F.count("*") - done).alias("failed_tests"),
        rounded(ratio(done, F.count("*"))).alias("success_rate"),
    )


def evaluation_report(matches: DataFrame) -> DataFrame:
    """One flat row per query for a text report."""
    return matches.selectExpr(
        "query_id + 1 as query_index", "query", "knowledge_domain",
        "array_join(expected, '; ') as expected_workers_raw",
        "array_join(expected_mapped, '; ') as expected_workers_mapped",
        "array_join(predicted, '; ') as predicted_workers",
        "array_join(transform(scores, s -> format_string('%.6f', s)), '; ')"
        " as predicted_workers_scores",
        "exact_match", "partial_match", "category as query_category",
        "success as api_success", "coalesce(error, '') as api_error",
        "coalesce(cast(batch_id as string), 'N/A') as batch_id"
        if "batch_id" in matches.columns else "'N/A' as batch_id",
    )
