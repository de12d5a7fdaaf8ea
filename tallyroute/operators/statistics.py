"""Aggregations over the request table and over analysed text.

Everything is partial + final aggregation; label statistics explode the label
array first, so counts combine map-side and no list is ever gathered per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F



def _one_per_label(df: DataFrame) -> DataFrame:
    return df.withColumn("label", F.explode("workers_list"))


def rounded(column: Column) -> Column:
    return F.round(column, 6)


def by_domain(df: DataFrame) -> DataFrame:
    """Requests and distinct labels per domain (A1), in one scan.

    Each request counts at its first label, so exploding does not inflate it.
    """
    rows = df.select(
        "knowledge_domain", F.posexplode_outer("workers_list").alias("pos", "label")
    )
    return rows.groupBy("knowledge_domain").agg(
        F.count_if(F.coalesce("pos", F.lit(0)) == 0).alias("query_count"),
        F.countDistinct("label").alias("unique_workers_count"),
    )


def label_lists_by_domain(df: DataFrame) -> DataFrame:
    """The label lists of each domain with their multiplicity, one row per list."""
    return df.groupBy("knowledge_domain", "workers").agg(F.count("*").alias("list_count"))


def by_label(df: DataFrame) -> DataFrame:
    """Requests and distinct domains per label (A2)."""
    pairs = _one_per_label(df).groupBy("label", "knowledge_domain").agg(F.count("*").alias("n"))
    return pairs.groupBy("label").agg(
        F.sum("n").alias("query_count"), F.count("*").alias("unique_domains_count")
    )


def domains_by_label(df: DataFrame) -> DataFrame:
    """The domains of each label with their multiplicity, one row per domain."""
    return _one_per_label(df).groupBy("label", "knowledge_domain").agg(
        F.count("*").alias("domain_count")
    )


def _values(df: DataFrame) -> DataFrame:
    """One row per distinct domain and per distinct label, with the sums of its rows.

    One scan and one shuffle: every row stands for its domain and for each of its
    labels at once.
    """
    kind = "struct<kind:string,value:string,rows:bigint,characters:bigint,assignments:bigint>"
    own = (
        "named_struct('kind', 'domain', 'value', knowledge_domain, 'rows', 1L,"
        " 'characters', cast(length(query) as bigint), 'assignments', cast(size(workers_list) as bigint))"
    )
    labels = (
        "transform(array_distinct(workers_list), x ->"
        f" cast(named_struct('kind', 'label', 'value', x, 'rows', 0L, 'characters', 0L, 'assignments', 0L) as {kind}))"
    )
    rows = df.select(F.inline(F.expr(f"concat(array({own}), coalesce({labels}, cast(array() as array<{kind}>)))")))
    sums = [F.sum(n).alias(n) for n in ("rows", "characters", "assignments")]
    return rows.groupBy("kind", "value").agg(*sums)


def _count_of(kind: str) -> Column:
    return F.count_if(F.col("kind") == kind)


def corpus_totals(df: DataFrame) -> DataFrame:
    return _values(df).agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("total_queries"),
        _count_of("domain").alias("unique_knowledge_domains"), _count_of("label").alias("unique_workers"),
    )


def domain_distribution(df: DataFrame) -> DataFrame:
    return df.groupBy("knowledge_domain").agg(F.count("*").alias("query_count"))


def label_distribution(df: DataFrame) -> DataFrame:
    return _one_per_label(df).groupBy("label").agg(F.count("*").alias("query_count"))


def labels_per_query(df: DataFrame) -> DataFrame:
    size = F.size("workers_list")
    return df.agg(
        F.min(size).alias("min_workers"), F.max(size).alias("max_workers"),
        rounded(F.avg(size)).alias("avg_workers"), F.median(size).alias("median_workers"),
    )


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("row_count"))


# --- per chunk ---------------------------------------------------------------------

def chunk_profile(df: DataFrame) -> DataFrame:
    """Size, mean length, distinct domains and labels, assignments per ``batch_id``.

    A chunk has a fixed size, so the sets gathered per chunk are bounded and one
    aggregation does it all.
    """
    def distinct(values: Column) -> Column:
        return F.size(values).cast("bigint")

    return df.groupBy("batch_id").agg(
        F.count("*").alias("chunk_size"),
        rounded(F.avg(F.length("query"))).alias("avg_query_length"),
        distinct(F.collect_set("knowledge_domain")).alias("unique_domains"),
        F.sum(F.size("workers_list")).alias("total_assignments"),
        distinct(F.array_distinct(F.flatten(F.collect_set("workers_list")))).alias("unique_workers"),
    )


def chunk_domains(df: DataFrame) -> DataFrame:
    return df.groupBy("batch_id", "knowledge_domain").agg(F.count("*").alias("query_count"))


def chunk_labels(df: DataFrame) -> DataFrame:
    return _one_per_label(df).groupBy("batch_id", "label").agg(F.count("*").alias("query_count"))


def chunk_spread(df: DataFrame) -> DataFrame:
    """Shortest, longest and mean request and label count per chunk."""
    def spread(name: str, column: Column) -> list[Column]:
        return [
            F.min(column).alias(f"min_{name}"), F.max(column).alias(f"max_{name}"),
            rounded(F.avg(column)).alias(f"avg_{name}"),
        ]

    return df.groupBy("batch_id").agg(
        *spread("query_length", F.length("query")), *spread("assignments", F.size("workers_list"))
    )


def table_analysis(df: DataFrame) -> DataFrame:
    """One row about the whole table (A12), in one scan."""
    rows = F.coalesce(F.sum("rows"), F.lit(0))
    return _values(df).agg(
        rows.alias("row_count"),
        rounded(F.try_divide(F.sum("characters"), F.sum("rows"))).alias("avg_query_length"),
        F.coalesce(F.sum("assignments"), F.lit(0)).alias("label_assignments"),
        F.lit(len(df.columns)).alias("column_count"),
        _count_of("domain").alias("domain_count"), _count_of("label").alias("label_count"),
    )


# --- runs, detection, groups ---------------------------------------------------------

def run_counters(df: DataFrame) -> DataFrame:
    """Totals of a run over rows with a nullable ``error``."""
    return df.agg(
        F.count("*").alias("total_items"),
        F.count_if(F.col("error").isNull()).alias("processed_items"),
        F.count_if(F.col("error").isNotNull()).alias("failed_items"),
        rounded(F.try_divide(F.count_if(F.col("error").isNull()), F.count("*"))).alias("success_rate"),
    )


def group_summary(df: DataFrame, group: str, value: str) -> DataFrame:
    """Counters per group plus an overall row whose mean is the mean of means."""
    groups = df.groupBy(F.col(group).alias("group")).agg(
        F.count("*").alias("total_queries"),
        F.count_if(F.col("success")).alias("successful_analyses"),
        F.count_if(~F.col("success")).alias("failed_analyses"),
        F.avg(value).alias("mean"),
    )
    overall = groups.agg(
        F.lit("overall").alias("group"), F.sum("total_queries").alias("total_queries"),
        F.sum("successful_analyses").alias("successful_analyses"),
        F.sum("failed_analyses").alias("failed_analyses"), F.avg("mean").alias("mean"),
    )
    return groups.unionByName(overall).withColumn("mean", rounded(F.col("mean")))


def detection_rates(df: DataFrame, flag: str = "detected") -> DataFrame:
    """Detection rate per domain and over all (``domain`` is ``*``)."""
    hit = F.col(flag).cast("int")
    parts = df.groupBy("knowledge_domain").agg(
        F.count("*").alias("total"), F.sum(hit).alias("detected")
    )
    overall = parts.agg(
        F.lit("*").alias("knowledge_domain"), F.sum("total").alias("total"),
        F.sum("detected").alias("detected"),
    )
    return parts.unionByName(overall).withColumn(
        "detection_rate", rounded(F.coalesce(F.try_divide("detected", "total"), F.lit(0.0)))
    )


def confidence_bands(df: DataFrame, score: str = "confidence") -> DataFrame:
    value = F.col(score)
    return df.agg(
        F.count("*").alias("total_queries"), rounded(F.avg(value)).alias("avg_confidence"),
        F.count_if(value > 0.8).alias("high_confidence_count"),
        F.count_if(value < 0.2).alias("low_confidence_count"),
        F.count_if(value > 0.5).alias("detected_count"),
    )


# --- analysed text -----------------------------------------------------------------------

def language_tally(df: DataFrame) -> DataFrame:
    """Counts per gated language; ``with_indicator`` counts Vietnamese ones that
    also contain an indicator word."""
    return df.groupBy("lang").agg(
        F.count("*").alias("row_count"),
        F.count_if((F.col("lang") == "vi") & F.col("has_indicator")).alias("with_indicator"),
    )


def token_statistics(df: DataFrame, column: str = "token_count") -> DataFrame:
    """Rows with tokens, their share, and the mean over them."""
    count = F.col(column)
    return df.agg(
        F.count("*").alias("total"), F.count_if(count > 0).alias("successful"),
        rounded(F.try_divide(F.count_if(count > 0), F.count("*"))).alias("success_rate"),
        rounded(F.avg(F.when(count > 0, count))).alias("avg_tokens"),
    )


def element_distribution(df: DataFrame, element: str, name: str) -> DataFrame:
    """Counts per value of an exploded array field (tags, entity labels)."""
    return df.select(F.explode(element).alias(name)).groupBy(name).agg(
        F.count("*").alias("element_count")
    )


def sentiment_distribution(df: DataFrame) -> DataFrame:
    return df.groupBy("sentiment_class").agg(F.count("*").alias("row_count"))


def text_means(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("total"),
        rounded(F.avg("word_count")).alias("avg_words"),
        rounded(F.avg("sentiment_score")).alias("avg_sentiment"),
        rounded(F.avg(F.size("keywords"))).alias("avg_keywords"),
        rounded(F.avg(F.size("topics"))).alias("avg_topics"),
    )


def composite_success(df: DataFrame, checks: list[str], threshold: float = 80.0) -> DataFrame:
    """Share of passed checks over all check columns, in percent, and the verdict."""
    passed = sum((F.col(c).cast("int") for c in checks[1:]), F.col(checks[0]).cast("int"))
    rate = F.coalesce(
        F.try_divide(F.sum(passed) * 100.0, F.count("*") * F.lit(len(checks))), F.lit(0.0)
    )
    return df.agg(
        (F.count("*") * F.lit(len(checks))).alias("tests"), F.sum(passed).alias("passed"),
        rounded(rate).alias("success_rate"), (rate >= threshold).alias("suite_passed"),
    )
