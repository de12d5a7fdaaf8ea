"""The registered queries of the operators, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import alignment, exact_dedup, language_model, line_dedup, mixing, packing, pii, quality, sharding, simhash, spelling, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pii_spans(_table(spark, sf_dir, "documents"))
    spans = F.col("spans")
    return found.select(
        "doc_id", *(pii.count_of(spans, kind).alias(f"n_{kind}") for kind in pii.BASE_KINDS),
        F.sha2(pii.span_list(spans, base_only=True), 256).alias("base_sha256"), pii.span_list(spans).alias("spans"),
        F.size(spans).cast("long").alias("n_spans"),
    )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(_table(spark, sf_dir, "documents"), digest_all=True)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    records = warc.read_warc(*warc.write_warc(pages))
    kind = pages.schema["page_id"].dataType.simpleString()
    return records.select(
        warc.id_of(F.col("page_id"), kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        warc.id_of(F.col("refers_to"), kind).alias("refers_to"),
    )


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *quality.COUNTS, "base_failed", "kept")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicate_groups(_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("mark"), 16, "0")).alias("fingerprint"), "component_id")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.with_toxicity(docs.select("doc_id", "text"), model, name="score")
    return scored.select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(_table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op11_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.language_model_scores(_table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_tokenizers(_table(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_pii, op2_exact_dedup, op3_warc, op4_quality, op5_simhash, op6_toxicity, op7_sharding, op8_line_dedup,
        op9_packing, op10_mixing, op11_language_model,
        op12_alignment, op13_spelling,
    )
}

ORACLES = {
    "op2_exact_dedup": """
        WITH t AS (
            SELECT doc_id, length(coalesce(text, '')) AS chars,
                sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256
            FROM documents
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
        FROM (
            SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id,
                count(*) OVER (PARTITION BY text_sha256) AS group_size
            FROM t
        )
    """,
    # edits are found by the same variants, but over whole strings and all lines
    "op8_line_dedup": """
        WITH raw AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw,
                generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS number
            FROM documents
        ), lines AS (
            SELECT doc_id, number, w, array_to_string(w, ' ') AS line, doc_id * 1000000 + number AS place FROM (
                SELECT doc_id, number, list_filter(string_split_regex(raw, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM raw
            ) WHERE len(w) > 0
        ), one AS (SELECT line, any_value(w) AS w, min(place) AS first FROM lines GROUP BY line),
        variants AS (
            SELECT line, first, p, array_to_string(list_concat(w[1:p - 1], w[p + 1:]), ' ') AS v
            FROM (SELECT *, unnest(range(1, len(w) + 1)) AS p FROM one WHERE len(w) >= 5)
        ), near AS (
            SELECT line, min(earlier) AS earlier FROM (
                SELECT line, first, min(first) OVER (PARTITION BY v, p) AS earlier FROM variants
                UNION ALL
                SELECT one.line, one.first, variants.first FROM variants JOIN one ON one.line = v WHERE len(one.w) >= 5
                UNION ALL
                SELECT variants.line, variants.first, one.first FROM variants JOIN one ON one.line = v WHERE len(one.w) >= 5
            ) WHERE earlier < first GROUP BY line
        ), judged AS (
            SELECT doc_id, number, place > first AS equal, place = first AND earlier IS NOT NULL AS near
            FROM lines JOIN one USING (line) LEFT JOIN near USING (line)
        )
        SELECT documents.doc_id, count(number) AS n_lines, count(*) FILTER (equal) AS n_equal, count(*) FILTER (near) AS n_near,
            coalesce(string_agg(CASE WHEN equal OR near THEN CAST(number AS VARCHAR) END, ',' ORDER BY number), '') AS dropped
        FROM documents LEFT JOIN judged USING (doc_id) GROUP BY documents.doc_id
    """,
}
