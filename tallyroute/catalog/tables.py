"""Queries over the request table: sources, cleaning, filters, lookups, statistics,
ordering, set operations, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as T, vocab
from ..functions.labels import map_labels, same_set
from ..operators import cleaning, filters, lookup, ordering as O, statistics as S, validation as K
from ..plans.evaluation import balanced_sample
from ..plans.labelling import detector_flags
from ..plans.table_job import run_table_job
from ..session import new_path
from ..sources import commits, sinks
from ..sources.gazetteer import count_locations, list_locations
from ..sources.tables import TableLayout, domain_table, label_table, read_requests, rename
from ..operators.detectors import default_detectors
from . import corpus as C, oracle as Q
from .registry import Inputs, add

SEED = 7


def _hash(df_id: str = "query_id"):
    return O.portable_hash(df_id, SEED)


HASH = f"(((query_id % 2147483648) * 2654435761 + {SEED}) % 4294967296)"


# --- sources ---------------------------------------------------------------------

def s1_load(c: Inputs) -> DataFrame:
    path = new_path(c.spark, "requests")
    c.corpus.write.parquet(path)
    return read_requests(c.spark, path)


add("s1_load_requests", s1_load, Q.sql("SELECT query_id, query, knowledge_domain, worker FROM corpus", "corpus"))


def s1_csv(c: Inputs) -> DataFrame:
    path = sinks.export(c.corpus, new_path(c.spark, "requests"), ("csv",))["csv"]
    return read_requests(c.spark, path, "csv").select("query_id", "query", "knowledge_domain", "worker")


add("s1_load_csv", s1_csv, Q.sql("SELECT query_id, query, knowledge_domain, worker FROM corpus", "corpus"))

LAYOUT = TableLayout("text", "area", "agents", ",")
add("s2_column_remap",
    lambda c: rename(c.corpus.selectExpr(
        "query_id", "query as text", "knowledge_domain as area", "worker as agents"), LAYOUT),
    Q.sql("SELECT query_id, query, knowledge_domain, worker FROM corpus", "corpus"))


def s3_checked(c: Inputs) -> DataFrame:
    """Tables of the data set, and which required columns each one lacks."""
    rows = []
    for name in ("events", "documents", "conversations"):
        df = c.table(name).withColumnRenamed("text", "query")
        try:
            rename(df)
            rows.append((name, ""))
        except ValueError as error:
            rows.append((name, str(error).split(";")[0]))
    found = c.spark.createDataFrame(rows, "table_name string, problem string")
    counts = None
    for name, _ in rows:
        n = c.table(name).agg(F.lit(name).alias("table_name"), F.count("*").alias("row_count"))
        counts = n if counts is None else counts.unionByName(n)
    return counts.join(F.broadcast(found), "table_name")


_MISSING = "missing columns: {}knowledge_domain, worker"
add("s3_required_columns", s3_checked,
    f"SELECT 'events' AS table_name, '{_MISSING.format('query, ')}' AS problem, count(*) AS row_count FROM events"
    f" UNION ALL SELECT 'documents', '{_MISSING.format('')}', count(*) FROM documents"
    f" UNION ALL SELECT 'conversations', '{_MISSING.format('')}', count(*) FROM conversations")

# the dimensions are fixed, so they are checked as lookup sides of the corpus
_LABEL_ROWS = ", ".join(f"({i}, '{x}')" for i, x in enumerate(vocab.LABELS))
_DOMAIN_ROWS = ", ".join(f"('{d}')" for d in vocab.DOMAINS)
add("s4_label_dimension",
    lambda c: label_table(c.spark).join(
        S.label_distribution(c.records), "label", "left"
    ).selectExpr("idx", "label", "coalesce(query_count, 0) as query_count"),
    Q.sql(f"SELECT idx, label, coalesce(n, 0) AS query_count FROM (VALUES {_LABEL_ROWS}) d(idx, label)"
          " LEFT JOIN (SELECT label, count(*) AS n FROM (SELECT unnest(workers_list) AS label"
          " FROM records) GROUP BY label) USING (label)", "records"))
add("s4_domain_dimension",
    lambda c: domain_table(c.spark).join(
        S.domain_distribution(c.records).withColumnRenamed("knowledge_domain", "domain"),
        "domain", "left").selectExpr("domain", "coalesce(query_count, 0) as query_count"),
    Q.sql(f"SELECT domain, coalesce(n, 0) AS query_count FROM (VALUES {_DOMAIN_ROWS}) d(domain)"
          " LEFT JOIN (SELECT knowledge_domain AS domain, count(*) AS n FROM records GROUP BY 1)"
          " USING (domain)", "records"))

add("s5_gazetteer", lambda c: c.gazetteer.withColumn("n_tokens", F.col("n_tokens").cast("bigint")),
    Q.sql("SELECT name, name_norm, len(string_split(name_norm, ' ')) AS n_tokens FROM names", "names"))
add("s6_locations_original", lambda c: list_locations(c.gazetteer),
    Q.sql("SELECT DISTINCT name AS location FROM names", "names"))
add("s6_locations_normalized", lambda c: list_locations(c.gazetteer, normalized=True),
    Q.sql("SELECT DISTINCT name_norm AS location FROM names", "names"))
add("s6_location_count", lambda c: count_locations(c.gazetteer),
    Q.sql("SELECT count(DISTINCT name_norm) AS location_count FROM names", "names"))


# --- sinks: what is written is read back -------------------------------------------

def _flat(df: DataFrame) -> DataFrame:
    return df.select("query_id", "query", "knowledge_domain", "workers")


def _read_back(c: Inputs, fmt: str, path: str) -> DataFrame:
    reader = c.spark.read.options(header=True, escape='"') if fmt == "csv" else c.spark.read
    return reader.format(fmt).load(path)


def s7_export(c: Inputs) -> DataFrame:
    done = sinks.export(_flat(c.records), new_path(c.spark, "export"), ("csv", "json", "parquet", "xml"))
    whole = None
    for fmt, path in done.items():
        if fmt.endswith("_error"):
            part = c.spark.range(1).select(
                F.lit(fmt).alias("format"), F.lit(0).cast("bigint").alias("records"),
                F.lit(0).cast("bigint").alias("id_sum"), F.lit(path).alias("note"))
        else:
            part = _read_back(c, fmt, path).agg(
                F.lit(fmt).alias("format"), F.count("*").alias("records"),
                F.sum(F.col("query_id").cast("bigint")).alias("id_sum"), F.lit("").alias("note"))
        whole = part if whole is None else whole.unionByName(part)
    return whole


add("s7_export_formats", s7_export, Q.sql(
    "SELECT format, count(*) AS records, CAST(sum(query_id) AS BIGINT) AS id_sum, '' AS note"
    " FROM records, (VALUES ('csv'), ('json'), ('parquet')) f(format) GROUP BY format"
    " UNION ALL SELECT 'xml_error', 0, 0, 'Unsupported format: xml'", "records"))


def s9_by_column(c: Inputs) -> DataFrame:
    done = sinks.export(_flat(c.records), new_path(c.spark, "export"), ("parquet",),
                        batch_column="knowledge_domain")
    return c.spark.read.parquet(done["parquet"]).groupBy("knowledge_domain").agg(
        F.count("*").alias("records"))


add("s9_export_by_column", s9_by_column, Q.sql(
    "SELECT knowledge_domain, count(*) AS records FROM records GROUP BY 1", "records"))


def s9_by_size(c: Inputs) -> DataFrame:
    path = new_path(c.spark, "export")
    sinks.export_batches(_flat(c.records), path, 250)
    return c.spark.read.parquet(path).groupBy(F.col("batch_id").cast("bigint").alias("batch_id")).agg(
        F.count("*").alias("records"), F.min("query_id").alias("first_id"))


add("s9_export_by_size", s9_by_size, Q.sql(
    "SELECT (n - 1) // 250 AS batch_id, count(*) AS records, min(query_id) AS first_id"
    " FROM (SELECT query_id, row_number() OVER (ORDER BY query_id) AS n FROM records) GROUP BY 1", "records"))


def s9_capped_files(c: Inputs) -> DataFrame:
    paths = sinks.export(_flat(c.records), new_path(c.spark, "export"), ("parquet",), batch_size=250)
    return sinks.manifest(c.spark, paths).agg(
        F.sum("records").alias("records"), (F.max("records") <= 250).alias("within_size"))


add("s9_export_capped_files", s9_capped_files, Q.sql(
    "SELECT count(*) AS records, true AS within_size FROM records", "records"))


def s10_manifest(c: Inputs) -> DataFrame:
    paths = sinks.export(_flat(c.records), new_path(c.spark, "export"), ("csv", "json"))
    return sinks.manifest(c.spark, paths).groupBy("format").agg(
        F.sum("records").alias("records"), (F.min("size_bytes") > 0).alias("has_size"))


add("s10_export_manifest", s10_manifest, Q.sql(
    "SELECT format, count(*) AS records, true AS has_size FROM records,"
    " (VALUES ('csv'), ('json')) f(format) GROUP BY format", "records"))


def s10_at_write(c: Inputs) -> DataFrame:
    counted: dict[str, int] = {}
    paths = sinks.export(_flat(c.records), new_path(c.spark, "export"), ("csv", "json", "parquet"), counted=counted)
    return sinks.manifest_at_write(c.spark, paths, counted).select(
        "format", "records", (F.col("size_bytes") > 0).alias("has_size"), (F.col("files") > 0).alias("has_files"))


add("s10_manifest_at_write", s10_at_write, Q.sql(
    "SELECT format, count(*) AS records, true AS has_size, true AS has_files FROM records,"
    " (VALUES ('csv'), ('json'), ('parquet')) f(format) GROUP BY format", "records"))
_NULL_IDS = "case when event_id % 13 = 5 then null else event_id end"


def s9_null_ids(c: Inputs) -> DataFrame:
    path = new_path(c.spark, "export")
    sinks.export_batches(c.events.select(F.expr(_NULL_IDS).alias("query_id"), "event_type"), path, 250)
    return c.spark.read.parquet(path).groupBy(F.col("batch_id").cast("bigint").alias("batch_id")).agg(
        F.count("*").alias("records"), F.count("query_id").alias("ids"), F.min("query_id").alias("first_id"))


add("s9_null_ids", s9_null_ids,
    "SELECT (n - 1) // 250 AS batch_id, count(*) AS records, count(query_id) AS ids, min(query_id) AS first_id"
    " FROM (SELECT query_id, row_number() OVER (ORDER BY query_id NULLS LAST) AS n FROM"
    f" (SELECT {_NULL_IDS} AS query_id FROM events)) GROUP BY 1")


def s11_commits(c: Inputs) -> DataFrame:
    """A batch that is written again replaces itself; the entries know its rows and content."""
    path = new_path(c.spark, "commits")
    rows = c.events.select("event_id", "event_type")
    for batch, part in (("even", rows.filter("event_id % 2 = 0")), ("odd", rows.filter("event_id % 7 = 0")),
                        ("odd", rows.filter("event_id % 2 = 1"))):
        commits.commit_batch(part, path, batch)
    sound = not commits.damaged_batches(c.spark, path, rows.schema).take(1)
    return commits.committed(c.spark, path, rows.schema).groupBy("event_type").agg(F.count("*").alias("records")).withColumns({
        "sound": F.lit(sound), "processed": F.lit(commits.totals(c.spark, path).first().processed)})


add("s11_committed_batches", s11_commits,
    "SELECT event_type, count(*) AS records, true AS sound, (SELECT count(*) FROM events) AS processed FROM events GROUP BY event_type")


def s11_append(c: Inputs) -> DataFrame:
    path = new_path(c.spark, "append")
    good, bad = filters.split_by_flag(c.typed.withColumn("sound", F.expr(f"not {cleaning.BROKEN}")), "sound")
    for part in (good, bad):
        sinks.append_batch(part.select("query_id", "sound"), path, "parquet")
    return c.spark.read.parquet(path).groupBy("sound").agg(F.count("*").alias("records"))


add("s11_append_batches", s11_append, Q.sql(
    f"SELECT NOT {Q._broken()} AS sound, count(*) AS records FROM typed GROUP BY 1", "typed"))


def s12_envelope(c: Inputs) -> DataFrame:
    folder = new_path(c.spark, "envelope")
    validated = K.validate(c.typed)
    sinks.write_envelope(_flat(c.records), folder, K.validation_summary(validated))
    meta = c.spark.read.schema("total bigint, valid bigint").json(f"{folder}/metadata")
    count = c.spark.read.json(f"{folder}/results").agg(F.count("*").alias("n")).scalar()
    return meta.withColumn("result_rows", count)


add("s12_result_envelope", s12_envelope, Q.sql(
    f"SELECT count(*) AS total, count(*) FILTER (NOT {Q._broken()}) AS valid,"
    f" count(*) FILTER (NOT {Q._broken()}) AS result_rows FROM typed", "typed"))


def s16_job(c: Inputs) -> DataFrame:
    job = run_table_job(c.dirty, new_path(c.spark, "job"), ("json",))
    exported = c.spark.read.json(job.exported["json"]).agg(F.count("*").alias("n")).scalar()
    rejected = job.rejected.agg(F.count("*").alias("n")).scalar()
    return job.analysis.withColumn("exported", exported).withColumn("rejected", rejected)


add("s16_table_job", s16_job, Q.sql(
    "SELECT count(*) AS row_count, round(avg(length(query)), 6) AS avg_query_length,"
    " CAST(sum(len(workers_list)) AS BIGINT) AS label_assignments, 5 AS column_count,"
    " count(DISTINCT knowledge_domain) AS domain_count,"
    " (SELECT count(DISTINCT x) FROM (SELECT unnest(workers_list) AS x FROM records)) AS label_count,"
    f" count(*) AS exported, (SELECT count(*) FROM typed WHERE {Q._broken()}) AS rejected FROM records",
    "records"))

# --- cleaning -------------------------------------------------------------------------

_RAW = "query_id, query, knowledge_domain, worker"
add("c1_drop_null_rows", lambda c: c.present, Q.sql(f"SELECT {_RAW} FROM present", "present"))
add("c2_fill_and_trim", lambda c: c.filled, Q.sql(f"SELECT {_RAW} FROM filled", "filled"))
add("c3_drop_blank_rows", lambda c: cleaning.drop_blank_rows(c.filled), Q.sql(f"SELECT {_RAW} FROM clean", "clean"))
add("c4_parse_labels",
    lambda c: c.typed.selectExpr("query_id", "array_join(workers_list, '|') as labels",
                                 "cast(size(workers_list) as bigint) as label_count"),
    Q.sql(f"SELECT query_id, {Q.joined('workers_list', '|')} AS labels, len(workers_list) AS label_count FROM typed", "typed"))
add("c5_strict_check", lambda c: cleaning.check_strict(c.requests).select("query_id", "query", "workers"),
    Q.sql("SELECT query_id, query, workers FROM requests", "requests"))
add("c6_quarantine_good", lambda c: c.records.select("query_id", "query", "knowledge_domain", "workers"),
    Q.sql("SELECT query_id, query, knowledge_domain, workers FROM records", "records"))
add("c6_quarantine_bad", lambda c: c.rejected.select("query_id", "reason"),
    Q.sql("SELECT query_id, CASE WHEN query = '' THEN 'query is empty' WHEN knowledge_domain = ''"
          " THEN 'knowledge domain is empty' ELSE 'label list is empty' END AS reason"
          f" FROM typed WHERE {Q._broken()}", "typed"))
add("c7_clean_table", lambda c: c.clean, Q.sql(f"SELECT {_RAW} FROM clean", "clean"))
add("c8_typed_table", lambda c: c.typed.selectExpr("query_id", "query", "knowledge_domain", "workers", "array_join(workers_list, '|') as workers_list"),
    Q.sql(f"SELECT query_id, query, knowledge_domain, workers, {Q.joined('workers_list', '|')} AS workers_list FROM typed", "typed"))
add("c9_original_order", lambda c: cleaning.in_order(c.records).select("query_id", "query"),
    Q.sql("SELECT query_id, query FROM records ORDER BY query_id", "records"))
add("c10_preview", lambda c: c.records.select("query_id", F.expr(T.preview("query", 20)).alias("preview")),
    Q.sql("SELECT query_id, CASE WHEN length(query) > 20 THEN substr(query, 1, 20) || '...' ELSE query END AS preview FROM records", "records"))

# --- filters --------------------------------------------------------------------------

_REC = "query_id, query, knowledge_domain, workers"


def _rec(df: DataFrame) -> DataFrame:
    return df.select("query_id", "query", "knowledge_domain", "workers")


add("f1_domain", lambda c: _rec(filters.by_domain(c.records, "NET_BI")),
    Q.sql(f"SELECT {_REC} FROM records WHERE knowledge_domain = 'NET_BI'", "records"))
add("f2_label", lambda c: _rec(filters.by_label(c.records, "DOC_SEARCH")),
    Q.sql(f"SELECT {_REC} FROM records WHERE list_contains(workers_list, 'DOC_SEARCH')", "records"))
add("f3_combined", lambda c: _rec(filters.combined(c.records, "MẠNG|dịch.*gì", "TRUYEN_DAN", "FUNCTION_CALLING")),
    Q.sql(f"SELECT {_REC} FROM records WHERE regexp_matches(query, '(?i)MẠNG|dịch.*gì')"
          " AND knowledge_domain = 'TRUYEN_DAN' AND list_contains(workers_list, 'FUNCTION_CALLING')", "records"))
add("f3_literal_text", lambda c: _rec(filters.by_text(c.records, "LÀ GÌ?", literal=True)),
    Q.sql(f"SELECT {_REC} FROM records WHERE contains(lower(query), 'là gì?')", "records"))
add("f4_joined_labels", lambda c: _rec(filters.by_joined_labels(c.records, "REMINDER, DOC_SEARCH")),
    Q.sql(f"SELECT {_REC} FROM records WHERE workers = 'REMINDER, DOC_SEARCH'", "records"))


def _with_errors(c: Inputs) -> DataFrame:
    return c.typed.withColumn("error", F.expr(cleaning.REASON))


_ERRORS = ("SELECT *, CASE WHEN query = '' THEN 'query is empty' WHEN knowledge_domain = ''"
           " THEN 'knowledge domain is empty' WHEN len(workers_list) = 0 THEN 'label list is empty' END AS error FROM typed")
add("f5_failed_rows", lambda c: filters.failed(_with_errors(c)).select("query_id", "error"),
    Q.sql(f"SELECT query_id, error FROM ({_ERRORS}) WHERE error IS NOT NULL", "typed"))
add("f5_successful_rows", lambda c: filters.succeeded(_with_errors(c)).select("query_id", "query"),
    Q.sql(f"SELECT query_id, query FROM ({_ERRORS}) WHERE error IS NULL", "typed"))


def _timed(c: Inputs) -> DataFrame:
    flags = detector_flags(c.corpus, default_detectors(C.ASSISTANT))
    return flags.withColumn("detected", F.expr("time_regex or time_keyword or time_indicator"))


_DETECTED = "SELECT *, (time_regex OR time_keyword OR time_indicator) AS detected FROM flags"
add("f6_detected", lambda c: filters.split_by_flag(_timed(c), "detected")[0].select("query_id", "query"),
    Q.sql(f"SELECT query_id, query FROM ({_DETECTED}) WHERE detected", "flags"))
add("f6_not_detected", lambda c: filters.split_by_flag(_timed(c), "detected")[1].select("query_id", "query"),
    Q.sql(f"SELECT query_id, query FROM ({_DETECTED}) WHERE NOT detected", "flags"))
add("f7_prefer_language",
    lambda c: filters.prefer_language(
        c.corpus.withColumn("lang", F.expr(T.language_of(T.collapse_space("lower(query)")))), "vi", 60, 40,
    ).select("query_id", "lang"),
    Q.sql("SELECT query_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang = 'vi' ORDER BY query_id) AS r"
          " FROM spoken) WHERE r <= CASE WHEN lang = 'vi' THEN 60 ELSE 40 END", "spoken"))

# --- lookups ---------------------------------------------------------------------------

add("j1_known_location", lambda c: lookup.known_locations(c.corpus, "query", c.gazetteer).select("query_id", "query"),
    Q.sql(f"SELECT query_id, query FROM corpus WHERE {Q.norm('query')} IN (SELECT name_norm FROM names)", "corpus", "names"))
_PLACES = Q.sql("SELECT query_id, place AS location, n_tokens, position FROM places", "places")


def _place_rows(df: DataFrame) -> DataFrame:
    return df.select("query_id", "location", F.col("n_tokens").cast("bigint").alias("n_tokens"),
                     F.col("position").cast("bigint").alias("position"))


add("j2_gazetteer_match", lambda c: _place_rows(lookup.location_matches(c.corpus, "query_id", "query", c.gazetteer)), _PLACES)
add("j2_gazetteer_match_joined",
    lambda c: _place_rows(lookup.location_matches(c.corpus, "query_id", "query", c.gazetteer, inline_limit=0, broadcast_rows=0)), _PLACES)
add("j3_map_labels", lambda c: c.records.selectExpr("query_id", f"array_join({map_labels('workers_list')}, ', ') as mapped"),
    Q.sql(f"SELECT query_id, {Q.joined(Q.mapped('workers_list'))} AS mapped FROM records", "records"))


def j3_table(c: Inputs) -> DataFrame:
    pairs = c.spark.createDataFrame(list(vocab.LABEL_GROUPS.items()), "label string, group string")
    return lookup.map_labels_by_table(c.records, "query_id", "workers_list", pairs).selectExpr(
        "query_id", "array_join(mapped, ', ') as mapped")


# an id for every seventh row, none for the first of them
_SHARED_IDS = "nullif(query_id div 7, 0)"
add("j3_repeated_ids_joined",
    lambda c: lookup.map_labels_by_table(
        c.records.withColumn("query_id", F.expr(_SHARED_IDS)), "query_id", "workers_list",
        c.spark.createDataFrame(list(vocab.LABEL_GROUPS.items()), "label string, group string"),
    ).selectExpr("query_id", "array_join(mapped, ', ') as mapped"),
    Q.sql(f"SELECT nullif(query_id // 7, 0) AS query_id, {Q.joined(Q.mapped('workers_list'))} AS mapped FROM records", "records"))
add("j3_map_labels_joined", j3_table,
    Q.sql(f"SELECT query_id, {Q.joined(Q.mapped('workers_list'))} AS mapped FROM records", "records"))
_STOPPED = Q.sql(
    "SELECT query_id, string_agg(tok, ' ' ORDER BY pos) AS kept FROM (SELECT query_id, lang, unnest(toks) AS tok,"
    f" generate_subscripts(toks, 1) AS pos FROM spoken) WHERE CASE {Q._STOP} ELSE true END GROUP BY query_id", "spoken")


def _spoken(c: Inputs) -> DataFrame:
    tidy = c.corpus.withColumn("tidy", F.expr(T.collapse_space("lower(query)")))
    return tidy.withColumns({"lang": F.expr(T.language_of("tidy")), "toks": F.expr(T.tokens("tidy"))})


add("j4_stop_words",
    lambda c: _spoken(c).selectExpr("query_id", f"array_join({T.remove_stop_words('toks', 'lang')}, ' ') as kept").filter("kept <> ''"),
    _STOPPED)


def j4_exploded(c: Inputs) -> DataFrame:
    rows = _spoken(c).select("query_id", F.col("lang").alias("language"), F.posexplode("toks").alias("pos", "token"))
    kept = lookup.remove_stop_words_exploded(rows, lookup.stop_word_table(c.spark))
    return kept.groupBy("query_id").agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("pos", "token"))).getField("token"), " ").alias("kept"))


add("j4_stop_words_joined", j4_exploded, _STOPPED)

# --- statistics ---------------------------------------------------------------------------

_LAB = "(SELECT *, unnest(workers_list) AS label FROM records)"
add("a1_by_domain", lambda c: S.by_domain(c.records),
    Q.sql("SELECT knowledge_domain, count(*) AS query_count, (SELECT count(DISTINCT label) FROM"
          f" {_LAB} x WHERE x.knowledge_domain = r.knowledge_domain) AS unique_workers_count"
          " FROM records r GROUP BY knowledge_domain", "records"))
add("a1_label_lists_by_domain", lambda c: S.label_lists_by_domain(c.records),
    Q.sql("SELECT knowledge_domain, workers, count(*) AS list_count FROM records GROUP BY ALL", "records"))
add("a2_by_label", lambda c: S.by_label(c.records),
    Q.sql(f"SELECT label, count(*) AS query_count, count(DISTINCT knowledge_domain) AS unique_domains_count FROM {_LAB} GROUP BY label", "records"))
add("a2_domains_by_label", lambda c: S.domains_by_label(c.records),
    Q.sql(f"SELECT label, knowledge_domain, count(*) AS domain_count FROM {_LAB} GROUP BY ALL", "records"))
add("a3_corpus_totals", lambda c: S.corpus_totals(c.records),
    Q.sql("SELECT count(*) AS total_queries, count(DISTINCT knowledge_domain) AS unique_knowledge_domains,"
          f" (SELECT count(DISTINCT label) FROM {_LAB}) AS unique_workers FROM records", "records"))
add("a4_domain_distribution", lambda c: S.domain_distribution(c.records),
    Q.sql("SELECT knowledge_domain, count(*) AS query_count FROM records GROUP BY 1", "records"))
add("a5_label_distribution", lambda c: S.label_distribution(c.records),
    Q.sql(f"SELECT label, count(*) AS query_count FROM {_LAB} GROUP BY 1", "records"))
add("a6_labels_per_query",
    lambda c: S.labels_per_query(c.records).selectExpr(
        "cast(min_workers as bigint) min_workers", "cast(max_workers as bigint) max_workers", "avg_workers", "median_workers"),
    Q.sql("SELECT min(len(workers_list)) AS min_workers, max(len(workers_list)) AS max_workers,"
          " round(avg(len(workers_list)), 6) AS avg_workers, median(len(workers_list)) AS median_workers FROM records", "records"))
add("a7_row_count", lambda c: S.row_count(c.records), Q.sql("SELECT count(*) AS row_count FROM records", "records"))
add("a8_chunk_profile", lambda c: S.chunk_profile(c.batches),
    Q.sql("SELECT batch_id, count(*) AS chunk_size, round(avg(length(query)), 6) AS avg_query_length,"
          " count(DISTINCT knowledge_domain) AS unique_domains, CAST(sum(len(workers_list)) AS BIGINT) AS total_assignments,"
          " len(list_distinct(flatten(list(workers_list)))) AS unique_workers FROM batches GROUP BY batch_id", "batches"))
add("a9_chunk_domains", lambda c: S.chunk_domains(c.batches),
    Q.sql("SELECT batch_id, knowledge_domain, count(*) AS query_count FROM batches GROUP BY ALL", "batches"))
add("a10_chunk_labels", lambda c: S.chunk_labels(c.batches),
    Q.sql("SELECT batch_id, label, count(*) AS query_count FROM (SELECT batch_id, unnest(workers_list) AS label FROM batches) GROUP BY ALL", "batches"))
add("a11_chunk_spread",
    lambda c: S.chunk_spread(c.batches).selectExpr(
        "batch_id", *[f"cast({m}_{n} as bigint) as {m}_{n}" for n in ("query_length", "assignments") for m in ("min", "max")],
        "avg_query_length", "avg_assignments"),
    Q.sql("SELECT batch_id, min(length(query)) AS min_query_length, max(length(query)) AS max_query_length,"
          " round(avg(length(query)), 6) AS avg_query_length, min(len(workers_list)) AS min_assignments,"
          " max(len(workers_list)) AS max_assignments, round(avg(len(workers_list)), 6) AS avg_assignments"
          " FROM batches GROUP BY batch_id", "batches"))
add("a12_table_analysis", lambda c: S.table_analysis(c.records),
    Q.sql("SELECT count(*) AS row_count, round(avg(length(query)), 6) AS avg_query_length,"
          " CAST(sum(len(workers_list)) AS BIGINT) AS label_assignments, 5 AS column_count,"
          f" count(DISTINCT knowledge_domain) AS domain_count, (SELECT count(DISTINCT label) FROM {_LAB}) AS label_count FROM records", "records"))
add("a13_run_counters", lambda c: S.run_counters(_with_errors(c)),
    Q.sql("SELECT count(*) AS total_items, count(*) FILTER (error IS NULL) AS processed_items,"
          " count(*) FILTER (error IS NOT NULL) AS failed_items,"
          f" round(count(*) FILTER (error IS NULL) / count(*), 6) AS success_rate FROM ({_ERRORS})", "typed"))
add("a14_group_summary",
    lambda c: S.group_summary(
        K.validate(c.typed).filter("workers in ('FUNCTION_CALLING', 'DOC_SEARCH')")
        .withColumns({"success": F.col("is_valid"), "size": F.length("query")}), "workers", "size"),
    Q.sql("WITH g AS (SELECT workers AS \"group\", count(*) AS total_queries, count(*) FILTER (query <> '' AND knowledge_domain <> '') AS successful_analyses,"
          " count(*) FILTER (query = '' OR knowledge_domain = '') AS failed_analyses, avg(length(query)) AS mean FROM typed"
          " WHERE workers IN ('FUNCTION_CALLING', 'DOC_SEARCH') GROUP BY workers)"
          " SELECT \"group\", total_queries, successful_analyses, failed_analyses, round(mean, 6) AS mean FROM g UNION ALL"
          " SELECT 'overall', CAST(sum(total_queries) AS BIGINT), CAST(sum(successful_analyses) AS BIGINT),"
          " CAST(sum(failed_analyses) AS BIGINT), round(avg(mean), 6) FROM g", "typed").replace("\nWITH g", ",\ng", 1))
add("a15_detection_rates", lambda c: S.detection_rates(_timed(c)),
    Q.sql("SELECT coalesce(knowledge_domain, '*') AS knowledge_domain, count(*) AS total,"
          " count(*) FILTER (detected) AS detected, round(count(*) FILTER (detected) / count(*), 6) AS detection_rate"
          f" FROM ({_DETECTED}) JOIN (SELECT query_id, knowledge_domain FROM corpus) USING (query_id)"
          " GROUP BY ROLLUP (knowledge_domain)", "flags", "corpus"))


def _confidence(c: Inputs) -> DataFrame:
    from ..plans.labelling import label_votes
    return label_votes(c.corpus, default_detectors(C.ASSISTANT)).withColumn("confidence", F.col("vote_5"))


add("a16_confidence_bands", lambda c: S.confidence_bands(_confidence(c)),
    Q.sql("SELECT count(*) AS total_queries, round(avg(vote_5), 6) AS avg_confidence,"
          " count(*) FILTER (vote_5 > 0.8::DOUBLE) AS high_confidence_count, count(*) FILTER (vote_5 < 0.2::DOUBLE) AS low_confidence_count,"
          " count(*) FILTER (vote_5 > 0.5::DOUBLE) AS detected_count FROM votes", "votes"))

# --- ordering ---------------------------------------------------------------------------

add("w1_first_rows", lambda c: _rec(O.first_rows(c.records, 100)),
    Q.sql(f"SELECT {_REC} FROM records ORDER BY query_id LIMIT 100", "records"))
add("w2_top_counts", lambda c: O.top_counts(c.records, "query", 10),
    Q.sql("SELECT query, count(*) AS \"count\" FROM records GROUP BY query ORDER BY 2 DESC, 1 LIMIT 10", "records"))
add("w3_batch_ids", lambda c: O.with_batch_ids(c.records.select("query_id"), 100),
    Q.sql("SELECT query_id, CAST(batch_id AS BIGINT) AS batch_id FROM batches", "batches"))
# ids that are null, that two or three rows share, and text; rows are numbered to the last
_ODD_IDS = "case when event_id % 11 = 3 then null when event_id % 7 < 2 then event_id div 50 else event_id + 4611686018427387904 end"
add("w3_null_and_repeated_ids",
    lambda c: O.with_positions(c.events.select(F.expr(_ODD_IDS).alias("id")), "id"),
    "SELECT id, row_number() OVER (ORDER BY id NULLS LAST) - 1 AS position FROM"
    f" (SELECT {_ODD_IDS.replace(' div ', ' // ')} AS id FROM events)")
add("w3_text_keys",
    lambda c: O.with_positions(c.events.select("event_type", "event_id"), ["event_type", "event_id"]),
    "SELECT event_type, event_id, row_number() OVER (ORDER BY event_type NULLS LAST, event_id) - 1 AS position FROM events")
add("w3_batch_ids_dense", lambda c: O.with_batch_ids(c.corpus, 100, dense=True).select("query_id", "batch_id"),
    Q.sql("SELECT query_id, query_id // 100 AS batch_id FROM corpus", "corpus"))
add("w5_sample", lambda c: _rec(O.sample_rows(c.records, 100, order=_hash())),
    Q.sql(f"SELECT {_REC} FROM records ORDER BY {HASH}, query_id LIMIT 100", "records"))
# half of the rows: the n-th key is found by counting, not by a sort
add("w5_large_sample",
    lambda c: O.sample_rows(c.corpus, 15000, order=_hash()).select("query_id"),
    Q.sql(f"SELECT query_id FROM corpus ORDER BY {HASH}, query_id LIMIT 15000", "corpus"))
add("w6_sample_label", lambda c: _rec(O.sample_rows(filters.by_joined_labels(c.records, "DOC_SEARCH"), 50, order=_hash())),
    Q.sql(f"SELECT {_REC} FROM records WHERE workers = 'DOC_SEARCH' ORDER BY {HASH}, query_id LIMIT 50", "records"))
QUOTAS = {"DOC_SEARCH": 400, "FUNCTION_CALLING": 300, "REMINDER": 100000}
add("w7_balanced_sample",
    lambda c: balanced_sample(c.records, QUOTAS, order=_hash()).select("query_id", "category", "sample_order"),
    Q.sql(f"SELECT query_id, category, {HASH} AS sample_order FROM (SELECT *, {Q.category('m')} AS category FROM"
          f" (SELECT *, {Q.mapped('workers_list')} AS m FROM records)) WHERE category <> 'OTHER'"
          f" QUALIFY row_number() OVER (PARTITION BY category ORDER BY {HASH}, query_id) <="
          " CASE category WHEN 'DOC_SEARCH' THEN 400 WHEN 'FUNCTION_CALLING' THEN 300 ELSE 100000 END", "records"))
add("w8_first_per_class", lambda c: O.first_per_group(c.records, "workers", [F.col("query_id")], 5).select("workers", "query_id"),
    Q.sql("SELECT workers, query_id FROM records QUALIFY row_number() OVER (PARTITION BY workers ORDER BY query_id) <= 5", "records"))
_CRITICAL = "case when query_id % 701 = 700 then 'Critical failure' when query_id % 50 = 3 then 'timeout' end"
add("w9_until_critical",
    lambda c: O.until_critical(c.records.withColumn("error", F.expr(_CRITICAL))).select("query_id", "error"),
    Q.sql(f"SELECT query_id, error FROM (SELECT *, {_CRITICAL} AS error FROM records) WHERE query_id <= coalesce("
          f"(SELECT min(query_id) FROM (SELECT *, {_CRITICAL} AS error FROM records) WHERE lower(error) LIKE '%critical%'), 9223372036854775807)", "records"))

# --- set operations ---------------------------------------------------------------------------

add("x1_concatenate",
    lambda c: _rec(filters.by_domain(c.records, "BRCD")).unionByName(_rec(filters.by_label(c.records, "MEETING"))),
    Q.sql(f"SELECT {_REC} FROM records WHERE knowledge_domain = 'BRCD' UNION ALL"
          f" SELECT {_REC} FROM records WHERE list_contains(workers_list, 'MEETING')", "records"))
add("x2_label_sets",
    lambda c: c.records.withColumn("m", F.expr(map_labels("workers_list"))).selectExpr(
        "query_id", "array_join(sort_array(array_union(workers_list, m)), '|') as either",
        "array_join(sort_array(array_except(workers_list, m)), '|') as only_raw", f"{same_set('workers_list', 'm')} as same"),
    Q.sql("SELECT query_id, array_to_string(list_sort(list_distinct(list_concat(workers_list, m))), '|') AS either,"
          " coalesce(array_to_string(list_sort(list_distinct(list_filter(workers_list, lambda x: NOT list_contains(m, x)))), '|'), '') AS only_raw,"
          " list_sort(list_distinct(workers_list)) = list_sort(list_distinct(m)) AS same"
          f" FROM (SELECT *, {Q.mapped('workers_list')} AS m FROM records)", "records"))

# --- validation ---------------------------------------------------------------------------

_E = ("list_filter([CASE WHEN query = '' THEN 'Empty query' END, CASE WHEN knowledge_domain = '' THEN 'Empty knowledge domain' END,"
      " CASE WHEN len(workers_list) = 0 THEN 'No workers assigned' END], lambda x: x IS NOT NULL)")
_PLAIN = Q.text(r"^[\p{L}\p{N}]+$")
_LONG = ("CASE WHEN length(query) > 10000 THEN 'Very long query text' END, CASE WHEN len(workers_list) > 10 THEN 'Many workers assigned' END")
_ODD = f"CASE WHEN NOT regexp_matches(translate(knowledge_domain, '_-', ''), {_PLAIN}) THEN 'Domain contains special characters' END"
_W = (f"list_concat(list_filter([{_LONG}, {_ODD}], lambda x: x IS NOT NULL), list_transform(list_filter(workers_list,"
      f" lambda w: NOT regexp_matches(translate(w, '_-', ''), {_PLAIN})), lambda w: 'Worker name contains special characters: ' || w))")
add("k1_errors", lambda c: K.validate(c.typed).selectExpr("query_id", "is_valid", "array_join(errors, '|') as errors"),
    Q.sql(f"SELECT query_id, len(e) = 0 AS is_valid, {Q.joined('e', '|')} AS errors FROM (SELECT *, {_E} AS e FROM typed)", "typed"))


def _long_rows(c: Inputs) -> DataFrame:
    docs = c.documents.selectExpr("doc_id as query_id", "text as query", "source as knowledge_domain",
                                  "filter(split(text, ' '), x -> x <> '') as workers_list")
    return K.validate(docs, name_checks=False)


add("k2_size_warnings", lambda c: _long_rows(c).selectExpr("query_id", "array_join(warnings, '|') as warnings"),
    "SELECT doc_id AS query_id, coalesce(array_to_string(list_filter([CASE WHEN length(text) > 10000 THEN 'Very long query text' END,"
    " CASE WHEN len(list_filter(string_split(text, ' '), lambda x: x <> '')) > 10 THEN 'Many workers assigned' END],"
    " lambda x: x IS NOT NULL), '|'), '') AS warnings FROM documents")
add("k3_domain_characters",
    lambda c: K.validate(c.typed).selectExpr("query_id", f"array_contains(warnings, '{vocab.DOMAIN_CHARACTERS}') as odd_domain"),
    Q.sql(f"SELECT query_id, {_ODD} IS NOT NULL AS odd_domain FROM typed", "typed"))
add("k4_label_characters", lambda c: K.validate(c.typed).selectExpr("query_id", "array_join(warnings, '|') as warnings"),
    Q.sql(f"SELECT query_id, {Q.joined('w', '|')} AS warnings FROM (SELECT *, {_W} AS w FROM typed)", "typed"))
_V = f"(SELECT *, {_E} AS e, {_W} AS w FROM typed)"
add("k5_validation_summary", lambda c: K.validation_summary(K.validate(c.typed)),
    Q.sql("SELECT count(*) AS total, count(*) FILTER (len(e) = 0) AS valid, count(*) FILTER (len(e) > 0) AS invalid,"
          f" CAST(sum(len(w)) AS BIGINT) AS warning_count, round(count(*) FILTER (len(e) = 0) / count(*), 6) AS valid_rate FROM {_V}", "typed"))
add("k5_message_counts", lambda c: K.message_counts(K.validate(c.typed)),
    Q.sql(f"SELECT message, count(*) AS message_count FROM (SELECT unnest(list_concat(e, w)) AS message FROM {_V}) GROUP BY 1", "typed"))
