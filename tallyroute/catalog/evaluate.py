"""Queries for evaluation, streaming and user functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.text import matches
from ..operators import evaluation as E, ordering as O, userfn as U, validation as K
from ..operators.cleaning import typed_table
from ..operators.detectors import Detector, default_detectors
from ..operators.lookup import clashing_predictions, pair_predictions
from ..plans.evaluation import (
    balanced_sample, evaluate, evaluate_predictions, evaluation_job, predictions_from_responses,
)
from ..plans.analysis import analyze
from ..plans.labelling import VOTES, label_queries, label_votes, spread_rows
from ..session import new_path
from ..sources.commits import committed
from ..streaming.requests import (
    progress_totals, read_stream, run_batches, run_stream, skip_failed, write_batch,
)
from . import corpus as C, oracle as Q
from .registry import Inputs, add
from .tables import HASH, QUOTAS, _hash

DETECTORS = default_detectors(C.ASSISTANT)

_RESPONSE = (
    "case query_id % 4 when 0 then to_json(named_struct('labels', labels, 'votes', votes))"
    " when 1 then to_json(named_struct('workers', slice(labels, 1, 3)))"
    " when 2 then to_json(named_struct('result', labels[0]))"
    f" else to_json(named_struct('output_vector', array({', '.join(VOTES)}))) end"
)


def responses(c: Inputs) -> DataFrame:
    """Response records in every accepted shape; every fiftieth one is missing."""
    votes = label_votes(spread_rows(c.corpus), DETECTORS, gazetteer=c.gazetteer)
    from ..functions.vectors import rank_labels
    ranked = votes.withColumn("r", F.expr(rank_labels(VOTES)))
    return ranked.selectExpr(
        "query_id", "r.label as labels", "transform(r.rank, x -> 0D - x) as votes", *VOTES
    ).filter("query_id % 50 <> 0").selectExpr("query_id", f"{_RESPONSE} as response")


def predictions(c: Inputs) -> DataFrame:
    return predictions_from_responses(responses(c)).select("query_id", "predicted", "scores")


def matches_of(c: Inputs) -> DataFrame:
    return evaluate_predictions(c.requests, predictions(c))


def counts_of(c: Inputs) -> DataFrame:
    return E.label_counts(matches_of(c))


_LISTS = "array_join(predicted, '|') as predicted", "array_join(transform(scores, s -> format_string('%.6f', s)), '|') as scores"
_LISTS_SQL = (f"{Q.joined('predicted', '|')} AS predicted,"
              f" {Q.joined('''list_transform(scores, lambda s: printf('%.6f', s))''', '|')} AS scores")
add("v8_parse_responses", lambda c: predictions(c).selectExpr("query_id", *_LISTS),
    Q.sql(f"SELECT query_id, {_LISTS_SQL} FROM predictions", "predictions"))


# failed responses predict nothing; only texts and lists of texts are labels
_STATUS = (
    "case query_id % 4 when 0 then '{\"success\": false, \"error\": \"busy\", \"labels\": [\"REMINDER_AGENT\"]}'"
    " when 1 then '{\"workers\": 5, \"result\": \"REMINDER_AGENT\"}'"
    " when 2 then '{\"success\": true, \"workers\": [\"MEETING_AGENT\", 5, \"[odd]\"]}'"
    " else concat('{\"success\": true, \"predicted_workers\": [\"', worker, '\"]}') end"
)
add("v8_response_status", lambda c: predictions_from_responses(c.corpus.selectExpr("query_id", f"{_STATUS} as response")).selectExpr(
    "query_id", "array_join(predicted, '|') as predicted", "coalesce(error, '') as error"),
    Q.sql("SELECT query_id, CASE query_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'REMINDER' WHEN 2 THEN 'MEETING_AGENT|[odd]'"
          f" ELSE {Q.mapped('[worker]')}[1] END AS predicted, CASE WHEN query_id % 4 = 0 THEN 'busy' ELSE '' END AS error FROM corpus", "corpus"))


def _paired(c: Inputs) -> DataFrame:
    expected = c.requests.select("query_id", "query", "knowledge_domain", F.col("workers_list").alias("expected"))
    return pair_predictions(expected, predictions(c))


add("j5_pair_predictions", lambda c: _paired(c).selectExpr("query_id", "array_join(expected, '|') as expected", *_LISTS),
    Q.sql(f"SELECT query_id, {Q.joined('expected', '|')} AS expected, {_LISTS_SQL} FROM pairs", "pairs"))


def _attempts(c: Inputs) -> DataFrame:
    """Predictions with attempts before the last, repeated rows, and answers that name no request."""
    last = predictions(c).withColumn("attempt", F.lit(2))
    wrong = F.array(F.lit("MEETING_AGENT"))
    first = last.filter("query_id % 5 = 0").withColumns({"predicted": wrong, "attempt": F.lit(1)})
    lost = last.filter("query_id % 50 = 0").withColumns({"predicted": wrong, "query_id": F.lit(None).cast("bigint")})
    return last.unionByName(first).unionByName(last.filter("query_id % 3 = 0")).unionByName(lost)


def j5_repeated(c: Inputs) -> DataFrame:
    expected = c.requests.select("query_id", "query", "knowledge_domain", F.col("workers_list").alias("expected"))
    return pair_predictions(expected, _attempts(c), latest=["attempt"]).selectExpr("query_id", "array_join(expected, '|') as expected", *_LISTS)


def j5_clashing(c: Inputs) -> DataFrame:
    """Without the attempt's number, other answers of an id clash; repeated equal ones do not."""
    return clashing_predictions(_attempts(c).drop("attempt")).filter("query_id is not null").select("query_id", "n_answers", "reason")


add("j5_repeated_predictions", j5_repeated,
    Q.sql(f"SELECT query_id, {Q.joined('expected', '|')} AS expected, {_LISTS_SQL} FROM pairs", "pairs"))
add("j5_clashing_predictions", j5_clashing,
    Q.sql("SELECT query_id, 2 + CASE WHEN query_id % 3 = 0 THEN 1 ELSE 0 END AS n_answers, 'different answers' AS reason FROM predictions"
          " WHERE query_id % 5 = 0 AND predicted <> ['MEETING_AGENT']", "predictions"))
add("j6_missing_predictions", lambda c: _paired(c).filter("not success").selectExpr("query_id", "error", "success", "size(predicted) as n"),
    Q.sql("SELECT query_id, error, success, 0 AS n FROM pairs WHERE NOT success", "pairs"))
add("e1_category", lambda c: matches_of(c).select("query_id", "category"),
    Q.sql("SELECT query_id, category FROM matches", "matches"))
add("e2_match_flags", lambda c: matches_of(c).select("query_id", "exact_match", "partial_match"),
    Q.sql("SELECT query_id, exact_match, partial_match FROM matches", "matches"))
_RATE = "round(count(*) FILTER (success AND {0}) / count(*) FILTER (success), 6)"
_ACC = ("count(*) AS total_queries, count(*) FILTER (success) AS successful_requests,"
        " round(count(*) FILTER (success) / count(*), 6) AS success_rate,"
        f" {_RATE.format('exact_match')} AS exact_match_accuracy, {_RATE.format('partial_match')} AS partial_match_accuracy")
add("e3_accuracy", lambda c: E.accuracy(matches_of(c)), Q.sql(f"SELECT {_ACC} FROM matches", "matches"))
add("e4_accuracy_by_category", lambda c: E.accuracy_by_category(matches_of(c)),
    Q.sql("SELECT category, count(*) AS total, round(count(*) FILTER (exact_match) / count(*), 6) AS exact_accuracy,"
          " round(count(*) FILTER (partial_match) / count(*), 6) AS partial_accuracy FROM matches WHERE success GROUP BY category", "matches"))
add("e5_label_counts", counts_of,
    Q.sql("SELECT label, true_positive, false_positive, false_negative FROM label_counts", "label_counts"))
_PRF = "label, " + ", ".join(f"round({x}, 6) AS {x}" for x in ("precision", "recall", "f1"))
add("e6_label_prf", lambda c: E.rounded_scores(E.label_scores(counts_of(c))),
    Q.sql(f"SELECT {_PRF} FROM label_scores", "label_scores"))
add("e7_macro_average", lambda c: E.macro_average(E.label_scores(counts_of(c))),
    Q.sql("SELECT " + ", ".join(f"round(avg({x}), 6) AS average_{x}" for x in ("precision", "recall", "f1")) + " FROM label_scores", "label_scores"))
_SAME = "list_sort(list_distinct(expected_mapped)) = list_sort(list_distinct(predicted))"
add("e8_exact_set_accuracy", lambda c: E.exact_set_accuracy(matches_of(c)),
    Q.sql(f"SELECT count(*) AS total_predictions, count(*) FILTER ({_SAME}) AS correct_predictions,"
          f" round(count(*) FILTER ({_SAME}) / count(*), 6) AS exact_match_accuracy FROM matches WHERE success", "matches"))
add("e9_hit_rates", lambda c: E.hit_rates(matches_of(c)),
    Q.sql("SELECT label, count(*) AS total, count(*) FILTER (h) AS correct, round(count(*) FILTER (h) / count(*), 6) AS hit_rate FROM ("
          "SELECT label, list_contains(predicted, label) AS h FROM (SELECT predicted, unnest(list_distinct(expected_mapped)) AS label FROM matches WHERE success)) GROUP BY label", "matches"))
_RUN = ("count(*) AS total_queries, count(*) FILTER (success) AS successful_tests, count(*) FILTER (NOT success) AS failed_tests,"
        " round(count(*) FILTER (success) / count(*), 6) AS success_rate")
add("e10_run_statistics", lambda c: E.run_statistics(_paired(c)), Q.sql(f"SELECT {_RUN} FROM pairs", "pairs"))
add("e11_batch_statistics",
    lambda c: E.run_statistics(O.with_batch_ids(_paired(c), 100, dense=True), "batch_id"),
    Q.sql(f"SELECT query_id // 100 AS batch_id, {_RUN} FROM pairs GROUP BY 1", "pairs"))


def e12_job(c: Inputs) -> dict[str, DataFrame]:
    """Sample, label, consolidate, compare; every output of the job."""
    sample = balanced_sample(c.requests, QUOTAS, order=_hash())
    return evaluation_job(evaluate(sample, DETECTORS, gazetteer=c.gazetteer))


_E12 = (
    "SELECT s.query_id, s.m AS e, {p} AS p FROM (SELECT query_id, m, {cat} AS category FROM"
    " (SELECT query_id, {map} AS m FROM requests) WHERE {cat} <> 'OTHER' QUALIFY row_number() OVER (PARTITION BY {cat} ORDER BY {hash}, query_id)"
    " <= CASE {cat} WHEN 'DOC_SEARCH' THEN 400 WHEN 'FUNCTION_CALLING' THEN 300 ELSE 100000 END) s JOIN ranked USING (query_id)"
).format(p=Q.mapped("list_slice(labels, 1, 2)"), cat=Q.category("m"), map=Q.mapped("workers_list"), hash=HASH)
add("e12_evaluation_job", lambda c: e12_job(c)["labels"], Q.sql(
    f"SELECT {_PRF} FROM (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM ("
    "SELECT label, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall FROM ("
    "SELECT label, count(*) FILTER (list_contains(e, label) AND list_contains(p, label)) AS tp,"
    " count(*) FILTER (NOT list_contains(e, label)) AS fp, count(*) FILTER (NOT list_contains(p, label)) AS fn FROM ("
    f"SELECT e, p, unnest(list_distinct(list_concat(e, p))) AS label FROM ({_E12})) GROUP BY label)))", "requests", "ranked"))
_E12_HIT = "CASE WHEN p[1] = e[1] THEN 1 ELSE 0 END"
add("e12_job_accuracy", lambda c: e12_job(c)["accuracy"], Q.sql(
    f"SELECT count(*) AS total_queries, count(*) AS successful_requests, 1::DOUBLE AS success_rate, round(avg({_E12_HIT}), 6) AS exact_match_accuracy,"
    f" round(avg(CASE WHEN list_contains(p, e[1]) THEN 1 ELSE 0 END), 6) AS partial_match_accuracy FROM ({_E12})", "requests", "ranked"))
add("e12_job_categories", lambda c: e12_job(c)["categories"], Q.sql(
    f"SELECT {Q.category('e')} AS category, count(*) AS total, round(avg({_E12_HIT}), 6) AS exact_accuracy,"
    f" round(avg(CASE WHEN list_contains(p, e[1]) THEN 1 ELSE 0 END), 6) AS partial_accuracy FROM ({_E12}) GROUP BY 1", "requests", "ranked"))
add("e13_best_labels", lambda c: E.best_labels(E.label_scores(counts_of(c))),
    Q.sql(f"SELECT {_PRF} FROM label_scores ORDER BY round(f1, 6) DESC, label LIMIT 5", "label_scores"))
add("s15_evaluation_report",
    lambda c: E.evaluation_report(O.with_batch_ids(matches_of(c), 100, dense=True)),
    Q.sql("SELECT query_id + 1 AS query_index, query, knowledge_domain, array_to_string(expected, '; ') AS expected_workers_raw,"
          f" array_to_string(expected_mapped, '; ') AS expected_workers_mapped, {Q.joined('predicted', '; ')} AS predicted_workers,"
          f" {Q.joined('''list_transform(scores, lambda s: printf('%.6f', s))''', '; ')} AS predicted_workers_scores,"
          " exact_match, partial_match, category AS query_category, success AS api_success, coalesce(error, '') AS api_error,"
          " CAST(query_id // 100 AS VARCHAR) AS batch_id FROM matches", "matches"))

# --- streaming: the same functions over a file stream, read back ------------------------------


def _stream(c: Inputs) -> DataFrame:
    schema = c.table("events").schema
    return C.request_corpus(read_stream(c.spark, f"{c.sf_dir}/events.parquet*", schema))


def r1_labelled(c: Inputs) -> DataFrame:
    out, state = new_path(c.spark, "stream"), new_path(c.spark, "state")
    broken = "case when query like 'xyz%' then 'unreadable request' end"
    run_stream(_stream(c), lambda s: skip_failed(
        label_queries(s, DETECTORS, gazetteer=c.gazetteer, top=2).withColumn("error", F.expr(broken))
    ).selectExpr("query_id", "array_join(labels, '|') as labels"), out, state)
    return c.spark.read.parquet(out)


add("r1_stream_labels", r1_labelled, Q.sql(
    "SELECT query_id, array_to_string(list_slice(labels, 1, 2), '|') AS labels FROM ranked WHERE query NOT LIKE 'xyz%'", "ranked"))


def r1_labelled_joined(c: Inputs) -> DataFrame:
    """The same labels with the gazetteer joined, batch by batch."""
    out, state = new_path(c.spark, "stream"), new_path(c.spark, "state")
    run_batches(_stream(c), lambda s: label_queries(
        s, DETECTORS, gazetteer=c.gazetteer, inline_limit=0, top=2
    ).selectExpr("query_id", "array_join(labels, '|') as labels"), out, state)
    return committed(c.spark, out, "query_id bigint, labels string")


add("r1_stream_labels_joined", r1_labelled_joined, Q.sql(
    "SELECT query_id, array_to_string(list_slice(labels, 1, 2), '|') AS labels FROM ranked", "ranked"))


def r2_persisted(c: Inputs) -> DataFrame:
    """A batch that is delivered twice is persisted once, and a second run adds nothing."""
    out, state = new_path(c.spark, "stream"), new_path(c.spark, "state")

    def checked(s: DataFrame) -> DataFrame:
        return K.validate(typed_table(s)).selectExpr("query_id", "is_valid", "size(warnings) as n_warnings", "size(workers_list) as n_labels")

    for _ in range(2):
        run_batches(_stream(c), checked, out, state)
    write_batch(c.corpus, 0, checked, out)
    return committed(c.spark, out, "query_id bigint, is_valid boolean, n_warnings int, n_labels int")


add("r2_stream_persist", r2_persisted, Q.sql(
    "SELECT query_id, true AS is_valid, 0 AS n_warnings, CAST(len(workers_list) AS INTEGER) AS n_labels FROM requests", "requests"))


def r3_progress(c: Inputs) -> DataFrame:
    out, state = new_path(c.spark, "stream"), new_path(c.spark, "state")
    run_batches(_stream(c), lambda s: s.selectExpr(
        "query_id", "case when query like 'xyz%' then 'bad' end as error"), out, state, failed="error is not null")
    return progress_totals(c.spark, out)


add("r3_stream_progress", r3_progress, Q.sql(
    "SELECT CAST(count(*) AS BIGINT) AS processed, count(*) FILTER (query NOT LIKE 'xyz%') AS successful, count(*) FILTER (query LIKE 'xyz%') AS failed FROM corpus", "corpus"))

# --- user functions -------------------------------------------------------------------------


def _shout(row: dict) -> dict:
    if not row["knowledge_domain"].isidentifier():
        raise ValueError(f"odd domain {row['knowledge_domain']}")
    return {"query_id": row["query_id"], "loud": row["query"].upper()}


add("u1_apply_rows", lambda c: U.apply_rows(c.records, _shout, "query_id bigint, loud string"),
    Q.sql("SELECT query_id, CASE WHEN regexp_matches(knowledge_domain, '^[A-Z_]+$') THEN upper(query) END AS loud,"
          " CASE WHEN NOT regexp_matches(knowledge_domain, '^[A-Z_]+$') THEN 'odd domain ' || knowledge_domain END AS error FROM records", "records"))


# ids past 2^53 and null ids come back as they went in
_LARGE = "case when event_id % 5 = 0 then null else 9007199254740993 + event_id end"
add("u1_large_ids", lambda c: U.apply_rows(
    c.events.selectExpr("event_id", f"{_LARGE} as big", "event_type"),
    lambda row: {"event_id": row["event_id"], "big": row["big"], "kind": row["event_type"].upper()},
    "event_id bigint, big bigint, kind string"),
    f"SELECT event_id, {_LARGE} AS big, upper(event_type) AS kind, CAST(NULL AS VARCHAR) AS error FROM events")


def _chunk(part: pd.DataFrame) -> pd.DataFrame:
    lengths = part["query"].str.len()
    return pd.DataFrame({"batch_id": [part["batch_id"].iloc[0]], "n": [len(part)], "chars": [int(lengths.sum())]})


add("u2_apply_chunks", lambda c: U.apply_chunks(c.batches, _chunk, "batch_id bigint, n bigint, chars bigint"),
    Q.sql("SELECT batch_id, count(*) AS n, CAST(sum(length(query)) AS BIGINT) AS chars FROM batches GROUP BY batch_id", "batches"))


def _group(part: pd.DataFrame) -> pd.DataFrame:
    lengths = part["query"].str.len()
    return pd.DataFrame({"knowledge_domain": [part["knowledge_domain"].iloc[0]], "n": [len(part)],
                         "longest": [int(lengths.max())]})


def _grouped(c: Inputs, rows: int) -> DataFrame:
    return U.apply_groups(
        c.records.select("query", "knowledge_domain"), "knowledge_domain", _group,
        "knowledge_domain string, n bigint, longest bigint",
        [F.sum("n").alias("n"), F.max("longest").alias("longest")], rows=rows)


_GROUPED = Q.sql("SELECT knowledge_domain, count(*) AS n, max(length(query)) AS longest FROM records GROUP BY 1", "records")
add("u3_apply_groups", lambda c: _grouped(c, 10_000), _GROUPED)
add("w4_group_batches", lambda c: _grouped(c, 500), _GROUPED)


def _sums(part: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"knowledge_domain": [part["knowledge_domain"].iloc[0]], "n": [len(part)],
                         "total": [int(part["query"].str.len().sum())]})


add("u3_group_means", lambda c: U.apply_groups(
    c.records.select("query", "knowledge_domain"), "knowledge_domain", _sums,
    "knowledge_domain string, n bigint, total bigint", [F.round(F.sum("total") / F.sum("n"), 6).alias("mean_length")]),
    Q.sql("SELECT knowledge_domain, round(avg(length(query)), 6) AS mean_length FROM records GROUP BY 1", "records"))


_MOSTLY_ONE = "if(event_id % 2 = 0, 'all', concat('u', user_id % 40))"


def _values(part: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"g": [part["g"].iloc[0]], "n": [len(part)], "total": [int(part["cents"].sum())],
                         "batch": [len(part)]})


def _joined(parts: pd.DataFrame) -> pd.DataFrame:
    return parts.groupby("g", dropna=False, as_index=False).agg({"n": "sum", "total": "sum", "batch": "max"})


# one group holds half of all rows; no call of the function sees more than 250 of them
add("u3_hot_group",
    lambda c: U.apply_groups(
        c.events.select(F.expr(_MOSTLY_ONE).alias("g"), F.expr("cast(round(value * 100) as bigint)").alias("cents")), "g", _values,
        "g string, n bigint, total bigint, batch bigint",
        [F.sum("n").alias("n"), F.sum("total").alias("total"), (F.max("batch") <= 250).alias("bounded")],
        rows=250, combine=_joined, held=200),
    f"SELECT g, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total, true AS bounded FROM"
    f" (SELECT value, CASE WHEN event_id % 2 = 0 THEN 'all' ELSE concat('u', user_id % 40) END AS g FROM events) GROUP BY g")


def _make_annotator():
    def annotate(text: str) -> dict:
        parts = text.split()
        if parts[:1] == ["xyz"]:
            raise ValueError("unreadable request")
        return {"tokens": parts, "pos_tags": [{"token": t, "tag": "NUM" if t.isdigit() else "UNK"} for t in parts]}

    return annotate


add("u4_annotator",
    lambda c: U.annotate(c.corpus.select("query_id", "query"), _make_annotator).selectExpr(
        "query_id", "coalesce(array_join(pos_tags.tag, ' '), '') as tags", "coalesce(error, '') as error"),
    Q.sql("SELECT query_id, CASE WHEN query LIKE 'xyz%' THEN '' ELSE array_to_string(list_transform(k, lambda t:"
          " CASE WHEN regexp_matches(t, '^[0-9]+$') THEN 'NUM' ELSE 'UNK' END), ' ') END AS tags,"
          " CASE WHEN query LIKE 'xyz%' THEN 'unreadable request' ELSE '' END AS error"
          f" FROM (SELECT query_id, query, {Q.tokens('query')} AS k FROM corpus)", "corpus"))
add("u4_annotator_default",
    lambda c: U.annotate(c.corpus.select("query_id", "query")).selectExpr("query_id", "array_join(pos_tags.tag, ' ') as tags", "sentiment.neu as neu"),
    Q.sql(f"SELECT query_id, array_to_string(list_transform({Q.tokens('query')}, lambda t: 'UNK'), ' ') AS tags, 1::DOUBLE AS neu FROM corpus", "corpus"))


def _make_scorer():
    """Numbers are entities, and a text with an opening slash is felt as positive."""
    def annotate(text: str) -> dict:
        found = [{"text": t, "label": "NUM", "start": 0, "end": len(t)} for t in text.split() if t.isdigit()]
        compound = 0.5 if text.startswith("/") else -0.25 if text.startswith("xyz") else 0.0
        return {"entities": found, "sentiment": {"compound": compound, "pos": 0.0, "neu": 1.0, "neg": 0.0}}

    return annotate


add("t22_annotated_analysis",
    lambda c: analyze(U.annotate(c.records.select("query_id", "query"), _make_scorer), entities="entities", sentiment="sentiment").selectExpr(
        "query_id", "size(entities) as n_entities", "sentiment_score", "word_count"),
    Q.sql("SELECT query_id, CAST(len(list_filter(k, lambda t: regexp_matches(t, '^[0-9]+$'))) AS INTEGER) AS n_entities,"
          " CASE WHEN query LIKE '/%' THEN 0.5::DOUBLE WHEN query LIKE 'xyz%' THEN -0.25::DOUBLE ELSE 0::DOUBLE END AS sentiment_score,"
          f" CAST(len(k) AS INTEGER) AS word_count FROM (SELECT query_id, query, {Q.tokens('query')} AS k FROM records)", "records"))


def u5_custom(c: Inputs) -> DataFrame:
    web = Detector("web", lambda v: {"url": matches(v.lower, "ip$|adsl")}, {"url": {4: 1.0}})
    return label_votes(c.corpus, detectors=[*DETECTORS, web], gazetteer=c.gazetteer).select("query_id", "vote_4")


add("u5_custom_detector", u5_custom, Q.sql(
    "SELECT query_id, " + Q.six("CASE WHEN location_location THEN 0.2::DOUBLE ELSE 0::DOUBLE END + CASE WHEN regexp_matches(lower(query), 'ip$|adsl')"
                                " THEN 1::DOUBLE ELSE 0::DOUBLE END") + " AS vote_4 FROM flags", "flags"))


def _strongest(vectors) -> list[str]:
    def slot(i: int) -> str:
        parts = [v[i] for v in vectors if i in v]
        return f"greatest(0D, {', '.join(parts)})" if parts else "0D"

    return [slot(i) for i in range(8)]


def _most(i: int) -> str:
    parts = [s[i] for s in Q.SLOTS.values() if i in s]
    return Q.six(f"list_max([0::DOUBLE, {', '.join(parts)}])")


add("u6_custom_reducer",
    lambda c: label_votes(c.corpus, DETECTORS, reducer=_strongest, gazetteer=c.gazetteer).select("query_id", *VOTES),
    Q.sql("SELECT query_id, " + ", ".join(f"{_most(i)} AS vote_{i}" for i in range(8)) + " FROM flags", "flags"))
