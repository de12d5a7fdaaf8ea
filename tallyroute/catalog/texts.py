"""Queries over text: normalising, tokens, keywords, language, annotations, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import patterns as P, text as T, vocab
from ..operators import entities as N, statistics as S
from ..operators.keywords import document_keywords
from ..operators.userfn import apply_rows
from ..plans.analysis import analysis_table, analyze, process, sentence_report
from ..sources import sinks
from . import oracle as Q
from .registry import ORACLES, Inputs, add
from .tables import HASH, _hash


def _docs(c: Inputs) -> DataFrame:
    return c.documents


def _expr(df: DataFrame, *expressions: str) -> DataFrame:
    return df.selectExpr(*expressions)


add("t1_normalize", lambda c: _expr(_docs(c), "doc_id", f"{T.normalize('text')} as norm"),
    f"SELECT doc_id, {Q.norm('text')} AS norm FROM documents")
add("t1_normalize_requests", lambda c: _expr(c.corpus, "query_id", f"{T.normalize('query')} as norm"),
    Q.sql(f"SELECT query_id, {Q.norm('query')} AS norm FROM corpus", "corpus"))
add("t2_collapse_space", lambda c: _expr(_docs(c), "doc_id", f"{T.collapse_space('text')} as tidy"),
    f"SELECT doc_id, {Q.tidy('text')} AS tidy FROM documents")
add("t3_truncate",
    lambda c: _expr(_docs(c), "doc_id", f"length({T.clip(T.collapse_space('text'))}) as kept_length",
                    f"md5({T.clip(T.collapse_space('text'))}) as kept_md5"),
    f"SELECT doc_id, CAST(length(substr({Q.tidy('text')}, 1, 10000)) AS INTEGER) AS kept_length,"
    f" md5(substr({Q.tidy('text')}, 1, 10000)) AS kept_md5 FROM documents")
add("t4_tokens",
    lambda c: _expr(_docs(c), "doc_id", f"size({T.tokens('text')}) as n_tokens", f"array_join({T.tokens('text')}, ' ') as tokens"),
    f"SELECT doc_id, CAST(len(k) AS INTEGER) AS n_tokens, {Q.joined('k', ' ')} AS tokens FROM (SELECT doc_id, {Q.tokens('text')} AS k FROM documents)")
add("t5_words",
    lambda c: _expr(_docs(c), "doc_id", f"array_join({T.words('text')}, ' ') as words"),
    f"SELECT doc_id, {Q.joined(Q.words('text'), ' ')} AS words FROM documents")
add("t6_ngrams",
    lambda c: c.corpus.select("query_id", F.explode(F.expr(T.ngrams(T.words("query")))).alias("g")).selectExpr(
        "query_id", "cast(g.n as bigint) as n", "cast(g.pos as bigint) as pos", "g.text as gram"),
    Q.sql("SELECT query_id, n, i - 1 AS pos, array_to_string(list_slice(w, i, i + n - 1), ' ') AS gram FROM ("
          "SELECT query_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT query_id, w,"
          f" unnest(range(1, least(6, len(w)) + 1)) AS n FROM (SELECT query_id, {Q.words('query')} AS w FROM corpus)))", "corpus"))
_TOK = f"(SELECT doc_id, lang, source, {Q.tokens('text')} AS k FROM documents)"
add("t7_word_measures",
    lambda c: _docs(c).withColumn("k", F.expr(T.tokens("text"))).selectExpr(
        "doc_id", "size(k) as word_count", f"round({T.mean_length('k')}, 6) as avg_word_length"),
    "SELECT doc_id, CAST(len(k) AS INTEGER) AS word_count, CASE WHEN len(k) = 0 THEN 0 ELSE"
    f" round(list_sum(list_transform(k, lambda x: length(x)))::DOUBLE / len(k), 6) END AS avg_word_length FROM {_TOK}")
add("t8_sentence_count", lambda c: analyze(c.records).select("query_id", "sentence_count"),
    Q.sql("SELECT query_id, 1 AS sentence_count FROM records", "records"))
_SENTENCE_PARTS = (
    "size(s) as sentence_count", "array_join(transform(s, x -> length(x)), ',') as lengths", "md5(array_join(s, '|')) as sentences_md5",
)
_SENTENCES_SQL = (
    "CAST(len(s) AS INTEGER) AS sentence_count, coalesce(array_to_string(list_transform(s, lambda x: length(x)), ','), '') AS lengths,"
    " md5(coalesce(array_to_string(s, '|'), '')) AS sentences_md5"
)
add("t8_sentences_documents",
    lambda c: _docs(c).withColumn("s", F.expr(T.sentences("text"))).selectExpr("doc_id", *_SENTENCE_PARTS),
    f"SELECT doc_id, {_SENTENCES_SQL} FROM (SELECT doc_id, {Q.sentences('text')} AS s FROM documents)")
add("t8_sentences_turns",
    lambda c: c.table("conversations").withColumn("s", F.expr(T.sentences("text"))).selectExpr("conv_id", "turn", *_SENTENCE_PARTS),
    f"SELECT conv_id, turn, {_SENTENCES_SQL} FROM (SELECT conv_id, turn, {Q.sentences('text')} AS s FROM conversations)")
add("t9_stop_words",
    lambda c: _docs(c).withColumn("k", F.expr(T.tokens("text"))).selectExpr(
        "doc_id", f"size({T.remove_stop_words('k', 'lang')}) as kept_tokens"),
    f"SELECT doc_id, CAST(len(list_filter(k, lambda t: lang <> 'en' OR lower(t) NOT IN ({Q.items(vocab.STOP_WORDS['en'])}))) AS INTEGER)"
    f" AS kept_tokens FROM {_TOK}")


def t10_keywords(c: Inputs) -> DataFrame:
    return document_keywords(c.documents, "doc_id", "text", "lang").selectExpr(
        "doc_id", "array_join(keywords, ' ') as keywords")


_KEYWORDS = (
    "SELECT doc_id, string_agg(tok, ' ' ORDER BY r) AS keywords FROM (SELECT doc_id, tok, row_number() OVER"
    " (PARTITION BY doc_id ORDER BY n DESC, first) AS r FROM (SELECT doc_id, lower(tok) AS tok, count(*) AS n, min(pos) AS first"
    f" FROM (SELECT doc_id, lang, unnest(k) AS tok, generate_subscripts(k, 1) AS pos FROM {_TOK})"
    f" WHERE (lang <> 'en' OR lower(tok) NOT IN ({Q.items(vocab.STOP_WORDS['en'])})) AND length(lower(tok)) > 2"
    " GROUP BY doc_id, lower(tok))) WHERE r <= 10 GROUP BY doc_id")
add("t10_keywords", t10_keywords, _KEYWORDS)
# one id for three documents, none for some: the exploded form agrees with the one inside the row
_SHARED = "nullif(doc_id div 3, 4)"
add("t10_repeated_ids",
    lambda c: document_keywords(c.documents.withColumn("doc_id", F.expr(_SHARED)), "doc_id", "text", "lang").selectExpr(
        "doc_id", "array_join(keywords, ' ') as keywords"),
    f"SELECT nullif(doc_id // 3, 4) AS doc_id, keywords FROM ({_KEYWORDS})")
add("t10_keywords_in_row",
    lambda c: _docs(c).withColumn("k", F.expr(T.tokens("text"))).selectExpr(
        "doc_id", f"array_join({T.keywords('k', 'lang')}, ' ') as keywords").filter("keywords <> ''"), _KEYWORDS)
add("t10_keywords_requests",
    lambda c: analyze(c.records).selectExpr("query_id", "array_join(keywords, ' ') as keywords"),
    Q.sql(f"SELECT query_id, {Q.joined('keywords', ' ')} AS keywords FROM analyzed", "analyzed"))
add("t11_topics", lambda c: analyze(c.records).selectExpr("query_id", "array_join(topics, '|') as topics"),
    Q.sql(f"SELECT query_id, {Q.joined('topics', '|')} AS topics FROM analyzed", "analyzed"))
add("t12_grammar", lambda c: analyze(c.records).selectExpr("query_id", "array_join(grammar_issues, '|') as issues"),
    Q.sql(f"SELECT query_id, {Q.joined('grammar_issues', '|')} AS issues FROM analyzed", "analyzed"))
add("t12_grammar_raw",
    lambda c: _expr(_docs(c), "doc_id", f"array_join({T.grammar_issues('text', 'lang')}, '|') as issues"),
    f"SELECT doc_id, {Q.joined(Q.grammar('text', 'lang'), '|')} AS issues FROM documents")
add("t13_language_gate",
    lambda c: _expr(_docs(c), "doc_id", f"{T.gate_language('text', 'lang')} as gated"),
    f"SELECT doc_id, {Q.gate('text', 'lang')} AS gated FROM documents")


def t14_language(c: Inputs) -> DataFrame:
    parts = _docs(c).withColumn("w", F.expr(T.words("text")))
    hits = T.language_hits("w")
    counted = parts.selectExpr("doc_id", "lang", *[f"{e} as {code}_hits" for code, e in hits.items()])
    return counted.selectExpr("doc_id", "lang", f"{T.best_language({k: f'{k}_hits' for k in hits})} as detected")


add("t14_language", t14_language, f"SELECT doc_id, lang, {Q.language('text')} AS detected FROM documents")
add("t14_language_requests",
    lambda c: _expr(c.corpus, "query_id", f"{T.language_of(T.collapse_space('lower(query)'))} as lang"),
    Q.sql("SELECT query_id, lang FROM spoken", "spoken"))
add("t15_vietnamese_words", lambda c: _expr(c.corpus, "query_id", f"{T.has_vietnamese_words('lower(query)')} as has_words"),
    Q.sql(f"SELECT query_id, {Q.has('lower(query)', vocab.VIETNAMESE_INDICATORS)} AS has_words FROM corpus", "corpus"))

_PARTS = ("compound", "pos", "neu", "neg")


def _score_columns(df: DataFrame, expression: str, key: str = "doc_id") -> DataFrame:
    return df.withColumn("s", F.expr(expression)).selectExpr(key, *[f"s.{p}" for p in _PARTS])


_CLASS = "CASE WHEN quality = 1 AND toxic = 0 THEN 'positive' WHEN toxic = 1 THEN 'negative' ELSE 'other' END"
add("t16_sentiment_class",
    lambda c: _score_columns(c.table("labels").withColumn("cls", F.expr(_CLASS)), T.sentiment_from_class("cls")),
    f"SELECT doc_id, CASE k WHEN 'positive' THEN 0.5::DOUBLE WHEN 'negative' THEN -0.5::DOUBLE ELSE 0::DOUBLE END AS compound,"
    " CASE k WHEN 'positive' THEN 0.5::DOUBLE ELSE 0::DOUBLE END AS pos, CASE WHEN k IN ('positive', 'negative') THEN 0.5::DOUBLE ELSE 1::DOUBLE END AS neu,"
    f" CASE k WHEN 'negative' THEN 0.5::DOUBLE ELSE 0::DOUBLE END AS neg FROM (SELECT doc_id, {_CLASS} AS k FROM labels)")
add("t17_sentiment_polarity",
    lambda c: _score_columns(
        c.table("events").selectExpr("event_id as query_id", "value / 100D - 0.5D as p"), T.sentiment_from_polarity("p"), "query_id"),
    "SELECT event_id AS query_id, p AS compound, greatest(0::DOUBLE, p) AS pos, 1 - abs(p) AS neu, greatest(0::DOUBLE, -p) AS neg"
    " FROM (SELECT event_id, value / 100::DOUBLE - 0.5::DOUBLE AS p FROM events)")
add("t18_neutral_sentiment", lambda c: _score_columns(c.documents, T.neutral_sentiment()),
    "SELECT doc_id, 0::DOUBLE AS compound, 0::DOUBLE AS pos, 1::DOUBLE AS neu, 0::DOUBLE AS neg FROM documents")
add("t19_default_tags",
    lambda c: c.corpus.withColumn("k", F.expr(T.tokens("query"))).selectExpr(
        "query_id", f"array_join(transform({T.default_tags('k')}, t -> concat(t.token, '/', t.tag)), ' ') as tags",
        f"array_join(transform({T.default_dependencies('k')}, d -> concat(d.text, '<', d.head, ':', d.dep)), ' ') as deps",
        f"array_join(transform({T.default_dependencies('k', False)}, d -> concat(d.text, '<', d.head)), ' ') as headless"),
    Q.sql("SELECT query_id, array_to_string(list_transform(k, lambda t: t || '/UNK'), ' ') AS tags,"
          " array_to_string(list_transform(k, lambda t: t || '<' || t || ':UNK'), ' ') AS deps,"
          " array_to_string(list_transform(k, lambda t: t || '<'), ' ') AS headless"
          f" FROM (SELECT query_id, {Q.tokens('query')} AS k FROM corpus)", "corpus"))

# a dependency parse derived from each request: head position and relation per token
_HEAD = "(query_id + pos * 3) % (n + 2)"


def t20_heads(c: Inputs) -> DataFrame:
    parsed = ("transform(k, (t, i) -> named_struct('text', t, 'head',"
              " cast((query_id + i * 3) % (size(k) + 2) as int), 'dep', concat('d', i % 3)))")
    tags = "transform(slice(k, 1, size(k) - cast(query_id % 2 as int)), t -> upper(substring(t, 1, 1)))"
    rows = c.corpus.withColumn("k", F.expr(T.tokens("query"))).filter("size(k) > 0")
    return rows.selectExpr("query_id", f"array_join(transform({T.resolve_heads(parsed, tags)},"
                           " d -> concat(d.text, '>', d.head, ':', d.dep, '/', d.pos)), ' ') as deps")


add("t20_dependency_heads", t20_heads, Q.sql(
    "SELECT query_id, string_agg(token || '>' || CASE WHEN h > 0 AND h <= n THEN k[h] ELSE token END || ':d' || (pos % 3) || '/'"
    " || CASE WHEN query_id % 2 = 0 THEN upper(substr(token, 1, 1)) ELSE 'UNK' END, ' ' ORDER BY pos) AS deps FROM ("
    f"SELECT query_id, pos, token, k, n, {_HEAD} AS h FROM (SELECT query_id, k, len(k) AS n, unnest(k) AS token,"
    f" generate_subscripts(k, 1) - 1 AS pos FROM (SELECT query_id, {Q.tokens('query')} AS k FROM corpus))) GROUP BY query_id", "corpus"))

_TAGS = ("transform(k, (t, i) -> case (query_id + i) % 7 when 0 then 'B-PER' when 1 then 'I-PER'"
         " when 4 then 'B-LOC' else 'O' end)")


def tagged(c: Inputs) -> DataFrame:
    """The corpus with its derived entity column."""
    rows = c.corpus.withColumn("k", F.expr(T.tokens("query")))
    return rows.withColumn("entities", F.expr(N.fold_tags("k", _TAGS, "query"))).drop("k")


def tag_rows(c: Inputs) -> DataFrame:
    rows = c.corpus.withColumn("k", F.expr(T.tokens("query")))
    return rows.withColumn("g", F.expr(_TAGS)).select(
        "query_id", F.posexplode(F.arrays_zip("k", "g")).alias("pos", "z")
    ).selectExpr("query_id", "pos", "z.k as token", "z.g as tag")


add("w10_entity_spans", lambda c: N.fold_tag_rows(tag_rows(c)),
    Q.sql("SELECT query_id, span, text, label FROM spans", "spans"))
add("w10_entity_spans_array",
    lambda c: tagged(c).select("query_id", F.posexplode("entities").alias("pos", "e")).selectExpr("query_id", "e.text", "e.label"),
    Q.sql("SELECT query_id, text, label FROM spans", "spans"))
add("t21_entity_offsets",
    lambda c: tagged(c).select("query_id", "query", F.explode("entities").alias("e")).withColumn(
        "x", F.expr(T.locate_entity("query", "e.text", "e.label"))).selectExpr(
        "query_id", "x.text", "x.label", "x.start as start_at", "x.end as end_at"),
    Q.sql("SELECT query_id, text, label, CAST(instr(query, text) - 1 AS INTEGER) AS start_at,"
          " CAST(instr(query, text) - 1 + length(text) AS INTEGER) AS end_at FROM spans JOIN corpus USING (query_id)", "spans", "corpus"))
_ANALYZED = ("query_id, lang, CAST(len(toks) AS INTEGER) AS word_count, 1 AS sentence_count, round(avg_word_length, 6) AS avg_word_length,"
             f" {Q.joined('keywords', ' ')} AS keywords, {Q.joined('topics', '|')} AS topics, {Q.joined('grammar_issues', '|')} AS issues")


def _analysis_row(df: DataFrame) -> DataFrame:
    return df.selectExpr(
        "query_id", "lang", "word_count", "sentence_count", "round(avg_word_length, 6) as avg_word_length",
        "array_join(keywords, ' ') as keywords", "array_join(topics, '|') as topics", "array_join(grammar_issues, '|') as issues")


add("t22_analysis", lambda c: _analysis_row(analyze(c.records)), Q.sql(f"SELECT {_ANALYZED} FROM analyzed", "analyzed"))
add("t23_techniques",
    lambda c: process(c.records, ("tokenization", "lemmatization", "sentiment_analysis")).selectExpr(
        "query_id", "lang", "array_join(tokens, ' ') as tokens", "size(pos_tags) as tag_count",
        "array_join(lemmas, ' ') as lemmas", "sentiment.neu as neu", "size(dependencies) as dep_count"),
    Q.sql("SELECT query_id, lang, array_to_string(toks, ' ') AS tokens, 0 AS tag_count, array_to_string(toks, ' ') AS lemmas,"
          " 1::DOUBLE AS neu, 0 AS dep_count FROM analysis", "analysis"))
add("t24_empty_text",
    lambda c: analyze(c.dirty).selectExpr("query_id", "sentence_count", "word_count", "lang", "size(keywords) as keyword_count"),
    Q.sql(f"SELECT query_id, CASE WHEN coalesce(query, '') = '' THEN 0 ELSE 1 END AS sentence_count, CAST(len({Q.tokens('k')}) AS INTEGER) AS word_count,"
          f" {Q.gate('k', Q.language('k'))} AS lang, CAST(coalesce(kc, 0) AS INTEGER) AS keyword_count FROM (SELECT query_id, query, {Q.tidy('''coalesce(query, '')''')} AS k FROM dirty)"
          " LEFT JOIN (SELECT query_id, least(10, count(*)) AS kc FROM (SELECT DISTINCT query_id, lower(tok) AS tok FROM ("
          f"SELECT query_id, lang, unnest(toks) AS tok FROM (SELECT query_id, {Q.gate('k', Q.language('k'))} AS lang, {Q.tokens('k')} AS toks FROM ("
          f"SELECT query_id, {Q.tidy('''coalesce(query, '')''')} AS k FROM dirty))) WHERE CASE {Q._STOP} ELSE true END AND length(lower(tok)) > 2)"
          " GROUP BY query_id) USING (query_id)", "dirty"))


def _measure(row: dict) -> dict:
    if row["query"].startswith("xyz"):
        raise ValueError("unreadable request")
    return {"query_id": row["query_id"], "n_chars": len(row["query"])}


def t25_failures(c: Inputs) -> DataFrame:
    done = apply_rows(c.corpus.select("query_id", "query"), _measure, "query_id bigint, n_chars int")
    return done.selectExpr("query_id", "n_chars", "error is null as success", "coalesce(error, '') as error_message")


add("t25_failed_rows", t25_failures, Q.sql(
    "SELECT query_id, CASE WHEN query NOT LIKE 'xyz%' THEN CAST(length(query) AS INTEGER) END AS n_chars, query NOT LIKE 'xyz%' AS success,"
    " CASE WHEN query LIKE 'xyz%' THEN 'unreadable request' ELSE '' END AS error_message FROM corpus", "corpus"))
_FLAT = ("query_id, query AS original_query, knowledge_domain, workers, lang AS detected_language, CAST(len(toks) AS INTEGER) AS token_count,"
         " 0 AS entity_count, 0::DOUBLE AS sentiment_score, CAST(len(toks) AS INTEGER) AS word_count, CAST(len(keywords) AS INTEGER) AS keyword_count,"
         " CAST(len(topics) AS INTEGER) AS topic_count, true AS success, '' AS error_message")
add("t26_corpus_analysis",
    lambda c: _analysis_row(analysis_table(c.records)),
    Q.sql(f"SELECT {_ANALYZED} FROM analyzed", "analyzed"))
add("s13_flat_results",
    lambda c: sinks.flat_results(analysis_table(c.records)).withColumn("sentiment_score", F.col("sentiment_score").cast("double")),
    Q.sql(f"SELECT {_FLAT} FROM analyzed", "analyzed"))
_SENT = ("query_id, query AS original_query, knowledge_domain, workers AS worker, lang AS language, CAST(len(toks) AS INTEGER) AS word_count,"
         " 1 AS sentence_count, round(avg_word_length, 6) AS avg_word_length, CAST(len(toks) AS INTEGER) AS tokens_count,"
         " CAST(len(toks) AS INTEGER) AS pos_tags_count, 0 AS entities_count, CAST(len(keywords) AS INTEGER) AS keywords_count,"
         " CAST(len(topics) AS INTEGER) AS topics_count, CAST(len(grammar_issues) AS INTEGER) AS grammar_issues_count,"
         f" 0::DOUBLE AS sentiment_score, {Q.joined('list_slice(toks, 1, 10)', '|')} AS tokens, {Q.joined('list_slice(keywords, 1, 5)', '|')} AS keywords,"
         f" {Q.joined('topics', '|')} AS topics, {Q.joined('list_slice(grammar_issues, 1, 3)', '|')} AS grammar_issues")
add("s14_flat_sentences", lambda c: sinks.flat_sentences(analysis_table(c.records)),
    Q.sql(f"SELECT {_SENT} FROM analyzed", "analyzed"))
add("t27_sentence_report",
    lambda c: sinks.flat_sentences(sentence_report(c.records, n=120, order=_hash())),
    Q.sql(f"SELECT {_SENT} FROM analyzed WHERE workers IN ('FUNCTION_CALLING', 'DOC_SEARCH')"
          f" QUALIFY row_number() OVER (PARTITION BY workers ORDER BY {HASH}, query_id) <= 120", "analyzed"))
add("t28_phone_display",
    lambda c: c.corpus.selectExpr("query_id", f"{T.display_phone('query')} as phone").filter("phone <> ''"),
    Q.sql(f"SELECT query_id, regexp_replace(regexp_replace(regexp_extract(query, {Q.text(P.PHONE)}, 2), {Q.text(P.SPACES)}, '', 'g'), '^[+]84', '0') AS phone"
          f" FROM corpus WHERE {Q.rx('query', P.PHONE)}", "corpus"))

# --- statistics over analysed text ---------------------------------------------------------

add("a17_language_tally",
    lambda c: S.language_tally(c.corpus.selectExpr(
        f"{T.language_of(T.collapse_space('lower(query)'))} as lang", f"{T.has_vietnamese_words('lower(query)')} as has_indicator")),
    Q.sql("SELECT lang, count(*) AS row_count, count(*) FILTER (lang = 'vi' AND i) AS with_indicator FROM (SELECT lang,"
          f" {Q.has('lower(query)', vocab.VIETNAMESE_INDICATORS)} AS i FROM spoken JOIN corpus USING (query_id)) GROUP BY lang", "spoken", "corpus"))
add("a18_token_statistics",
    lambda c: S.token_statistics(c.dirty.selectExpr(f"size({T.tokens('''coalesce(query, '')''')}) as token_count")),
    Q.sql("SELECT count(*) AS total, count(*) FILTER (n > 0) AS successful, round(count(*) FILTER (n > 0) / count(*), 6) AS success_rate,"
          f" round(avg(n) FILTER (n > 0), 6) AS avg_tokens FROM (SELECT len({Q.tokens('''coalesce(query, '')''')}) AS n FROM dirty)", "dirty"))
add("a19_tag_distribution",
    lambda c: S.element_distribution(
        c.corpus.withColumn("k", F.expr(T.tokens("query"))).withColumn("g", F.expr(_TAGS)), "g", "tag"),
    Q.sql("SELECT tag, count(*) AS element_count FROM tag_rows GROUP BY tag", "tag_rows"))
add("a20_entity_distribution", lambda c: S.element_distribution(tagged(c), "entities.label", "label"),
    Q.sql("SELECT label, count(*) AS element_count FROM spans GROUP BY label", "spans"))
add("a21_sentiment_distribution",
    lambda c: S.sentiment_distribution(c.table("events").selectExpr(f"{T.sentiment_class('value / 100D - 0.5D')} as sentiment_class")),
    "SELECT CASE WHEN p > 0.1::DOUBLE THEN 'positive' WHEN p < -0.1::DOUBLE THEN 'negative' ELSE 'neutral' END AS sentiment_class,"
    " count(*) AS row_count FROM (SELECT value / 100::DOUBLE - 0.5::DOUBLE AS p FROM events) GROUP BY 1")
add("a22_text_means", lambda c: S.text_means(analysis_table(c.records)),
    Q.sql("SELECT count(*) AS total, round(avg(len(toks)), 6) AS avg_words, 0::DOUBLE AS avg_sentiment,"
          " round(avg(len(keywords)), 6) AS avg_keywords, round(avg(len(topics)), 6) AS avg_topics FROM analyzed", "analyzed"))
add("a23_composite_success",
    lambda c: S.composite_success(
        analyze(c.dirty).selectExpr("word_count > 0 as a", "size(keywords) > 0 as b", "lang <> 'unknown' as c", "sentiment is not null as d"),
        ["a", "b", "c", "d"]),
    ORACLES["t24_empty_text"].replace("SELECT query_id, CASE WHEN coalesce(query, '') = ''", (
        "SELECT count(*) * 4 AS tests, CAST(sum(p) AS BIGINT) AS passed, round(100.0::DOUBLE * sum(p) / (count(*) * 4), 6) AS success_rate,"
        " 100.0::DOUBLE * sum(p) / (count(*) * 4) >= 80 AS suite_passed FROM (SELECT (word_count > 0)::INT + (keyword_count > 0)::INT"
        " + (lang <> 'unknown')::INT + 1 AS p FROM (SELECT query_id, CASE WHEN coalesce(query, '') = ''"), 1) + "))")
