"""Queries for the detectors and the vote reduction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import patterns as P, text as T, vocab
from ..functions.labels import select_from_vector, top_from_vector
from ..functions.vectors import normalize_vector, sum_vectors
from ..operators import detectors as D
from ..operators.lookup import location_matches
from ..plans.labelling import VOTES, detector_flags, label_queries, label_votes
from ..sources.gazetteer import build_gazetteer
from ..sources.tables import label_table
from . import oracle as Q
from .corpus import ASSISTANT
from .registry import Inputs, add
from .texts import tagged

VIEWS = D.TextViews.of("query")
DETECTORS = D.default_detectors(ASSISTANT)


def _flags(c: Inputs) -> DataFrame:
    return detector_flags(c.corpus, DETECTORS, gazetteer=c.gazetteer)


def _votes(c: Inputs) -> DataFrame:
    return label_votes(c.corpus, DETECTORS, gazetteer=c.gazetteer)


def _ranked(c: Inputs, **options) -> DataFrame:
    return label_queries(c.corpus, DETECTORS, gazetteer=c.gazetteer, **options)


def add_flag(key: str, expression: str, oracle: str, name: str = "flag", needs: str = "views") -> None:
    add(key, lambda c: c.corpus.selectExpr("query_id", f"{expression} as {name}"),
        Q.sql(f"SELECT query_id, {oracle} AS {name} FROM {needs}", needs))


# --- one query per sub-detector ------------------------------------------------------------

_COMMANDS = D.command_flags(VIEWS)
add("d1a_commands", lambda c: c.corpus.selectExpr("query_id", *[f"{e} as {n}" for n, e in _COMMANDS.items()]),
    Q.sql("SELECT query_id, " + ", ".join(f"{Q.FLAGS[f'syntax_{n}']} AS {n}" for n in _COMMANDS) + " FROM views", "views"))
add_flag("d1b_reminder_words", D.reminder_words(VIEWS), Q.FLAGS["syntax_reminder"])
_TIME = D.time_flags(VIEWS)
add_flag("d2a_time_patterns", _TIME["regex"], Q.FLAGS["time_regex"])
add_flag("d2b_time_keywords", _TIME["keyword"], Q.FLAGS["time_keyword"])
# the corpus itself has no indicator word, so one domain's requests get a "how long"
_ASKED = "query || CASE WHEN knowledge_domain = 'BRCD' THEN ' mất   bao   lâu' ELSE '' END"
add("d2c_time_indicators",
    lambda c: c.corpus.selectExpr("query_id", f"{_ASKED} as asked").selectExpr(
        "query_id", f"{D.time_flags(D.TextViews.of('asked'))['indicator']} as flag"),
    Q.sql(f"SELECT query_id, {Q.has('t', vocab.TIME_INDICATORS['vietnamese'])} AS flag"
          f" FROM (SELECT query_id, {Q.tidy(f'lower({_ASKED})')} AS t FROM corpus)", "corpus"))
_EN = D.time_flags(VIEWS, "english")
_EN_SQL = {
    "regex": Q.any_rx("l", P.time_patterns("english")),
    "keyword": f"({Q.has('l', vocab.TIME_KEYWORDS['english'])})",
    "indicator": f"({Q.has('t', vocab.TIME_INDICATORS['english'])})",
}
add("d2d_time_english", lambda c: c.corpus.selectExpr("query_id", *[f"{e} as {n}" for n, e in _EN.items()]),
    Q.sql("SELECT query_id, " + ", ".join(f"{e} AS {n}" for n, e in _EN_SQL.items()) + " FROM views", "views"))


def d2d_by_language(c: Inputs) -> DataFrame:
    rows = c.corpus.withColumn("lang", F.expr(T.language_of(T.collapse_space("lower(query)"))))
    chosen = D.time_flags_by_language(VIEWS, "lang")
    return rows.selectExpr("query_id", "lang", *[f"{e} as {n}" for n, e in chosen.items()])


add("d2d_time_by_language", d2d_by_language, Q.sql(
    "SELECT query_id, lang, " + ", ".join(
        f"CASE WHEN lang = 'en' THEN {_EN_SQL[n]} ELSE {Q.FLAGS[f'time_{n}']} END AS {n}" for n in _EN_SQL)
    + " FROM views JOIN spoken USING (query_id)", "views", "spoken"))
add("d3a_doc_terms",
    lambda c: c.corpus.selectExpr("query_id", f"array_join({D.doc_nouns(VIEWS)}, '|') as nouns", f"array_join({D.doc_verbs(VIEWS)}, '|') as verbs"),
    Q.sql(f"SELECT query_id, {Q.joined(Q.found('l', vocab.DOC_NOUNS), '|')} AS nouns, {Q.joined(Q.found('l', vocab.DOC_VERBS), '|')} AS verbs FROM views", "views"))
add_flag("d3b_question_start", D.question_start(VIEWS),
         "list_filter(" + Q.listed(vocab.QUESTION_STARTS) + ", lambda w: s = w OR starts_with(s, w || ' '))[1]", "word")
add_flag("d3c_question_end", D.question_end(VIEWS),
         "list_filter(" + Q.listed(vocab.QUESTION_ENDINGS) + f", lambda w: regexp_matches(s, w || {Q.text(P.question_end(''))}))[1]", "word")
add_flag("d3d_short_definition", D.short_definition(VIEWS), Q._SHORT)
add_flag("d3e_names_assistant", D.names_assistant(VIEWS, ASSISTANT), Q._NAMED)
add("d4a_person_name",
    lambda c: tagged(c).selectExpr("query_id", f"coalesce({D.person_name('entities')}, '') as kind"),
    Q.sql("SELECT query_id, coalesce(kind, '') AS kind FROM corpus LEFT JOIN (SELECT query_id, CASE WHEN arg_min(n, span) < 2 THEN 'single'"
          " ELSE 'multiple' END AS kind FROM spans WHERE label = 'PER' GROUP BY query_id) USING (query_id)", "corpus", "spans"))
add_flag("d4b_user_id", D.user_id(VIEWS), Q.FLAGS["person_user_id"])
add_flag("d4c_user_name", D.user_name(VIEWS), "named", needs="user_names")
add_flag("d4d_self_reference", D.self_reference(VIEWS), Q.FLAGS["person_self"])
add_flag("d4e_phone", D.phone(VIEWS), Q.FLAGS["person_phone"])
_Q = D.quantity_flags(VIEWS)
add_flag("d6a_quantity_terms", _Q["keyword"], Q.FLAGS["quantity_keyword"])
add_flag("d6b_comparatives", _Q["comparative"], Q.FLAGS["quantity_comparative"])
add_flag("d6c_numeric_forms", _Q["regex"], Q.FLAGS["quantity_regex"])
add_flag("d7a_assistant_name", D.names_assistant(VIEWS, ASSISTANT), Q._NAMED)
add_flag("d7b_second_person", D.second_person(VIEWS), Q.rx("l", P.whole(vocab.SECOND_PERSON)))
add_flag("d7c_comrade", D.comrade(VIEWS), Q.rx("l", P.whole([P.COMRADE])))
# with entities: an occurrence counts unless a person span starts within one character
_GAP = Q.text(P.COMRADE_GAP)
_OCCURRENCES = (
    "SELECT query_id, e + length(regexp_extract(substr(l, e + 1), " + _GAP + ", 0)) AS at,"
    " (k = 1 OR before <> '') AND (k = n OR after <> '') AND NOT regexp_matches(before, '[\\p{L}\\p{N}_]$')"
    " AND NOT regexp_matches(after, '^[\\p{L}\\p{N}_]') AS whole FROM (SELECT query_id, l, k, len(h) AS n, g[k] AS before, g[k + 1] AS after,"
    " CAST(list_sum(list_transform(list_slice(g, 1, k), lambda x: length(x))) + list_sum(list_transform(list_slice(h, 1, k), lambda x: length(x))) AS BIGINT) AS e"
    f" FROM (SELECT query_id, l, string_split_regex(l, {Q.text(P.COMRADE)}) AS g, regexp_extract_all(l, {Q.text(P.COMRADE)}) AS h,"
    f" unnest(range(1, len(regexp_extract_all(l, {Q.text(P.COMRADE)})) + 1)) AS k FROM views))"
)
add("d7c_comrade_with_entities",
    lambda c: tagged(c).selectExpr("query_id", f"{D.comrade(D.TextViews.of('query', 'entities'))} as flag"),
    Q.sql("SELECT query_id, coalesce(f, false) AS flag FROM corpus LEFT JOIN (SELECT query_id, bool_or(whole AND NOT EXISTS ("
          "SELECT 1 FROM spans JOIN corpus c2 USING (query_id) WHERE spans.query_id = o.query_id AND label = 'PER'"
          " AND instr(c2.query, head) - 1 - o.at BETWEEN 0 AND 1)) AS f"
          f" FROM ({_OCCURRENCES}) o GROUP BY query_id) USING (query_id)", "corpus", "views", "spans"))
_SIMPLE = (f"(len({Q.tokens('s')}) <= 16 AND ({Q.rx('s', P.SIMPLE_QUESTION)} OR (contains(s, '?') AND len({Q.tokens('s')}) <= 12)))")
add_flag("d7d_simple_question", D.simple_question(VIEWS), _SIMPLE)

# --- one query per detector: its share of each slot it reaches --------------------------------

_NAMES = {"d1": "syntax", "d2": "time", "d3": "documents", "d4": "person", "d5": "location", "d6": "quantity", "d7": "assistant"}


def _detector(name: str):
    def build(c: Inputs) -> DataFrame:
        chosen = [d for d in DETECTORS if d.name == name]
        return label_votes(c.corpus, detectors=chosen, gazetteer=c.gazetteer).select("query_id", *VOTES)

    return build


for _key, _name in _NAMES.items():
    _slots = Q.SLOTS[_name]
    add(f"{_key}_{_name}_detector", _detector(_name), Q.sql(
        "SELECT query_id, " + ", ".join(f"{Q.six(_slots.get(i, '0::DOUBLE'))} AS vote_{i}" for i in range(8)) + " FROM flags", "flags"))
add("d7_assistant_simple_only",
    lambda c: c.corpus.selectExpr("query_id", f"{D.assistant_flags(VIEWS, ASSISTANT, require_simple=True)['address']} as flag"),
    Q.sql(f"SELECT query_id, {Q.FLAGS['assistant_address']} AND {_SIMPLE} AS flag FROM views", "views"))

# --- votes -------------------------------------------------------------------------------

_RAW = {i: f"cast((query_id + {i}) % {i + 2} as double)" for i in range(8)}
_RAW_SQL = {i: f"CAST((query_id + {i}) % {i + 2} AS DOUBLE)" for i in range(8)}
add("v1_normalize",
    lambda c: c.corpus.selectExpr("query_id", *[f"round({e}, 6) as s{i}" for i, e in normalize_vector(_RAW).items()]),
    Q.sql("SELECT query_id, " + ", ".join(
        f"round(CASE WHEN t > 0 THEN {e} / t ELSE 0 END, 6) AS s{i}" for i, e in _RAW_SQL.items())
        + f" FROM (SELECT *, {' + '.join(_RAW_SQL.values())} AS t FROM corpus)", "corpus"))
# two vectors, the second of which fails (null) on some rows
_FAILING = {i: f"case when query_id % 10 = 3 then null else {e} end" for i, e in _RAW.items() if i % 2}
add("v2_sum",
    lambda c: c.corpus.selectExpr("query_id", *[f"{e} as s{i}" for i, e in enumerate(sum_vectors([_RAW, _FAILING]))]),
    Q.sql("SELECT query_id, " + ", ".join(
        f"{e} + " + (f"CASE WHEN query_id % 10 = 3 THEN 0::DOUBLE ELSE {e} END" if i % 2 else "0::DOUBLE") + f" AS s{i}"
        for i, e in _RAW_SQL.items()) + " FROM corpus", "corpus"))
add("v2_vote_sums", lambda c: _votes(c).select("query_id", *VOTES),
    Q.sql("SELECT query_id, " + ", ".join(VOTES) + " FROM votes", "votes"))
_SHOW = "array_join(labels, '|') as labels", "array_join(transform(votes, v -> format_string('%.6f', v)), '|') as votes"
_SHOW_SQL = "array_to_string(labels, '|') AS labels, array_to_string(list_transform(votes, lambda v: printf('%.6f', v)), '|') AS votes"
add("v3_rank_labels", lambda c: _ranked(c).selectExpr("query_id", *_SHOW),
    Q.sql(f"SELECT query_id, {_SHOW_SQL} FROM ranked", "ranked"))
add("v4_label_requests", lambda c: _ranked(c).selectExpr("query_id", "query", *_SHOW),
    Q.sql(f"SELECT query_id, query, {_SHOW_SQL} FROM ranked", "ranked"))
add("v4_label_requests_joined",
    lambda c: _ranked(c, inline_limit=0).selectExpr("query_id", "query", *_SHOW),
    Q.sql(f"SELECT query_id, query, {_SHOW_SQL} FROM ranked", "ranked"))
# ids that repeat or are missing: the text alone decides where a name occurs
_SPARSE = "case when query_id % 7 = 0 then null else query_id % 10 end"
for _route, _limit in (("", 20_000), ("_joined", 0)):
    add(f"v4_repeated_ids{_route}",
        lambda c, n=_limit: label_votes(
            c.corpus.selectExpr(f"{_SPARSE} as query_id", "query"), DETECTORS, gazetteer=c.gazetteer, inline_limit=n
        ).groupBy("query_id", "query").agg(F.count("*").alias("n"), F.max("vote_3").alias("vote_3")),
        Q.sql(f"SELECT {_SPARSE} AS query_id, query, count(*) AS n, max(vote_3) AS vote_3 FROM votes GROUP BY 1, 2", "votes"))
# names longer than six words, made of the names themselves
_LONG = "'the far country that is called ' || lower(replace(n_name, '_', ' '))"
for _route, _limit in (("", 20_000), ("_joined", 0)):
    add(f"j2_long_names{_route}",
        lambda c, n=_limit: location_matches(
            c.corpus.selectExpr("query_id", "'to The far country that is called ' || split(query, ' ')[0] as query"), "query_id", "query",
            build_gazetteer(c.table("nation").selectExpr(f"{_LONG} as name")), inline_limit=n),
        Q.sql(f"SELECT query_id, name AS location, 7 AS n_tokens, 1 AS position FROM corpus JOIN (SELECT {_LONG} AS name FROM nation)"
              " ON 'the far country that is called ' || replace(lower(string_split(query, ' ')[1]), '_', ' ') = name", "corpus"))

# the label path over real texts
def _texts(c: Inputs) -> dict[str, DataFrame]:
    return {
        "documents": c.documents.selectExpr("doc_id as query_id", "text as query"),
        "conversations": c.table("conversations").selectExpr("conv_id * 1000 + turn as query_id", "text as query"),
    }


_SOURCES = {
    "documents": "SELECT doc_id AS query_id, text AS query, '' AS knowledge_domain, '' AS worker FROM documents",
    "conversations": "SELECT conv_id * 1000 + turn AS query_id, text AS query, '' AS knowledge_domain, '' AS worker FROM conversations",
}
for _source, _body in _SOURCES.items():
    add(f"v4_{_source}",
        lambda c, s=_source: label_queries(_texts(c)[s], DETECTORS, gazetteer=c.gazetteer).selectExpr("query_id", *_SHOW),
        Q.sql(f"SELECT query_id, {_SHOW_SQL} FROM ranked", "ranked").replace(f"corpus AS ({Q.TABLES['corpus'][1]})", f"corpus AS ({_body})"))
    add(f"d_{_source}_flags",
        lambda c, s=_source: detector_flags(_texts(c)[s], DETECTORS, gazetteer=c.gazetteer).selectExpr("query_id", *Q.FLAGS),
        Q.sql("SELECT query_id, " + ", ".join(Q.FLAGS) + " FROM flags", "flags").replace(f"corpus AS ({Q.TABLES['corpus'][1]})", f"corpus AS ({_body})"))
add("v5_top_labels", lambda c: _ranked(c, top=2).selectExpr("query_id", *_SHOW),
    Q.sql("SELECT query_id, array_to_string(list_slice(labels, 1, 2), '|') AS labels,"
          " array_to_string(list_transform(list_slice(votes, 1, 2), lambda v: printf('%.6f', v)), '|') AS votes FROM ranked", "ranked"))
_VEC = "array(" + ", ".join(VOTES) + ")"
_VEC_SQL = "[" + ", ".join(VOTES) + "]"
_PAIR_SHOW = ("query_id", "array_join(p.label, '|') as labels", "array_join(transform(p.vote, v -> format_string('%.6f', v)), '|') as votes")
_IDX = "list_filter(range(1, 9), lambda i: {})"
add("v6_select_from_vector",
    lambda c: _votes(c).withColumn("p", F.expr(select_from_vector(_VEC))).selectExpr(*_PAIR_SHOW),
    Q.sql(f"SELECT query_id, {Q.joined(f'list_transform(k, lambda i: {Q.listed(vocab.LABELS)}[i])', '|')} AS labels,"
          f" {Q.joined('''list_transform(k, lambda i: printf('%.6f', v[i]))''', '|')} AS votes FROM (SELECT query_id, v,"
          " CASE WHEN len(list_filter(v, lambda x: x NOT IN (0, 1))) = 0 THEN " + _IDX.format("v[i] = 1")
          + " ELSE " + _IDX.format("v[i] > 0 AND v[i] = list_max(v)") + f" END AS k FROM (SELECT query_id, {_VEC_SQL} AS v FROM votes))", "votes"))
add("v7_top_from_vector",
    lambda c: _votes(c).withColumn("p", F.expr(top_from_vector(_VEC))).selectExpr(*_PAIR_SHOW),
    Q.sql(f"SELECT query_id, {Q.joined('list_transform(b, lambda x: x.label)', '|')} AS labels,"
          f" {Q.joined('''list_transform(b, lambda x: printf('%.6f', 0::DOUBLE - x.rank))''', '|')} AS votes"
          f" FROM (SELECT query_id, {Q._BEST} AS b FROM votes)", "votes"))
_LABEL_VALUES = ", ".join(f"({i}, '{x}')" for i, x in enumerate(vocab.LABELS))


def v9_available(c: Inputs) -> DataFrame:
    """Available labels with how often each one wins on the corpus."""
    wins = _ranked(c, top=1).groupBy(F.get("labels", F.lit(0)).alias("label")).agg(F.count("*").alias("wins"))
    return label_table(c.spark).join(wins, "label", "left").selectExpr("idx", "label", "coalesce(wins, 0) as wins")


add("v9_available_labels", v9_available, Q.sql(
    f"SELECT idx, label, coalesce(wins, 0) AS wins FROM (VALUES {_LABEL_VALUES}) d(idx, label)"
    " LEFT JOIN (SELECT labels[1] AS label, count(*) AS wins FROM ranked GROUP BY 1) USING (label)", "ranked"))
add("v10_empty_guard",
    lambda c: label_votes(c.dirty, DETECTORS).selectExpr(
        "query_id", "coalesce(query, '') = '' as rejected", " + ".join(VOTES) + " = 0 as all_zero").filter("rejected"),
    Q.sql("SELECT query_id, true AS rejected, true AS all_zero FROM dirty WHERE coalesce(query, '') = ''", "dirty"))
