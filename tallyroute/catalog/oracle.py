"""Building blocks of the DuckDB twins.

The twins state each rule over the full vocabularies with plain list and
regular-expression functions, so they do not share the shortcuts (pruned
vocabularies, covers, run-length counts) that the Spark expressions take.
"""

from __future__ import annotations

from ..functions import patterns as P, vocab
from .corpus import ASSISTANT, CORPUS, DIRTY, projection


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def items(values) -> str:
    return ", ".join(text(v) for v in values)


def listed(values) -> str:
    return f"[{items(values)}]"


def rx(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {text(pattern)})"


def any_rx(column: str, patterns) -> str:
    return "(" + " OR ".join(rx(column, p) for p in patterns) + ")"


def has(column: str, terms) -> str:
    return f"len(list_filter({listed(terms)}, lambda w: contains({column}, w))) > 0"


def found(column: str, terms) -> str:
    return f"list_filter({listed(terms)}, lambda w: contains({column}, w))"


def strip(column: str) -> str:
    return f"regexp_replace({column}, {text(P.TRIM)}, '', 'g')"


def tidy(column: str) -> str:
    return f"trim(regexp_replace({column}, {text(P.SPACES)}, ' ', 'g'))"


def norm(column: str) -> str:
    separated = f"regexp_replace(lower({column}), {text(P.SEPARATORS)}, ' ', 'g')"
    return tidy(f"strip_accents({separated})")


def tokens(column: str) -> str:
    return f"list_filter(string_split_regex({column}, {text(P.SPACES)}), lambda x: x <> '')"


def sentences(column: str) -> str:
    clean = f"translate(coalesce({column}, ''), {text(P.GUARD + P.END)}, '  ')"
    before = f"right(p, {P.BEFORE_DOT})"
    kept = f"{rx(before, P.UNENDED)} OR (i = 1 AND {rx(before, P.UNENDED_FIRST)}) OR (i > 1 AND {rx('p', P.UNENDED_LATER)})"
    dots = f"CASE WHEN i = len(string_split({clean}, '.')) THEN '' WHEN {kept} THEN {text(P.GUARD)} ELSE '.' END"
    marked = f"array_to_string(list_transform(string_split({clean}, '.'), lambda p, i: p || {dots}), '')"
    ended = f"regexp_replace({marked}, {text(P.SENTENCE_END)}, {text(chr(92) + '1' + chr(92) + '3' + P.END)}, 'g')"
    pieces = f"string_split(replace({ended}, {text(P.GUARD)}, '.'), {text(P.END)})"
    return f"list_transform(list_filter({pieces}, lambda s: {rx('s', P.WORD)}), lambda s: {strip('s')})"


def words(column: str) -> str:
    return f"regexp_extract_all(lower({column}), {text(P.WORD + '+')})"


def language(column: str) -> str:
    """Arg-max of function-word hits in profile order."""
    hits = ", ".join(
        f"len(list_filter({words(column)}, lambda w: w IN ({items(ws)})))"
        for ws in vocab.LANGUAGE_WORDS.values()
    )
    codes = listed(vocab.LANGUAGE_WORDS)
    return (
        f"CASE WHEN list_max([{hits}]) > 0"
        f" THEN {codes}[list_position([{hits}], list_max([{hits}]))] ELSE 'unknown' END"
    )


def gate(column: str, detected: str) -> str:
    return (
        f"CASE WHEN {column} IS NULL OR length({strip(column)}) < {vocab.MIN_LANGUAGE_LENGTH}"
        f" THEN 'unknown' WHEN {detected} IN ('en', 'vi') THEN {detected} ELSE 'unknown' END"
    )


def unique(column: str) -> str:
    return f"list_filter({column}, lambda x, i: list_position({column}, x) = i)"


def mapped(column: str) -> str:
    cases = " ".join(f"WHEN {text(k)} THEN {text(v)}" for k, v in vocab.LABEL_GROUPS.items())
    grouped = f"list_transform({column}, lambda x: CASE x {cases} ELSE x END)"
    return unique(grouped)


def category(column: str) -> str:
    def holds(name: str) -> str:
        return f"list_contains({column}, '{name}')"

    return (
        f"CASE WHEN {holds('DOC_SEARCH')} THEN 'DOC_SEARCH'"
        f" WHEN {holds('FUNCTION_CALLING')} THEN 'FUNCTION_CALLING'"
        f" WHEN {holds('REMINDER')} OR {holds('MEETING')} THEN 'REMINDER' ELSE 'OTHER' END"
    )


def joined(column: str, by: str = ", ") -> str:
    return f"coalesce(array_to_string({column}, {text(by)}), '')"


def six(x: str) -> str:
    return f"floor(({x}) * 1000000::DOUBLE + 0.5::DOUBLE) / 1000000::DOUBLE"


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


# --- detector flags ----------------------------------------------------------------

def _command(name: str) -> str:
    tests = (
        f"({rx('l', P.command(m, name))} AND NOT {rx('l', P.command_in_path(m, name))})"
        for m in vocab.COMMAND_MARKS
    )
    return "(" + " OR ".join(tests) + ")"


_ENDS = " OR ".join(rx("s", P.question_end(e)) for e in vocab.QUESTION_ENDINGS)
_STARTS = " OR ".join(
    f"s = {text(w)} OR starts_with(s, {text(w + ' ')})" for w in vocab.QUESTION_STARTS
)
_SHORT = rx("s", P.SHORT_DEFINITION)
_NAMED = rx("l", P.assistant_name(ASSISTANT))

FLAGS = {
    **{f"syntax_{c}": _command(c) for c in vocab.COMMANDS},
    "syntax_reminder":
        f"({has('l', [t for t in vocab.REMINDER_TERMS if ' ' in t])}"
        f" OR {rx('l', P.whole([t for t in vocab.REMINDER_TERMS if ' ' not in t]))})",
    "time_regex": any_rx("l", P.time_patterns("vietnamese")),
    "time_keyword": f"({has('l', vocab.TIME_KEYWORDS['vietnamese'])})",
    "time_indicator": f"({has('t', vocab.TIME_INDICATORS['vietnamese'])})",
    "documents_nouns": f"({has('l', vocab.DOC_NOUNS)})",
    "documents_verbs": f"({has('l', vocab.DOC_VERBS)})",
    "documents_start": f"({_STARTS})",
    "documents_closing": f"(({_ENDS} OR {_SHORT}) AND NOT {_NAMED})",
    "person_self":
        f"({has('l', P.SELF_NEEDLES)} OR {rx('l', P.whole(P.SELF_WORDS))}"
        f" OR {rx('l', P.SELF_RELATION)})",
    "person_user_id": rx("q", P.USER_ID),
    "person_user_name": "coalesce(named, false)",
    "person_phone": rx("q", P.PHONE),
    "person_name": "false",
    "location_location": "(place IS NOT NULL)",
    "quantity_keyword": rx("l", P.whole(vocab.QUANTITY_TERMS)),
    "quantity_comparative": rx("l", P.whole(vocab.COMPARATIVES)),
    "quantity_regex": any_rx("l", P.QUANTITY_FORMS),
    "assistant_address":
        f"({_NAMED} OR {rx('l', P.whole(vocab.SECOND_PERSON))} OR {rx('l', P.whole([P.COMRADE]))})",
}


def _weighted(parts: dict[str, float]) -> str:
    return "(" + " + ".join(
        f"CASE WHEN {f} THEN {w}::DOUBLE ELSE 0::DOUBLE END" for f, w in parts.items()
    ) + ")"


def _share(all_flags, parts: dict[str, float]) -> str:
    total = _weighted({f: 1.0 for f in all_flags})
    return f"CASE WHEN {total} > 0 THEN {_weighted(parts)} / {total} ELSE 0::DOUBLE END"


def _fired(flags) -> str:
    return f"CASE WHEN {' OR '.join(flags)} THEN 1::DOUBLE ELSE 0::DOUBLE END"


_T = ("time_regex", "time_keyword", "time_indicator")
_P = ("person_self", "person_user_id", "person_user_name", "person_phone", "person_name")
_Q = ("quantity_keyword", "quantity_comparative", "quantity_regex")

# every detector's share of every slot it reaches
SLOTS = {
    "syntax": {7: _fired([f"syntax_{c}" for c in (*vocab.COMMANDS, "reminder")])},
    "time": {
        1: _share(_T, {"time_indicator": 0.4}),
        5: _share(_T, {"time_regex": 0.8, "time_keyword": 0.7, "time_indicator": 0.6}),
        7: _share(_T, {"time_regex": 0.2, "time_keyword": 0.3}),
    },
    "documents": {1: _fired([f"documents_{f}" for f in ("nouns", "verbs", "start", "closing")])},
    "person": {
        6: _share(_P, dict(zip(_P, (0.2, 0.9, 0.9, 0.7, 0.5)))),
        7: _share(_P, dict(zip(_P, (0.8, 0.1, 0.1, 0.3, 0.5)))),
    },
    "location": {
        i: f"CASE WHEN location_location THEN {w}::DOUBLE ELSE 0::DOUBLE END"
        for i, w in ((1, 0.2), (3, 0.6), (4, 0.2))
    },
    "quantity": {0: _share(_Q, {f: 0.8 for f in _Q}), 1: _share(_Q, {f: 0.2 for f in _Q})},
    "assistant": {2: _fired(["assistant_address"])},
}


def vote(i: int) -> str:
    parts = [slots[i] for slots in SLOTS.values() if i in slots]
    return six(" + ".join(parts) if parts else "0::DOUBLE")


_VOTED = "[" + ", ".join(
    f"{{'rank': -vote_{i}, 'label': {text(label)}}}" for i, label in enumerate(vocab.LABELS)
) + "]"

_STOP = " ".join(
    f"WHEN lang = '{code}' AND lower(tok) IN ({items(ws)}) THEN false"
    for code, ws in vocab.STOP_WORDS.items()
)


def _broken() -> str:
    return "(query = '' OR knowledge_domain = '' OR len(workers_list) = 0)"


def _typed(source: str) -> str:
    return (
        "SELECT query_id, query, knowledge_domain, workers_list,"
        f" {joined('workers_list')} AS workers FROM (SELECT query_id, query, knowledge_domain,"
        f" list_filter(list_transform(string_split(worker, ','), lambda x: {strip('x')}),"
        f" lambda x: x <> '') AS workers_list FROM {source})"
    )


_TAG = (
    "CASE (query_id + pos) % 7 WHEN 0 THEN 'B-PER' WHEN 1 THEN 'I-PER' WHEN 4 THEN 'B-LOC'"
    " ELSE 'O' END"
)

# name -> (tables it reads, body)
TABLES: dict[str, tuple[tuple[str, ...], str]] = {
    "corpus": ((), f"SELECT {', '.join(projection(CORPUS))} FROM events"),
    "dirty": (("corpus",), f"SELECT {', '.join(projection(DIRTY))} FROM corpus"),
    "present": (("dirty",), "SELECT * FROM dirty WHERE query IS NOT NULL"
                            " OR knowledge_domain IS NOT NULL OR worker IS NOT NULL"),
    "filled": (("present",), "SELECT query_id, " + ", ".join(
        f"{strip(f'''coalesce({c}, '')''')} AS {c}" for c in ("query", "knowledge_domain", "worker")
    ) + " FROM present"),
    "clean": (("filled",), "SELECT * FROM filled"
                           " WHERE query <> '' OR knowledge_domain <> '' OR worker <> ''"),
    "typed": (("clean",), _typed("clean")),
    "records": (("typed",), f"SELECT * FROM typed WHERE NOT {_broken()}"),
    "requests": (("corpus",), _typed("corpus")),
    "batches": (("records",), "SELECT *, (row_number() OVER (ORDER BY query_id) - 1) // 100"
                              " AS batch_id FROM records"),
    "names": ((), "SELECT DISTINCT name, " + norm("name") + " AS name_norm FROM ("
                  "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region)"
                  " WHERE name IS NOT NULL AND name <> ''"
                  " AND lower(name) NOT IN ('nan', 'none', 'null')"),
    "views": (("corpus",),
              "SELECT query_id, query, query AS q, lower(query) AS l,"
              f" {strip('lower(query)')} AS s, {tidy('lower(query)')} AS t FROM corpus"),
    "spoken": (("views",), "SELECT query_id, "
               f"{gate('t', 'd')} AS lang, {tokens('t')} AS toks"
               f" FROM (SELECT query_id, t, {language('t')} AS d FROM views)"),
    "tops": (("spoken",),
             "SELECT query_id, tok, row_number() OVER (PARTITION BY query_id"
             " ORDER BY n DESC, first) AS r FROM (SELECT query_id, lower(tok) AS tok,"
             " count(*) AS n, min(pos) AS first FROM (SELECT query_id, lang, unnest(toks) AS tok,"
             " generate_subscripts(toks, 1) AS pos FROM spoken)"
             f" WHERE CASE {_STOP} ELSE true END AND length(lower(tok)) > 2"
             " GROUP BY query_id, lower(tok))"),
    "user_names": (("tops",), "SELECT query_id, bool_or(" + rx("tok", P.USERNAME)
                   + ") AS named FROM tops GROUP BY query_id"),
    "grams": (("corpus",),
              "SELECT query_id, n, i, " + norm(
                  "array_to_string(list_slice(w, i, i + n - 1), ' ')"
              ) + " AS gram FROM (SELECT query_id, w, n, unnest(range(1, len(w) - n + 2)) AS i"
              " FROM (SELECT query_id, w, unnest(range(1, least(6, len(w)) + 1)) AS n"
              f" FROM (SELECT query_id, {words('query')} AS w FROM corpus)))"),
    "places": (("grams", "names"),
               "SELECT query_id, gram AS place, n AS n_tokens, i - 1 AS position"
               " FROM grams WHERE gram IN (SELECT name_norm FROM names)"
               " QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, i) = 1"),
    "flags": (("views", "user_names", "places"),
              "SELECT query_id, query, " + ", ".join(f"{e} AS {n}" for n, e in FLAGS.items())
              + " FROM views LEFT JOIN user_names USING (query_id)"
              " LEFT JOIN places USING (query_id)"),
    "votes": (("flags",), "SELECT query_id, query, "
              + ", ".join(f"{vote(i)} AS vote_{i}" for i in range(8)) + " FROM flags"),
    "ranked": (("votes",),
               "SELECT query_id, query, list_transform(k, lambda x: x.label) AS labels,"
               " list_transform(k, lambda x: 0::DOUBLE - x.rank) AS votes FROM ("
               f"SELECT query_id, query, list_sort({_VOTED}) AS k FROM votes)"),
    "tag_rows": (("corpus",),
                 f"SELECT query_id, pos, token, {_TAG} AS tag FROM (SELECT query_id,"
                 " unnest(k) AS token, generate_subscripts(k, 1) - 1 AS pos"
                 f" FROM (SELECT query_id, {tokens('query')} AS k FROM corpus))"),
    # a token belongs to the last B at or before it when no O lies between
    "span_rows": (("tag_rows",),
                  "SELECT * FROM (SELECT query_id, pos, token, tag,"
                  " max(CASE WHEN tag LIKE 'B-%' THEN pos END) OVER w AS b,"
                  " max(CASE WHEN tag = 'O' THEN pos END) OVER w AS o,"
                  " count(CASE WHEN tag LIKE 'B-%' THEN 1 END) OVER w AS span FROM tag_rows"
                  " WINDOW w AS (PARTITION BY query_id ORDER BY pos))"
                  " WHERE b IS NOT NULL AND (o IS NULL OR o < b) AND tag <> 'O'"),
    "spans": (("span_rows",),
              "SELECT query_id, span, string_agg(token, ' ' ORDER BY pos) AS text,"
              " arg_min(tag, pos)[3:] AS label, arg_min(token, pos) AS head,"
              " count(*) AS n FROM span_rows GROUP BY query_id, span"),
    "predictions": (("ranked", "votes"), ""),   # filled in below
}

_CUT = "list_slice({}, 1, 2)"
_VECTOR = "[" + ", ".join(
    f"{{'rank': -vote_{i}, 'slot': {i}, 'label': {text(n)}}}"
    for i, n in enumerate(vocab.RESPONSE_VECTOR_LABELS)
) + "]"
_BEST = f"list_filter(list_slice(list_sort({_VECTOR}), 1, 2), lambda x: x.rank < 0)"
_RAW = (
    f"CASE query_id % 4 WHEN 0 THEN {_CUT.format('labels')} WHEN 1 THEN {_CUT.format('labels')}"
    f" WHEN 2 THEN list_slice(labels, 1, 1) ELSE list_transform({_BEST}, lambda x: x.label) END"
)
_SCORES = (
    f"CASE query_id % 4 WHEN 0 THEN {_CUT.format('votes')} WHEN 3"
    f" THEN list_transform({_BEST}, lambda x: 0::DOUBLE - x.rank) ELSE []::DOUBLE[] END"
)
TABLES["predictions"] = (("ranked", "votes"), (
    f"SELECT query_id, {mapped('raw')} AS predicted, scores FROM (SELECT query_id,"
    f" {_RAW} AS raw, {_SCORES} AS scores FROM ranked JOIN votes USING (query_id, query)"
    " WHERE query_id % 50 <> 0)"
))
TABLES["pairs"] = (("requests", "predictions"), (
    "SELECT r.query_id, r.query, r.knowledge_domain, r.workers_list AS expected,"
    " coalesce(p.predicted, []::VARCHAR[]) AS predicted,"
    " coalesce(p.scores, []::DOUBLE[]) AS scores,"
    " CASE WHEN p.query_id IS NULL THEN 'no prediction' END AS error,"
    " p.query_id IS NOT NULL AS success"
    " FROM requests r LEFT JOIN predictions p USING (query_id)"
))
TABLES["matches"] = (("pairs",), (
    f"SELECT *, {category('expected_mapped')} AS category,"
    " coalesce(predicted[1] = expected_mapped[1], false) AS exact_match,"
    " coalesce(list_contains(list_slice(predicted, 1, 2), expected_mapped[1]), false)"
    f" AS partial_match FROM (SELECT *, {mapped('expected')} AS expected_mapped FROM pairs)"
))
TABLES["label_counts"] = (("matches",), (
    "SELECT label, count(*) FILTER (e AND p) AS true_positive,"
    " count(*) FILTER (NOT e AND p) AS false_positive,"
    " count(*) FILTER (e AND NOT p) AS false_negative FROM ("
    "SELECT label, list_contains(expected_mapped, label) AS e, list_contains(predicted, label) AS p"
    " FROM (SELECT expected_mapped, predicted,"
    " unnest(list_distinct(list_concat(expected_mapped, predicted))) AS label"
    " FROM matches WHERE success)) GROUP BY label"
))
TABLES["label_scores"] = (("label_counts",), (
    "SELECT *, CASE WHEN precision + recall > 0 THEN 2 * (precision * recall)"
    " / (precision + recall) ELSE 0 END AS f1 FROM (SELECT *,"
    " CASE WHEN true_positive + false_positive > 0 THEN true_positive"
    " / (true_positive + false_positive) ELSE 0 END AS precision,"
    " CASE WHEN true_positive + false_negative > 0 THEN true_positive"
    " / (true_positive + false_negative) ELSE 0 END AS recall FROM label_counts)"
))
TABLES["analysis"] = (("records",), (
    "SELECT *, " + tokens("c") + " AS toks, " + gate("c", "d") + " AS lang FROM ("
    "SELECT *, " + language("c") + " AS d FROM (SELECT *, " + tidy("query") + " AS c FROM records))"
))
TABLES["analysis_keywords"] = (("analysis",), (
    "SELECT query_id, list(tok ORDER BY r) AS keywords FROM (SELECT query_id, tok, row_number()"
    " OVER (PARTITION BY query_id ORDER BY n DESC, first) AS r FROM (SELECT query_id,"
    " lower(tok) AS tok, count(*) AS n, min(pos) AS first FROM (SELECT query_id, lang,"
    " unnest(toks) AS tok, generate_subscripts(toks, 1) AS pos FROM analysis)"
    f" WHERE CASE {_STOP} ELSE true END AND length(lower(tok)) > 2"
    " GROUP BY query_id, lower(tok))) WHERE r <= 10 GROUP BY query_id"
))


def topics(column: str) -> str:
    cases = ", ".join(
        f"CASE WHEN {has(column, ws)} THEN '{n}' END" for n, ws in vocab.TOPICS.items()
    )
    return f"list_slice(list_filter([{cases}], lambda x: x IS NOT NULL), 1, 3)"


def grammar(column: str, lang: str) -> str:
    checks = [
        (f"contains({column}, '  ')", vocab.GRAMMAR_SPACES),
        (f"contains({column}, '..')", vocab.GRAMMAR_PERIODS),
        (f"{lang} = 'en' AND {rx(column, P.EN_AFTER_I)}", vocab.GRAMMAR_EN_I),
        (f"{lang} = 'en' AND {rx(column, P.EN_SENTENCE_START)}", vocab.GRAMMAR_EN_START),
        (f"{lang} = 'vi' AND {rx(column, P.VI_SENTENCE_START)}", vocab.GRAMMAR_VI_START),
    ]
    cases = ", ".join(f"CASE WHEN {c} THEN {text(m)} END" for c, m in checks)
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


TABLES["analyzed"] = (("analysis", "analysis_keywords"), (
    "SELECT a.*, coalesce(k.keywords, []::VARCHAR[]) AS keywords,"
    f" {topics('lower(c)')} AS topics, {grammar('c', 'lang')} AS grammar_issues,"
    " CASE WHEN len(toks) = 0 THEN 0::DOUBLE ELSE list_sum(list_transform(toks,"
    " lambda x: length(x)))::DOUBLE / len(toks) END AS avg_word_length"
    " FROM analysis a LEFT JOIN analysis_keywords k USING (query_id)"
))


def sql(body: str, *needs: str) -> str:
    """``body`` with the common tables it needs, in dependency order."""
    order: list[str] = []

    def add(name: str) -> None:
        for other in TABLES[name][0]:
            add(other)
        if name not in order:
            order.append(name)

    for name in needs:
        add(name)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({TABLES[n][1]})" for n in order) + "\n" + body
