"""Text functions: SQL expression text in, SQL expression text out.

Every function takes Spark SQL expressions (usually a column name) and returns
one, so a projection with hundreds of vocabulary terms is a single parse and
stays inside Catalyst. No function shuffles. Array work uses higher-order
functions over one row's tokens and is (near-)linear in the text length, so
whole documents of any size are processed without exploding them into rows.
"""

from __future__ import annotations

from collections.abc import Iterable

from . import patterns as P
from . import vocab

STRINGS = "array<string>"
ENTITY = "struct<text:string,label:string,start:int,end:int>"
ENTITIES = f"array<{ENTITY}>"
RANKED = "array<struct<rank:int,pos:int,token:string>>"
GRAMS = "array<struct<n:int,pos:int,text:string>>"


def quote(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def listed(values: Iterable[str]) -> str:
    return ", ".join(quote(v) for v in values)


def let(name: str, value: str, body: str) -> str:
    """Evaluate ``value`` once per row and use it as ``name`` in ``body``."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def empty(ddl: str = STRINGS) -> str:
    return f"cast(array() as {ddl})"


def matches(text: str, pattern: str) -> str:
    return f"rlike({text}, {quote(pattern)})"


def contains_any(text: str, terms: Iterable[str]) -> str:
    """True when any term occurs as a substring.

    Terms with letters that a text has none of are not looked for: a text in ASCII, or without
    letters beyond Latin-1, is settled by one scan for most of the vocabularies.
    """
    plain, latin, wide, others = P.by_letters(P.distinct_needles(terms))
    tests = [_covered(text, plain)] if plain else []
    beyond = [_covered(text, group) for group in (latin, others) if group]
    if wide:
        beyond.append(f"({matches(text, P.WIDE)} and {_covered(text, wide)})")
    if beyond:
        tests.append(f"(octet_length({text}) <> length({text}) and {_either(beyond)})")
    return _either(tests)


def _covered(text: str, needles: list[str]) -> str:
    """When a few words cover all the terms they are tested first, so that most
    texts are settled by those few scans.
    """
    cover = P.distinct_needles(P.shared_words(needles))
    found = _either(f"contains({text}, {quote(t)})" for t in needles)
    if 2 * len(cover) > len(needles):
        return found
    return f"({_either(f'contains({text}, {quote(w)})' for w in cover)} and {found})"


def _either(tests: Iterable[str]) -> str:
    return "(" + " or ".join(tests) + ")"


def has_phrase(text: str, terms: Iterable[str]) -> str:
    """True when any term occurs as whole words.

    The substring test is a cheap necessary condition, so most texts never
    reach the regular expression.
    """
    terms = P.distinct_phrases(terms)
    return f"({contains_any(text, terms)} and {matches(text, P.whole(terms))})"


def has_word(words: str, terms: Iterable[str]) -> str:
    """True when any of the single-word terms is one of the text's words."""
    return f"arrays_overlap({words}, array({listed(dict.fromkeys(terms))}))"


def terms_found(text: str, terms: Iterable[str]) -> str:
    """The terms that occur in the text, in vocabulary order."""
    return f"filter(array({listed(terms)}), t -> contains({text}, t))"


def messages(checks: Iterable[tuple[str, str]]) -> str:
    """The messages whose condition holds, in order."""
    cases = ", ".join(f"case when {c} then {quote(m)} end" for c, m in checks)
    return f"array_compact(array({cases}))"


# --- T1-T6: normalising and tokenising ---------------------------------------

def trim_space(text: str) -> str:
    """Strip Unicode white space at both ends."""
    return f"trim(both {quote(P.SPACE_CHARACTERS)} from {text})"


def collapse_space(text: str) -> str:
    return f"trim(regexp_replace({text}, {quote(P.runs(P.SPACE))}, ' '))"


def strip_accents(text: str) -> str:
    composed, base = P.accent_map()
    return f"regexp_replace(translate({text}, {quote(composed)}, {quote(base)}), {quote(P.MARKS)}, '')"


def normalize(text: str) -> str:
    """Lower-case, separators to spaces, no combining marks, single spaces."""
    separated = f"regexp_replace(lower({text}), {quote(P.SEPARATORS)}, ' ')"
    return f"coalesce({collapse_space(strip_accents(separated))}, '')"


def clip(text: str, size: int = vocab.MAX_TEXT_LENGTH) -> str:
    return f"substring({text}, 1, {size})"


def preview(text: str, size: int) -> str:
    return (
        f"case when length({text}) > {size}"
        f" then concat(substring({text}, 1, {size}), '...') else {text} end"
    )


def tokens(text: str) -> str:
    """Split on white space."""
    return f"array_remove(split({text}, {quote(P.SPACES)}), '')"


def words(text: str) -> str:
    """Lower-cased runs of word characters."""
    return f"regexp_extract_all(lower({text}), {quote(f'({P.WORD}+)')}, 1)"


def ngrams(parts: str, longest: int = vocab.MAX_NGRAM) -> str:
    """All n-grams, longest first and left to right, as ``struct<n,pos,text>``."""
    gram = "named_struct('n', n, 'pos', i, 'text', array_join(slice(w, i + 1, n), ' '))"
    of_length = f"transform(sequence(0, size(w) - n), i -> {gram})"
    lengths = f"sequence(least({longest}, size(w)), 1, -1)"
    grams = f"flatten(transform({lengths}, n -> {of_length}))"
    return let("w", parts, f"case when size(w) > 0 then {grams} else {empty(GRAMS)} end")


def word_list(text_lower: str) -> str:
    """Runs of word characters, in order (with empty strings at odd ends)."""
    return f"split({spaced_words(text_lower)}, ' ')"


def spaced_words(text_lower: str) -> str:
    """A space for each run of other characters."""
    return f"regexp_replace({text_lower}, {quote(P.runs(P.NOT_WORD.replace('[^', '[^a-z0-9')))}, ' ')"


def place_words(text: str, spaced: str | None = None) -> str:
    """The text's words without accents, separated by single spaces.

    Underscores stay: they belong to a word here and become spaces only inside
    a candidate name. ``spaced`` is ``spaced_words`` of the lower-cased text, where it is at hand.
    """
    composed, base = P.accent_map()
    unmarked = f"translate(sw, {quote(composed)}, {quote(base)})"
    if spaced is None:
        spaced = spaced_words(f"lower({text})")
    # a text in ASCII has no accents
    return let("sw", spaced, f"trim(if(octet_length(sw) = length(sw), sw, {unmarked}))")


def place_candidates(text: str, longest: int) -> str:
    """n-grams of the text in gazetteer spelling (``struct<n,pos,text>``)."""
    parts = f"array_remove(split({place_words(text)}, ' '), '')"
    spelled = collapse_space("translate(g.text, '_', ' ')")
    return (
        f"transform({ngrams(parts, longest)},"
        f" g -> named_struct('n', g.n, 'pos', g.pos, 'text', {spelled}))"
    )


# --- T7, T9-T12: measures, keywords, topics, grammar ---------------------------

def mean_length(parts: str) -> str:
    total = f"aggregate({parts}, 0, (acc, t) -> acc + length(t))"
    return f"({total} / greatest(size({parts}), 1))"


def remove_stop_words(parts: str, language: str) -> str:
    """Drop the language's stop words; other languages keep every token."""
    cases = " ".join(
        f"when {quote(code)} then filter({parts}, t -> lower(t) not in ({listed(terms)}))"
        for code, terms in vocab.STOP_WORDS.items()
    )
    return f"case {language} {cases} else {parts} end"


def token_counts(parts: str) -> str:
    """``array<struct<rank,pos,token>>`` ordered by count (desc), first position.

    ``rank`` is minus the count. One sort brings equal tokens together, the run
    starts give the counts, a second sort ranks them: n log n, no explode.
    """
    starts = (
        "filter(sequence(0, size(p) - 1),"
        " i -> i = 0 or get(p, i).token <> get(p, i - 1).token)"
    )
    run = (
        "named_struct('rank', s - coalesce(get(st, k + 1), size(p)),"
        " 'pos', get(p, s).pos, 'token', get(p, s).token)"
    )
    counted = f"sort_array({let('st', starts, f'transform(st, (s, k) -> {run})')})"
    pairs = "sort_array(transform(kept, (t, i) -> named_struct('token', t, 'pos', i)))"
    return let(
        "kept", parts,
        f"case when size(kept) > 0 then {let('p', pairs, counted)} else {empty(RANKED)} end",
    )


def keyword_tokens(parts: str, language: str) -> str:
    kept = remove_stop_words(parts, language)
    return (
        f"filter(transform({kept}, t -> lower(t)),"
        f" t -> length(t) >= {vocab.KEYWORD_MIN_LENGTH})"
    )


def keywords(parts: str, language: str, limit: int = vocab.KEYWORD_LIMIT) -> str:
    """Most frequent tokens without stop words; ties by first appearance."""
    top = f"slice({token_counts(keyword_tokens(parts, language))}, 1, {limit})"
    return f"transform({top}, r -> r.token)"


def topics(text_lower: str, limit: int = vocab.TOPIC_LIMIT) -> str:
    found = messages(
        (contains_any(text_lower, terms), name) for name, terms in vocab.TOPICS.items()
    )
    return f"slice({found}, 1, {limit})"


def grammar_issues(text: str, language: str) -> str:
    return messages([
        (f"contains({text}, '  ')", vocab.GRAMMAR_SPACES),
        (f"contains({text}, '..')", vocab.GRAMMAR_PERIODS),
        (f"{language} = 'en' and {matches(text, P.EN_AFTER_I)}", vocab.GRAMMAR_EN_I),
        (f"{language} = 'en' and {matches(text, P.EN_SENTENCE_START)}", vocab.GRAMMAR_EN_START),
        (f"{language} = 'vi' and {matches(text, P.VI_SENTENCE_START)}", vocab.GRAMMAR_VI_START),
    ])


# --- T13-T15: language ---------------------------------------------------------

def language_hits(parts: str) -> dict[str, str]:
    """How many of the tokens are function words of each language."""
    return {
        code: f"size(filter({parts}, t -> t in ({listed(terms)})))"
        for code, terms in vocab.LANGUAGE_WORDS.items()
    }


def best_language(hits: dict[str, str]) -> str:
    """Language with most hits; ties by profile order; no hit is ``unknown``."""
    ranked = ", ".join(
        f"named_struct('hits', {n}, 'tie', {-i}, 'code', {quote(code)})"
        for i, (code, n) in enumerate(hits.items())
    )
    return let(
        "best", f"greatest({ranked})",
        "case when best.hits > 0 then best.code else 'unknown' end",
    )


def detect_language(text: str) -> str:
    pick = let("lw", words(text), best_language(language_hits("lw")))
    return f"coalesce({pick}, 'unknown')"


def gate_language(text: str, detected: str) -> str:
    """Texts under three characters and languages other than en/vi: unknown."""
    return (
        f"case when {text} is null or length({trim_space(text)}) < {vocab.MIN_LANGUAGE_LENGTH}"
        f" then 'unknown' when {detected} in ({listed(vocab.GATED_LANGUAGES)})"
        f" then {detected} else 'unknown' end"
    )


def language_of(text: str) -> str:
    return let("dl", detect_language(text), gate_language(text, "dl"))


def has_vietnamese_words(text_lower: str) -> str:
    return contains_any(text_lower, vocab.VIETNAMESE_INDICATORS)


# --- T8: sentences ----------------------------------------------------------------

def sentences(text: str) -> str:
    """The sentences of a text, in order and trimmed; none of a null or wordless text.

    A run of stops ends a sentence where white space or the text's end follows, with
    the quotes and brackets that close behind it; full-width stops end one anywhere, and
    so does an empty line. Dots of short forms, initials, numbered lines, decimals and
    addresses do not. A piece without a letter or digit is no sentence.
    """
    clean = f"replace(replace(coalesce({text}, ''), {quote(P.GUARD)}, ' '), {quote(P.END)}, ' ')"
    before = f"right(p, {P.BEFORE_DOT})"
    kept = (
        f"{matches(before, P.UNENDED)} or (i = 0 and {matches(before, P.UNENDED_FIRST)})"
        f" or (i > 0 and {matches('p', P.UNENDED_LATER)})"
    )
    # only what stands right before a dot is looked at, not every word
    dots = f"if(i = size(k) - 1, '', if({kept}, {quote(P.GUARD)}, '.'))"
    marked = let("k", f"split({clean}, {quote('[.]')})", f"array_join(transform(k, (p, i) -> concat(p, {dots})), '')")
    ended = f"regexp_replace({marked}, {quote(P.SENTENCE_END)}, {quote('$1$3' + P.END)})"
    pieces = f"split(replace({ended}, {quote(P.GUARD)}, '.'), {quote(P.END)})"
    return f"transform(filter({pieces}, s -> {matches('s', P.WORD)}), s -> {trim_space('s')})"


def sentence_count(text: str) -> str:
    return f"size({sentences(text)})"


# --- T16-T21, T28: annotator outputs ---------------------------------------------

def scores(compound, pos, neu, neg) -> str:
    return (
        f"named_struct('compound', cast({compound} as double), 'pos', cast({pos} as double),"
        f" 'neu', cast({neu} as double), 'neg', cast({neg} as double))"
    )


def neutral_sentiment() -> str:
    return scores(0, 0, 1, 0)


def sentiment_from_class(name: str) -> str:
    return (
        f"case {name} when 'positive' then {scores(0.5, 0.5, 0.5, 0)}"
        f" when 'negative' then {scores(-0.5, 0, 0.5, 0.5)} else {neutral_sentiment()} end"
    )


def sentiment_from_polarity(p: str) -> str:
    return scores(p, f"greatest(0D, {p})", f"1 - abs({p})", f"greatest(0D, -({p}))")


def sentiment_class(compound: str) -> str:
    return (
        f"case when {compound} > 0.1D then 'positive'"
        f" when {compound} < -0.1D then 'negative' else 'neutral' end"
    )


def default_tags(parts: str) -> str:
    return f"transform({parts}, t -> named_struct('token', t, 'tag', 'UNK'))"


def default_dependencies(parts: str, self_head: bool = True) -> str:
    head = "t" if self_head else "''"
    return (
        f"transform({parts}, t -> named_struct('text', t, 'head', {head},"
        " 'dep', 'UNK', 'pos', 'UNK'))"
    )


def resolve_heads(parsed: str, tags: str) -> str:
    """Head positions (1-based, 0 is the root) to head texts.

    ``parsed`` is ``array<struct<text,head:int,dep>>``. Roots and positions out
    of range point at the token itself; tags are used only when they align.
    """
    head = "coalesce(case when d.head > 0 then get(deps, d.head - 1).text end, d.text)"
    tag = "case when size(tg) = size(deps) then get(tg, i) else 'UNK' end"
    row = f"named_struct('text', d.text, 'head', {head}, 'dep', d.dep, 'pos', {tag})"
    return let("deps", parsed, let("tg", tags, f"transform(deps, (d, i) -> {row})"))


def locate_entity(text: str, entity: str, label: str) -> str:
    start = f"instr({text}, {entity}) - 1"
    return (
        f"named_struct('text', {entity}, 'label', {label}, 'start', {start},"
        f" 'end', {start} + length({entity}))"
    )


def display_phone(text: str) -> str:
    """First phone number, without spaces and with ``+84`` shown as ``0``."""
    raw = f"regexp_replace(regexp_extract({text}, {quote(P.PHONE)}, 2), {quote(P.SPACES)}, '')"
    return f"regexp_replace({raw}, {quote('^[+]84')}, '0')"
