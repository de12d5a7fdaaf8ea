"""The seven rule-based detectors.

A detector is a set of named boolean flags over one text column plus a weight
per flag and label slot. Flags are SQL expressions, so the same detector runs in
batch and streaming plans and never leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from ..functions import patterns as P, text as T, vocab
from ..functions.vectors import Vector, Weights, weighted_vector
from ..functions.vocab import ASSISTANT, DOCS, EMPLOYEE, FUNCTION, REGION, REMINDER, TIME, WEB

Flags = dict[str, str]


@dataclass(frozen=True)
class TextViews:
    """SQL expressions of the forms of one text that the detectors look at."""

    raw: str
    lower: str
    stripped: str              # lower, white space trimmed at the ends
    tidy: str                  # lower, white space collapsed
    words: str                 # lower, the list of its words
    entities: str | None = None
    location: str | None = None    # boolean: a gazetteer name occurs

    @staticmethod
    def of(text: str, entities: str | None = None, location: str | None = None) -> TextViews:
        lower = f"lower({text})"
        return TextViews(
            text, lower, T.trim_space(lower), T.collapse_space(lower), T.word_list(lower),
            entities, location,
        )


@dataclass(frozen=True)
class Detector:
    name: str
    flags: Callable[[TextViews], Flags]
    weights: Weights

    def vector(self, flags: Flags) -> Vector:
        return weighted_vector(flags, self.weights)


def _or(tests) -> str:
    return "(" + " or ".join(tests) + ")"


# --- D1: commands and reminders ---------------------------------------------

def command_flags(v: TextViews) -> Flags:
    """One flag per command word, written with either slash."""
    def written(mark: str, name: str) -> str:
        return (
            f"(contains({v.lower}, {T.quote(mark + name)})"
            f" and {T.matches(v.lower, P.command(mark, name))}"
            f" and not {T.matches(v.lower, P.command_in_path(mark, name))})"
        )

    return {
        name: _or(written(mark, name) for mark in vocab.COMMAND_MARKS)
        for name in vocab.COMMANDS
    }


def reminder_words(v: TextViews) -> str:
    phrases = T.contains_any(v.lower, P.REMINDER_PHRASES)
    return f"({phrases} or {T.has_word(v.words, P.REMINDER_WORDS)})"


def syntax_flags(v: TextViews) -> Flags:
    return {**command_flags(v), "reminder": reminder_words(v)}


# --- D2: time -------------------------------------------------------------------

def time_flags(v: TextViews, language: str = "vietnamese") -> Flags:
    first, *others = P.time_patterns(language)
    named = ("thứ",) if language == "vietnamese" else (*vocab.MONTHS_EN, *vocab.WEEKDAYS_EN)
    hint = f"({T.matches(v.lower, P.CLOCK_HINT)} or {T.contains_any(v.lower, named)})"
    forms = [f"({hint} and {T.matches(v.lower, first)})"]
    forms += [f"({T.contains_any(v.lower, ['ngày'])} and {T.matches(v.lower, p)})" for p in others]
    terms = vocab.TIME_INDICATORS[language]
    # the words of a term are there however they are spaced
    cover = T.contains_any(v.lower, P.shared_words(P.distinct_needles(terms)))
    indicator = T.let("td", v.tidy, T.contains_any("td", terms))
    return {
        "regex": _or(forms),
        "keyword": T.contains_any(v.lower, vocab.TIME_KEYWORDS[language]),
        "indicator": f"({cover} and {indicator})",
    }


def time_flags_by_language(v: TextViews, language: str) -> Flags:
    """Vocabulary chosen per row: English for ``en``, Vietnamese for the rest."""
    english, other = time_flags(v, "english"), time_flags(v, "vietnamese")
    return {
        f: f"case when {language} = 'en' then {english[f]} else {other[f]} end" for f in other
    }


# --- D3: document search -----------------------------------------------------------

def doc_nouns(v: TextViews) -> str:
    return T.terms_found(v.lower, vocab.DOC_NOUNS)


def doc_verbs(v: TextViews) -> str:
    return T.terms_found(v.lower, vocab.DOC_VERBS)


def _starts_with(v: TextViews, term: str) -> str:
    return f"(startswith({v.stripped}, {T.quote(term + ' ')}) or {v.stripped} = {T.quote(term)})"


def question_start(v: TextViews) -> str:
    """The opening question word, or null."""
    cases = (f"when {_starts_with(v, t)} then {T.quote(t)}" for t in vocab.QUESTION_STARTS)
    return f"case {' '.join(cases)} end"


def question_end(v: TextViews) -> str:
    """The closing question phrase, or null."""
    cases = (
        f"when {T.matches(v.stripped, P.question_end(t))} then {T.quote(t)}"
        for t in vocab.QUESTION_ENDINGS
    )
    return f"case {' '.join(cases)} end"


def short_definition(v: TextViews) -> str:
    return T.has_phrase(v.stripped, vocab.SHORT_DEFINITIONS)


def names_assistant(v: TextViews, name: str) -> str:
    """The assistant's ``name``, a plain phrase whose words may be joined or spaced."""
    hint = f"contains({v.lower}, {T.quote(name.lower().split()[0])})"
    return f"({hint} and {T.matches(v.lower, P.assistant_name(name))})"


def doc_flags(v: TextViews, name: str) -> Flags:
    ends = T.matches(v.stripped, P.question_end(P.any_of(vocab.QUESTION_ENDINGS)))
    closing = f"({T.contains_any(v.stripped, vocab.QUESTION_ENDINGS)} and {ends})"
    return {
        "nouns": T.contains_any(v.lower, vocab.DOC_NOUNS),
        "verbs": T.contains_any(v.lower, vocab.DOC_VERBS),
        "start": _or(_starts_with(v, t) for t in vocab.QUESTION_STARTS),
        "closing": f"(({closing} or {short_definition(v)}) and not {names_assistant(v, name)})",
    }


# --- D4: people ---------------------------------------------------------------------

def person_name(entities: str) -> str:
    """``multiple`` or ``single`` word count of the first person entity."""
    label = "|".join(vocab.PERSON_LABEL_PARTS)
    people = f"filter({entities}, e -> {T.matches('upper(e.label)', label)})"
    words = T.tokens("coalesce(who.text, '')")
    return T.let(
        "who", f"get({people}, 0)",
        "case when who is null then null"
        f" when size({words}) < 2 then 'single' else 'multiple' end",
    )


def user_name(v: TextViews) -> str:
    """A token that can be a keyword is an encoded user name, wherever it stands.

    Tokens are worked out only when some part of the text has the right shape.
    """
    keys = T.keyword_tokens("tk", "lang")
    check = f"exists({keys}, k -> {T.matches('k', P.USERNAME)})"
    check = T.let("lang", T.language_of("td"), check)
    found = T.let("td", v.tidy, T.let("tk", T.tokens("td"), check))
    hint = f"{T.matches(v.lower, P.USERNAME_END)} and {T.matches(v.lower, P.USERNAME_HINT)}"
    return f"case when {hint} then {found} else false end"


def self_reference(v: TextViews) -> str:
    relation = T.matches(v.lower, P.SELF_RELATION)
    # a pattern that begins with a letter is tried faster than one that begins with an edge
    behind = f"{P.SPACE}+{P.any_of(vocab.RELATION_PRONOUNS)}"
    hint = _or(f"({T.contains_any(v.lower, [r])} and {T.matches(v.lower, r + behind)})" for r in vocab.RELATIONS)
    return (
        f"({T.contains_any(v.lower, P.SELF_NEEDLES)}"
        f" or {T.has_word(v.words, P.SELF_WORDS)}"
        f" or ({hint} and {relation}))"
    )


def user_id(v: TextViews) -> str:
    return f"({T.matches(v.raw, P.USER_ID_DIGITS)} and {T.matches(v.raw, P.USER_ID)})"


def phone(v: TextViews) -> str:
    return f"({T.matches(v.raw, P.PHONE_DIGITS)} and {T.matches(v.raw, P.PHONE)})"


def person_flags(v: TextViews) -> Flags:
    name = "false" if v.entities is None else f"{person_name(v.entities)} = 'multiple'"
    return {
        "self": self_reference(v),
        "user_id": user_id(v),
        "user_name": user_name(v),
        "phone": phone(v),
        "name": name,
    }


# --- D5: location -----------------------------------------------------------------

def location_flags(v: TextViews) -> Flags:
    return {"location": "false" if v.location is None else v.location}


# --- D6: quantities -----------------------------------------------------------------

def quantity_flags(v: TextViews) -> Flags:
    def term(terms: tuple[str, ...]) -> str:
        kept = P.distinct_phrases(terms)
        single = T.has_word(v.words, [t for t in kept if " " not in t])
        return f"({single} or {T.has_phrase(v.lower, [t for t in kept if ' ' in t])})"

    ranks = f"({T.contains_any(v.lower, vocab.RANK_WORDS)} and {T.matches(v.lower, P.RANK_HINT)})"
    hints = (
        f"({ranks} or {T.contains_any(v.lower, vocab.QUANTITY_PATTERN_TERMS)})",
        f"(contains({v.lower}, '%') and {T.matches(v.lower, P.PERCENT_HINT)})",
    )
    return {
        "keyword": term(vocab.QUANTITY_TERMS),
        "comparative": term(vocab.COMPARATIVES),
        "regex": _or(f"({h} and {T.matches(v.lower, p)})" for h, p in zip(hints, P.QUANTITY_FORMS)),
    }


# --- D7: assistant identity --------------------------------------------------------

def second_person(v: TextViews) -> str:
    return T.has_word(v.words, vocab.SECOND_PERSON)


def comrade(v: TextViews) -> str:
    """The address form occurs somewhere without a person's name right after it.

    Offsets come from splitting the text at the address form: the pieces and
    the matches alternate, so their lengths add up to each match's end.
    """
    anywhere = f"contains({v.lower}, {T.quote(vocab.COMRADE.split()[0])})"
    if v.entities is None:
        return f"({anywhere} and {T.matches(v.lower, P.whole([P.COMRADE]))})"

    def total(parts: str) -> str:
        return f"aggregate(slice({parts}, 1, k + 1), 0, (acc, x) -> acc + length(x))"

    before, after = "get(gaps, k)", "get(gaps, k + 1)"
    on_edges = (
        f"(k = 0 or {before} <> '') and (k + 1 = size(hits) or {after} <> '')"
        f" and not {T.matches(before, f'{P.WORD}$')} and not {T.matches(after, f'^{P.WORD}')}"
    )
    skipped = f"length(regexp_extract(substring(low, en + 1), {T.quote(P.COMRADE_GAP)}, 0))"
    named = (
        "exists(ents, e -> upper(e.label) in ('PER', 'PERSON')"
        " and e.start - at between 0 and 1)"
    )
    unnamed = T.let(
        "en", f"{total('gaps')} + {total('hits')}", T.let("at", f"en + {skipped}", f"not {named}")
    )
    some = f"exists(sequence(0, size(hits) - 1), k -> {on_edges} and {unnamed})"
    split = f"split(low, {T.quote(P.COMRADE)})"
    found = f"regexp_extract_all(low, {T.quote(f'({P.COMRADE})')}, 1)"
    entities = f"coalesce({v.entities}, {T.empty(T.ENTITIES)})"
    check = T.let("gaps", split, T.let("hits", found, some))
    check = T.let("low", v.lower, T.let("ents", entities, check))
    return f"case when {T.matches(v.lower, P.COMRADE)} then {check} else false end"


def simple_question(v: TextViews) -> str:
    count = f"size({T.tokens(v.stripped)})"
    return (
        f"({count} <= {vocab.SIMPLE_QUESTION_MAX_TOKENS}"
        f" and ({T.matches(v.stripped, P.SIMPLE_QUESTION)}"
        f" or (contains({v.stripped}, '?') and {count} <= {vocab.SHORT_QUESTION_MAX_TOKENS})))"
    )


def assistant_flags(
    v: TextViews,
    name: str,
    require_simple: bool = False,
) -> Flags:
    address = f"({names_assistant(v, name)} or {second_person(v)} or {comrade(v)})"
    return {"address": f"({address} and {simple_question(v)})" if require_simple else address}


# --- the default set ------------------------------------------------------------------

def default_detectors(
    assistant: str,
    language: str = "vietnamese",
    require_simple: bool = False,
) -> list[Detector]:
    """The seven detectors with their fixed weights (slot: weight per flag).

    ``assistant`` is the name the deployed assistant goes by.
    """
    if language not in vocab.TIME_KEYWORDS:
        raise ValueError(f"unsupported language: {language}")
    one = 1.0
    return [
        Detector("syntax", syntax_flags,
                 {f: {REMINDER: one} for f in (*vocab.COMMANDS, "reminder")}),
        Detector("time", lambda v: time_flags(v, language), {
            "regex": {TIME: 0.8, REMINDER: 0.2},
            "keyword": {TIME: 0.7, REMINDER: 0.3},
            "indicator": {TIME: 0.6, DOCS: 0.4},
        }),
        Detector("documents", lambda v: doc_flags(v, assistant),
                 {f: {DOCS: one} for f in ("nouns", "verbs", "start", "closing")}),
        Detector("person", person_flags, {
            "self": {EMPLOYEE: 0.2, REMINDER: 0.8},
            "user_id": {EMPLOYEE: 0.9, REMINDER: 0.1},
            "user_name": {EMPLOYEE: 0.9, REMINDER: 0.1},
            "phone": {EMPLOYEE: 0.7, REMINDER: 0.3},
            "name": {EMPLOYEE: 0.5, REMINDER: 0.5},
        }),
        Detector("location", location_flags,
                 {"location": {REGION: 0.6, WEB: 0.2, DOCS: 0.2}}),
        Detector("quantity", quantity_flags,
                 {f: {FUNCTION: 0.8, DOCS: 0.2} for f in ("keyword", "comparative", "regex")}),
        Detector("assistant", lambda v: assistant_flags(v, assistant, require_simple),
                 {"address": {ASSISTANT: one}}),
    ]


