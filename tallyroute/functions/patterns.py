"""Regular expressions that mean the same in Java and in RE2.

``\\b``, ``\\w`` and look-around differ between engines (and between JDKs) on
accented text, so boundaries are spelled out as neighbouring characters. That
is exact for "does it occur" questions, which is all the detectors ask.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from functools import cache

from . import vocab

WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"
DIGIT = r"\p{Nd}"
NOT_DIGIT = r"\P{Nd}"
SPACE = r"[\t-\r\x1c-\x20\x85\p{Z}]"

TRIM = f"^{SPACE}+|{SPACE}+$"
SPACE_CHARACTERS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
SPACES = f"{SPACE}+"
SEPARATORS = r"[_\-.,/\\]+"
MARKS = r"\p{Mn}+"


def any_of(parts: Iterable[str]) -> str:
    return "(" + "|".join(parts) + ")"


def whole(parts: Iterable[str]) -> str:
    """Any of ``parts`` with a non-word character (or an end) on both sides."""
    return f"(^|{NOT_WORD}){any_of(parts)}({NOT_WORD}|$)"


def spaced(term: str) -> str:
    """A phrase whose words may be separated by any run of white space."""
    return f"{SPACE}+".join(re.escape(word) for word in term.split(" "))


def distinct_needles(terms: Iterable[str]) -> list[str]:
    """Drop terms that contain another term: if they occur, so does the other."""
    terms = list(dict.fromkeys(terms))
    return [t for t in terms if not any(o != t and o in t for o in terms)]


def distinct_phrases(terms: Iterable[str]) -> list[str]:
    """The same for whole-word phrases (the shorter one must sit on word edges)."""
    terms = list(dict.fromkeys(terms))
    return [
        t for t in terms
        if not any(o != t and f" {o} " in f" {t} " for o in terms)
    ]


def shared_words(terms: Iterable[str]) -> list[str]:
    """A small set of words such that every term contains at least one of them.

    Greedy set cover: a text without any of these words has none of the terms.
    """
    left, cover = list(dict.fromkeys(terms)), []
    candidates = list(dict.fromkeys(w for t in left for w in t.split(" ")))
    while left:
        best = max(candidates, key=lambda w: (sum(w in t for t in left), len(w)))
        cover.append(best)
        left = [t for t in left if best not in t]
    return cover


def runs(one: str) -> str:
    """Runs of the class ``one``, except those of one plain space: a space put in their place
    changes nothing (Java only)."""
    return f"{one}(?:(?<! ){one}*|{one}+)"


# letters beyond Latin-1 that the vocabularies are written with; the class is a superset of them
WIDE = "[\u0100-\u024f\u1e00-\u1eff]"


def by_letters(terms: Iterable[str]) -> tuple[list[str], list[str], list[str], list[str]]:
    """Terms in ASCII, those with Latin-1 letters, those with a letter of ``WIDE``, and others."""
    groups: tuple[list[str], list[str], list[str], list[str]] = ([], [], [], [])
    for t in terms:
        rank = 0 if t.isascii() else 1 if max(t) < "\u0100" else 2 if re.search(WIDE, t) else 3
        groups[rank].append(t)
    return groups


# --- commands, reminders -------------------------------------------------

def command(mark: str, name: str) -> str:
    return f"(^|{SPACE}){re.escape(mark)}{name}({SPACE}|$)"


def command_in_path(mark: str, name: str) -> str:
    return f"{any_of(vocab.PATH_CONTEXT)}{SPACE}+{re.escape(mark)}{name}"


REMINDER_WORDS = [t for t in dict.fromkeys(vocab.REMINDER_TERMS) if " " not in t]
REMINDER_PHRASES = [t for t in dict.fromkeys(vocab.REMINDER_TERMS) if " " in t]

# --- time ------------------------------------------------------------------

_CLOCK_AND_DATE = [
    f"{DIGIT}{{1,2}}[/-]{DIGIT}{{1,2}}[/-]{DIGIT}{{2,4}}",
    f"{DIGIT}{{1,2}}:{DIGIT}{{2}}(:{DIGIT}{{2}})?",
    f"{DIGIT}{{1,2}}/{DIGIT}{{1,2}}",
    f"(19|20){DIGIT}{{2}}",
]


@cache
def time_patterns(language: str) -> tuple[str, ...]:
    """Date, clock, year and weekday forms of one vocabulary."""
    if language == "vietnamese":
        weekday = f"thứ{SPACE}+{any_of(vocab.WEEKDAYS_VI)}"
        day_month = f"ngày{SPACE}+{DIGIT}{{1,2}}{SPACE}+tháng{SPACE}+{DIGIT}"
        return (whole([*_CLOCK_AND_DATE, weekday]), day_month)
    month_day = (
        f"{any_of(vocab.MONTHS_EN)}{SPACE}+{DIGIT}{{1,2}},?{SPACE}+{DIGIT}{{4}}"
    )
    return (whole([*_CLOCK_AND_DATE, month_day, *vocab.WEEKDAYS_EN]),)


# necessary conditions that begin with a character class, which Java tries much faster at each place
CLOCK_HINT = f"{DIGIT}(?:[/:-]{DIGIT}|[09]{DIGIT}{{2}})"

# --- document search ---------------------------------------------------------

def question_end(ending: str) -> str:
    return f"{ending}{SPACE}*[?.!]*$"


SHORT_DEFINITION = whole(vocab.SHORT_DEFINITIONS)


def assistant_name(name: str) -> str:
    """A plain phrase, its words joined or spaced."""
    return whole([f"{SPACE}*".join(re.escape(w) for w in name.lower().split())])


# --- people ------------------------------------------------------------------

USER_ID = whole([f"{DIGIT}{{6}}"])
USERNAME = vocab.USERNAME_PATTERN.replace(r"\d", DIGIT)
# cheap necessary condition: a space-delimited token of letters ending in digits
USERNAME_HINT = f"(^|{SPACE})[a-z]{{2,}}{DIGIT}{{1,3}}({SPACE}|$)"
USERNAME_END = f"[a-z]{DIGIT}"
USER_ID_DIGITS = f"{DIGIT}{{6}}"
PHONE_DIGITS = f"[04]({SPACE}*{DIGIT}){{9}}"
PHONE = f"(^|{NOT_DIGIT})((0|\\+84)({SPACE}*{DIGIT}){{9}})({NOT_DIGIT}|$)"

_SELF_WORDS = [
    t for t in vocab.SELF_REFERENCES
    if " " not in t and len(t) <= vocab.SELF_REFERENCE_WHOLE_WORD_LENGTH
]
_SELF_NEEDLES = [t for t in vocab.SELF_REFERENCES if t not in _SELF_WORDS]
SELF_WORDS = _SELF_WORDS
SELF_NEEDLES = _SELF_NEEDLES
SELF_RELATION = whole(
    [f"{any_of(vocab.RELATIONS)}{SPACE}+{any_of(vocab.RELATION_PRONOUNS)}"]
)

# --- quantities --------------------------------------------------------------

QUANTITY_FORMS = (
    whole([
        f"{any_of(vocab.RANK_WORDS)}{SPACE}*{DIGIT}+",
        *vocab.QUANTITY_PATTERN_TERMS,
    ]),
    # a percent sign only counts when a word character follows it
    f"(^|{NOT_WORD}){DIGIT}+{SPACE}*%{WORD}",
)

RANK_HINT = f"[{''.join(sorted({w[-1] for w in vocab.RANK_WORDS}))}]{SPACE}*{DIGIT}"
PERCENT_HINT = f"%{WORD}"

# --- assistant identity --------------------------------------------------------

COMRADE = spaced(vocab.COMRADE)
COMRADE_GAP = (
    f"^{SPACE}*([{''.join(vocab.COMRADE_PUNCTUATION).replace('-', '')}-]{SPACE}*)*"
    f"([{''.join(vocab.COMRADE_QUOTES)}]{SPACE}*)?"
)
SIMPLE_QUESTION = whole([spaced(t) for t in vocab.SIMPLE_QUESTIONS])

# --- grammar -------------------------------------------------------------------

EN_AFTER_I = f"(^|{NOT_WORD})[iI]{SPACE}+[a-zA-Z]"
EN_SENTENCE_START = f"[.!?]{SPACE}*[a-z]"
VI_SENTENCE_START = f"[.!?]{SPACE}*[{vocab.VIETNAMESE_LOWER}]"


@cache
def accent_map() -> tuple[str, str]:
    """Precomposed characters and their unmarked forms, by Unicode decomposition.

    Characters without a decomposition (such as đ) are left alone. Hangul is
    skipped: its syllables decompose into letters, not marks.
    """
    composed, base = [], []
    for code in (*range(0x00C0, 0xAC00), *range(0xD7B0, 0xD800), *range(0xE000, 0x10000)):
        char = chr(code)
        plain = unicodedata.normalize("NFC", "".join(
            c for c in unicodedata.normalize("NFD", char)
            if unicodedata.category(c) != "Mn"
        ))
        if plain != char and len(plain) == 1:
            composed.append(char)
            base.append(plain)
    return "".join(composed), "".join(base)


# sentences: a dot that ends none of them gives way to GUARD, the end of each is marked by END
GUARD, END = "\x02", "\x01"
SHORT_FORMS = (
    "Mr", "Mrs", "Ms", "Dr", "Prof", "St", "Jr", "Sr", "vs", "etc", "cf", "approx",
    "TP", "Tp", "tp", "ThS", "TS", "GS", "PGS", "BS", "KS", "Tr", "tr",
)
# what stands before a dot that ends nothing, seen in the last BEFORE_DOT characters of the piece
# before it: a short form or initial, a line's number; after another dot, a letter by itself
BEFORE_DOT = 12
UNENDED = f"(^|{NOT_WORD})({any_of(SHORT_FORMS)}|\\p{{Lu}})$|\n[ \t]{{0,4}}{DIGIT}{{1,3}}$"
UNENDED_FIRST = f"^[ \t]{{0,4}}{DIGIT}{{1,3}}$"
UNENDED_LATER = r"^\p{L}$"
_CLOSING = r"[\"'”’»」』)\]）]*"
# a stop before white space, a full-width stop anywhere, an empty line
SENTENCE_END = f"([.!?…]+{_CLOSING})({SPACE}+|$)|([。！？]+{_CLOSING})|\n[ \t\r]*\n"
