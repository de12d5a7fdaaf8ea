"""Personal data by anchor expansion.

An Aho-Corasick automaton finds at-signs, plus signs, digit pairs, schemes and
identifier cues in one pass over the whole text. Small local parsers grow each
anchor to the left and right and validate what they find.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from math import log2

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import map_batches, text_of

# kinds of the base rules in their fixed order, then the kinds the cues add
BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("iban", "ssn", "account", "login_url", "secret")
_RANK = {kind: rank for rank, kind in enumerate(BASE_KINDS + MORE_KINDS)}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = frozenset("0123456789")
_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# after a cue: "number", "no", "nr", "is" in any case, at most a few joining characters, then
# the identifier and its boundary
_WORDS = r"(?: (?i:number|no|nr|is)\b){0,2}"
_IBAN = re.compile(_WORDS + r"[ .:#=]{0,4}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
_SSN = re.compile(_WORDS + r"[ .:#=]{0,4}([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])")
_ACCOUNT = re.compile(_WORDS + r"[ .:#=]{1,4}([0-9]{6,17})(?![0-9])")
# a secret is assigned to its cue: a long unbroken value, or a quoted password
_SECRET = re.compile(r"""(?:[_-]?(?i:key|token|id|value))?["']? ?(?::|=>?) ?["']?([A-Za-z0-9+/_.~-]{15,}[A-Za-z0-9+/_~-]={0,2})(?![A-Za-z0-9+/_~=-])""")
_PASSWORD = re.compile(r"""["']? ?(?::|=>?) ?(["'])([^\s"']{8,})\1""")
_SECRET_CUES = ("token", "secret", "key", "password", "passwd", "pwd")
_LEAST_ENTROPY = 3.0
_LOGIN = re.compile(r"[A-Za-z0-9._%+-]+:[^ \t-\r@/]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*")

SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"


@cache
def _automaton() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    anchors = {"@": "email", "://": "login_url"}
    for a in "0123456789":
        anchors[f"+{a}"] = "phone"
        for b in "0123456789":
            anchors[f"{a}.{b}"] = "ip"
            anchors |= {f"{a}{b}": "card", f"{a} {b}": "card", f"{a}-{b}": "card"}
    for cue, kind in (("iban", "iban"), ("ssn", "ssn"), ("social security", "ssn"), ("account", "account"), ("acct", "account")):
        anchors |= {form: kind for form in (cue, cue.upper(), cue.capitalize(), cue.title())}
    for cue in _SECRET_CUES:
        anchors |= {form: "secret" for form in (cue, cue.upper(), cue.capitalize())}
    for anchor, kind in anchors.items():
        automaton.add_word(anchor, (kind, len(anchor)))
    automaton.make_automaton()
    return automaton


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def _iban_holds(value: str) -> bool:
    plain = value.replace(" ", "")
    turned = plain[4:] + plain[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def _is_random(value: str) -> bool:
    """Letters and digits mixed, and no character so frequent that it could be a word or a rule."""
    if not any(c in _DIGITS for c in value) or not any(c in _LETTERS for c in value):
        return False
    shares = [n / len(value) for n in Counter(value).values()]
    return -sum(p * log2(p) for p in shares) >= _LEAST_ENTROPY


def _secret(text: str, start: int, at: int) -> tuple[int, int] | None:
    """The span of the value that is assigned to the cue from ``start`` to ``at``."""
    if (run := _SECRET.match(text, at)) and _is_random(run[1]):
        return run.span(1)
    if text[start] in "pP" and (run := _PASSWORD.match(text, at)) and not run[2].isalpha():
        return run.span(2)
    return None


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then kind.

    Base kinds are the leftmost matches of the base rules that do not overlap
    within their kind; a match that fails its check is passed over whole.
    """
    found: list[tuple[str, int, int]] = []
    done = dict.fromkeys(_RANK, 0)  # per kind: where the text is settled up to
    for last, (kind, length) in _automaton().iter(text):
        start = last - length + 1
        if start < done[kind]:
            continue
        if kind == "email":
            left = start
            while left > done["email"] and text[left - 1] in _LOCAL:
                left -= 1
            if left < start and (domain := _DOMAIN.match(text, start + 1)):
                found.append(("email", left, domain.end()))
                done["email"] = domain.end()
        elif kind == "ip":
            left = start
            while left > done["ip"] and text[left - 1] in _DIGITS:
                left -= 1
            run = _DOTTED.match(text, left)
            parts, at = run[0].split("."), left
            for k in range(0, len(parts) - 3, 4):
                end = at + sum(map(len, parts[k : k + 4])) + 3
                if all(map(_byte, parts[k : k + 4])):
                    found.append(("ip", at, end))
                at = end + 1
            done["ip"] = run.end()
        elif kind == "card":
            run = _CARD.match(text, start)
            digits = run[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", start, run.end()))
            done["card"] = run.end()
        elif kind == "phone":
            if run := _PHONE.match(text, start):
                if 10 <= sum(c in _DIGITS for c in run[0]) <= 15:
                    found.append(("phone", start, run.end()))
                done["phone"] = run.end()
        elif kind == "login_url":
            left = start
            while left > done["login_url"] and text[left - 1] in _LETTERS:
                left -= 1
            if left < start and (run := _LOGIN.match(text, last + 1)):
                found.append(("login_url", left, run.end()))
                done["login_url"] = run.end()
        elif kind == "secret":
            if span := _secret(text, start, last + 1):
                found.append(("secret", *span))
                done["secret"] = span[1]
        elif not (start and text[start - 1].isalnum()):
            shape = {"iban": _IBAN, "ssn": _SSN, "account": _ACCOUNT}[kind]
            run = shape.match(text, last + 1)
            value = run[1] if run else ""
            # capital words after an IBAN are taken in first: shorter ends at spaces are tried
            while kind == "iban" and value and not _iban_holds(value):
                value = value.rpartition(" ")[0]
                value = value if len(value.replace(" ", "")) >= 15 else ""
            if value:
                found.append((kind, run.start(1), run.start(1) + len(value)))
                done[kind] = run.start(1) + len(value)
    found.sort(key=lambda span: (span[1], _RANK[span[0]]))
    return found


def _spans_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [
            [{"kind": k, "start": s, "end": e, "base": k in BASE_KINDS} for k, s, e in find_spans(text)]
            for text in batch.column(1).to_pylist()
        ]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, SPAN_TYPE)], ["doc_id", "spans"])


def pii_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, spans) for every row of ``docs``, in place: no shuffle.

    Null and empty texts have no spans, whole texts are read whatever their
    length, repeated rows give repeated rows, a null id is passed on, other
    columns are not read.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("doc_id"), text_of(text_column).alias("text"))
    return map_batches(rows, _spans_of, f"doc_id {kind}, spans {SPANS}").withColumnRenamed("doc_id", id_column)


def span_list(spans: Column, base_only: bool = False) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    chosen = F.filter(spans, lambda x: x["base"]) if base_only else spans
    return F.array_join(F.transform(chosen, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, overlapping ones as one, replaced by its first kind in brackets."""
    parts, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            parts += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join(parts) + text[at:]
