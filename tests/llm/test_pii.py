import hashlib
import re

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tallyroute.llm import pii, queries

from ..conftest import DATA
from .samples import AWKWARD, documents, read

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))
    if kind == "card":
        total = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))
        return 14 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def brute(text):
    found = [
        (m.start(), rank, m.end(), kind)
        for rank, (kind, rule) in enumerate(BASE.items()) for m in re.finditer(rule, text) if holds(kind, m[0])
    ]
    return [(kind, start, end) for start, _, end, kind in sorted(found)]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(
    ["a", "b.c", "@", ".", "1", "22", "333", "255", "0", " ", "-", "+1", "(555)", "é", "4532015112830366", "1.2.3.4", "x@y.z", "%", "\n", "😀"]
), max_size=24).map("".join))
def test_base_spans_are_the_rules_matches(text):
    assert [s for s in pii.find_spans(text) if s[0] in pii.BASE_KINDS] == brute(text)


def test_query_equals_brute_force(spark):
    texts = {r.doc_id: r.text or "" for r in read(spark, DATA, "documents").collect()}
    rows = queries.op1_pii(spark, DATA).collect()
    assert len(rows) == len(texts) and any(r.n_email for r in rows)
    for r in rows:
        want = brute(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in want) for k in BASE]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()


def test_cues_add_validated_identifiers():
    kinds = lambda text: [(k, text[a:b]) for k, a, b in pii.find_spans(text)]
    assert ("iban", "GB82 WEST 1234 5698 7654 32") in kinds("IBAN: GB82 WEST 1234 5698 7654 32.")
    assert "iban" not in dict(kinds("IBAN: GB83 WEST 1234 5698 7654 32."))
    assert ("ssn", "123-45-6789") in kinds("SSN 123-45-6789,")
    assert ("account", "12345678") in kinds("account number: 12345678")
    assert kinds("discount 12345678") == []
    assert ("login_url", "ftp://u:p@host.org") in kinds("see ftp://u:p@host.org now")


def test_redaction():
    text = "mail a@b.c now"
    assert pii.redact(text, pii.find_spans(text)) == "mail [email] now"


def test_awkward_rows(spark):
    docs = documents(spark, AWKWARD, extra=True)
    rows = pii.pii_spans(docs).collect()
    assert len(rows) == len(AWKWARD)
    assert {r.doc_id: [s.kind for s in r.spans] for r in rows if r.doc_id}[9] == ["email", "ip", "phone"]
    assert pii.pii_spans(docs.filter(F.lit(False))).count() == 0
