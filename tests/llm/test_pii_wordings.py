"""Ordinary wordings between a cue and its identifier."""

import re

import pytest

from tallyroute.llm import pii

from ..conftest import DATA
from .samples import read


@pytest.mark.parametrize("text, kind, value", [
    ("social security number: 123-45-6789", "ssn", "123-45-6789"),
    ("his SSN is 123-45-6789.", "ssn", "123-45-6789"),
    ("Social Security No. 123-45-6789", "ssn", "123-45-6789"),
    ("Account Number: 12345678", "account", "12345678"),
    ("ACCOUNT NO 12345678", "account", "12345678"),
    ("Account number is 12345678", "account", "12345678"),
    ("IBAN DE89370400440532013000 BIC COBADEFFXXX", "iban", "DE89370400440532013000"),
    ("IBAN is DE89 3704 0044 0532 0130 00 BIC", "iban", "DE89 3704 0044 0532 0130 00"),
])
def test_identifier_is_found(text, kind, value):
    assert [text[s:e] for k, s, e in pii.find_spans(text) if k == kind] == [value]


def test_wrong_iban_is_not_found():
    assert not [s for s in pii.find_spans("IBAN DE88370400440532013000 BIC COBADEFFXXX") if s[0] == "iban"]


HEX = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"


@pytest.mark.parametrize("text, value", [
    (f'de token = "{HEX}"### 47', HEX),
    (f"API_KEY={HEX}", HEX),
    (f"'secret_key': '{HEX}'", HEX),
    (f"accessToken => {HEX}.", HEX),
    ("password: 'hunter2-now'", "hunter2-now"),
    ("password: 'undisclosed'", None),
    ("PWD=short1", None),
    ("the key is = aaaaaaaaaaaaaaaaaaaaaaa1", None),
    ("key: international-relations", None),
    ("a token of appreciation", None),
    (f"token {HEX}", None),
    ("token =", None),
])
def test_secret_is_found(text, value):
    found = [text[s:e] for k, s, e in pii.find_spans(text) if k == "secret"]
    assert found == ([value] if value else [])


def test_every_token_of_the_documents_is_found(spark):
    texts = [r.text or "" for r in read(spark, DATA.replace("sf0.001", "sf0.01"), "documents").select("text").collect()]
    written = [(t, m[1]) for t in texts for m in re.finditer(r'token = "([0-9a-f]{32,})"', t)]
    assert written
    for text, value in written:
        assert value in {text[s:e] for k, s, e in pii.find_spans(text) if k == "secret"}
