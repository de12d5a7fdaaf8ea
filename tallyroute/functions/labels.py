"""Label-list expressions: parsing, consolidation, comparison, categories."""

from __future__ import annotations

import re

from . import vocab
from .text import let, listed, quote, trim_space


def parse_labels(joined: str, separator: str = ",") -> str:
    """Split a separated list, trim each label, drop empty ones."""
    parts = f"split(coalesce({joined}, ''), {quote(re.escape(separator))})"
    return f"array_remove(transform({parts}, x -> {trim_space('x')}), '')"


def join_labels(labels: str) -> str:
    return f"array_join({labels}, ', ')"


def map_labels(labels: str, groups: dict[str, str] | None = None) -> str:
    """Consolidate labels; unknown ones pass through; order kept, repeats dropped."""
    groups = vocab.LABEL_GROUPS if groups is None else groups
    cases = " ".join(f"when {quote(k)} then {quote(v)}" for k, v in groups.items())
    grouped = f"case x {cases} else x end" if groups else "x"
    return f"array_distinct(transform({labels}, x -> {grouped}))"


def category_of(mapped: str) -> str:
    """Evaluation category of a consolidated label list, by fixed priority."""
    return (
        f"case when array_contains({mapped}, 'DOC_SEARCH') then 'DOC_SEARCH'"
        f" when array_contains({mapped}, 'FUNCTION_CALLING') then 'FUNCTION_CALLING'"
        f" when array_contains({mapped}, 'REMINDER') or array_contains({mapped}, 'MEETING')"
        " then 'REMINDER' else 'OTHER' end"
    )


def same_set(left: str, right: str) -> str:
    def canonical(labels: str) -> str:
        return f"sort_array(array_distinct({labels}))"

    return f"({canonical(left)} = {canonical(right)})"


def select_from_vector(vector: str, labels=vocab.LABELS) -> str:
    """Labels picked by a raw vector, as ``array<struct<label,vote>>``.

    A 0/1 vector selects its ones; any other selects all positive maxima.
    """
    pairs = f"transform(v, (x, i) -> named_struct('label', get(array({listed(labels)}), i), 'vote', x))"
    binary = "forall(v, x -> x = 0 or x = 1)"
    chosen = f"filter({pairs}, p -> p.label is not null and p.vote > 0 and p.vote = array_max(v))"
    ones = f"filter({pairs}, p -> p.label is not null and p.vote = 1)"
    return let("v", vector, f"case when {binary} then {ones} else {chosen} end")


def top_from_vector(vector: str, labels=vocab.RESPONSE_VECTOR_LABELS, count: int = 2) -> str:
    """The ``count`` highest positive votes; ties keep the vector order."""
    pairs = (
        f"transform(slice({vector}, 1, {len(labels)}), (x, i) -> named_struct("
        f"'rank', 0 - x, 'slot', i, 'label', get(array({listed(labels)}), i), 'vote', x))"
    )
    top = f"filter(slice(sort_array({pairs}), 1, {count}), p -> p.vote > 0)"
    return f"transform({top}, p -> named_struct('label', p.label, 'vote', p.vote))"
