"""Vote vectors as SQL expressions.

A vector is a mapping from slot to expression holding only the slots that can
be reached; slots that are absent are zero.
"""

from __future__ import annotations

from collections.abc import Sequence

from . import vocab
from .text import quote

SLOTS = len(vocab.LABELS)

Weights = dict[str, dict[int, float]]
Vector = dict[int, str]


def weighted_vector(flags: dict[str, str], weights: Weights) -> Vector:
    """Add each fired flag's weights per slot and scale the row to sum one.

    A detector that only ever reaches one slot is a plain 0/1 test.
    """
    slots = sorted({slot for w in weights.values() for slot in w})
    if len(slots) == 1:
        fired = " or ".join(flags[f] for f in weights)
        return {slots[0]: f"case when {fired} then 1D else 0D end"}

    def added(values: dict[str, float]) -> str:
        parts = (f"case when {flags[f]} then {w}D else 0D end" for f, w in values.items())
        return "(" + " + ".join(parts) + ")"

    total = added({f: round(sum(w.values()), 9) for f, w in weights.items()})

    def slot(i: int) -> str:
        share = added({f: w[i] for f, w in weights.items() if i in w})
        return f"case when {total} > 0 then {share} / {total} else 0D end"

    return {i: slot(i) for i in slots}


def normalize_vector(vector: Vector) -> Vector:
    """Scale to sum one; an all-zero vector stays zero."""
    total = "(" + " + ".join(vector.values()) + ")"
    return {i: f"coalesce(try_divide({x}, {total}), 0D)" for i, x in vector.items()}


def sum_vectors(vectors: Sequence[Vector]) -> list[str]:
    """Slot-wise sum over all labels; a failed (null) entry counts as zero."""
    def slot(i: int) -> str:
        parts = [f"coalesce({v[i]}, 0D)" for v in vectors if i in v]
        return " + ".join(parts) if parts else "0D"

    return [slot(i) for i in range(SLOTS)]


def round6(x: str) -> str:
    """Six decimals in plain double arithmetic (stable ties, no BigDecimal)."""
    return f"floor(({x}) * 1000000D + 0.5D) / 1000000D"


def rank_labels(votes: Sequence[str], labels=vocab.LABELS) -> str:
    """``array<struct<rank,label>>`` by vote descending, then label.

    ``rank`` is minus the vote, so that one ascending sort does both.
    """
    keyed = ", ".join(
        f"named_struct('rank', 0D - {v}, 'label', {quote(name)})"
        for v, name in zip(votes, labels)
    )
    return f"sort_array(array({keyed}))"
