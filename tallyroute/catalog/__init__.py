"""Named queries over the data set, each with its DuckDB twin where SQL can say it."""

from __future__ import annotations


def all_queries():
    from . import detect, evaluate, tables, texts  # noqa: F401 - register on import
    from .registry import ORACLES, QUERIES

    return QUERIES, ORACLES
