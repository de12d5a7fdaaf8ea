"""Registry of named queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..operators.cleaning import clean_table, drop_null_rows, fill_and_trim, quarantine, typed_table
from ..operators.ordering import with_batch_ids
from ..sources.gazetteer import build_gazetteer
from . import corpus as C

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Inputs:
    """The tables a registered query reads, built lazily."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return C.table(self.spark, self.sf_dir, name)

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events")

    @cached_property
    def corpus(self) -> DataFrame:
        return C.request_corpus(self.events)

    @cached_property
    def dirty(self) -> DataFrame:
        return C.dirty_corpus(self.events)

    @cached_property
    def present(self) -> DataFrame:
        return drop_null_rows(self.dirty)

    @cached_property
    def filled(self) -> DataFrame:
        return fill_and_trim(self.present)

    @cached_property
    def clean(self) -> DataFrame:
        return clean_table(self.dirty)

    @cached_property
    def typed(self) -> DataFrame:
        return typed_table(self.dirty)

    @cached_property
    def records(self) -> DataFrame:
        return quarantine(self.typed)[0]

    @cached_property
    def rejected(self) -> DataFrame:
        return quarantine(self.typed)[1]

    @cached_property
    def requests(self) -> DataFrame:
        return typed_table(self.corpus)

    @cached_property
    def batches(self) -> DataFrame:
        return with_batch_ids(self.records, 100)

    @cached_property
    def gazetteer(self) -> DataFrame:
        return build_gazetteer(
            self.table("nation").select("n_name"), self.table("region").select("r_name")
        )

    @cached_property
    def documents(self) -> DataFrame:
        return self.table("documents")


def add(key: str, build: Callable[[Inputs], DataFrame], oracle: str | None = None) -> None:
    if key in QUERIES:
        raise ValueError(f"duplicate query: {key}")
    QUERIES[key] = lambda spark, sf_dir: build(Inputs(spark, sf_dir))
    if oracle is not None:
        ORACLES[key] = oracle
