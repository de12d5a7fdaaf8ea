"""Record validation (K1-K5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as T, vocab
from .statistics import rounded

# letters and digits, with underscores and hyphens allowed in between
_PLAIN = r"^[\p{L}\p{N}]+$"


def _plain(name: str) -> str:
    return T.matches(f"translate({name}, '_-', '')", _PLAIN)


def _blank(name: str) -> str:
    filled = f"coalesce({name}, '')"
    return f"{T.trim_space(filled)} = ''"


def validate(df: DataFrame, name_checks: bool = True) -> DataFrame:
    """Add ``errors``, ``warnings`` and ``is_valid`` to a typed table.

    ``name_checks`` adds the warnings about characters in domains and labels.
    """
    errors = T.messages([
        (_blank("query"), vocab.EMPTY_QUERY),
        (_blank("knowledge_domain"), vocab.EMPTY_DOMAIN),
        ("coalesce(size(workers_list), 0) <= 0", vocab.NO_LABELS),
    ])
    checks = [
        (f"length(query) > {vocab.MAX_QUERY_LENGTH}", vocab.LONG_QUERY),
        (f"size(workers_list) > {vocab.MAX_LABELS}", vocab.MANY_LABELS),
    ]
    if not name_checks:
        warnings = T.messages(checks)
    else:
        checks.append((f"not {_plain('knowledge_domain')}", vocab.DOMAIN_CHARACTERS))
        odd = (
            f"transform(filter(workers_list, w -> not {_plain('w')}),"
            f" w -> concat({T.quote(vocab.LABEL_CHARACTERS)}, w))"
        )
        warnings = f"concat({T.messages(checks)}, {odd})"
    return df.withColumns({
        "errors": F.expr(errors), "warnings": F.expr(warnings),
    }).withColumn("is_valid", F.expr("size(errors) = 0"))


def validation_summary(validated: DataFrame) -> DataFrame:
    valid = F.count_if(F.col("is_valid"))
    return validated.agg(
        F.count("*").alias("total"), valid.alias("valid"),
        (F.count("*") - valid).alias("invalid"),
        F.coalesce(F.sum(F.size("warnings")), F.lit(0)).alias("warning_count"),
        rounded(F.coalesce(F.try_divide(valid, F.count("*")), F.lit(0.0))).alias("valid_rate"),
    )


def message_counts(validated: DataFrame) -> DataFrame:
    return validated.select(
        F.explode(F.concat("errors", "warnings")).alias("message")
    ).groupBy("message").agg(F.count("*").alias("message_count"))
