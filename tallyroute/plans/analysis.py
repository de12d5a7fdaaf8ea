"""Text analysis tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from ..operators.ordering import sample_rows
from ..operators import filters

TECHNIQUES = (
    "tokenization", "pos_tagging", "lemmatization", "named_entity_recognition",
    "sentiment_analysis", "dependency_parsing",
)
DEFAULT_TECHNIQUES = ("tokenization", "pos_tagging")


def analyze(
    df: DataFrame, text: str = "query", language: str | None = None, entities: str | None = None,
    max_length: int | None = None, sentiment: str | None = None, segment: bool = False,
) -> DataFrame:
    """Per-text analysis columns; a narrow projection without a shuffle.

    A text counts as one sentence unless ``segment`` asks for its sentences to be found.

    ``entities`` and ``sentiment`` name columns of an annotator (``annotate``);
    without them there are no entities and the sentiment is neutral.

    ``language`` names a column with an already detected language; otherwise
    it is detected from the text. Empty texts give an empty record.
    """
    blank = f"({text} is null or {text} = '')"
    tidy = T.collapse_space(f"coalesce({text}, '')")
    detected = T.detect_language("cleaned_text") if language is None else language
    df = df.withColumn("cleaned_text", F.expr(tidy))
    df = df.withColumn("lang", F.expr(T.gate_language("cleaned_text", detected)))
    if max_length is not None:
        df = df.withColumn("cleaned_text", F.expr(T.clip("cleaned_text", max_length)))
    df = df.withColumn("tokens", F.expr(T.tokens("cleaned_text")))
    felt = T.neutral_sentiment() if sentiment is None else f"coalesce({sentiment}, {T.neutral_sentiment()})"
    found = T.empty(T.ENTITIES) if entities is None else f"coalesce({entities}, {T.empty(T.ENTITIES)})"
    return df.withColumns({
        "word_count": F.size("tokens"),
        "sentence_count": F.expr(T.sentence_count(text) if segment else f"case when {blank} then 0 else 1 end"),
        "avg_word_length": F.expr(T.mean_length("tokens")),
        "sentiment": F.expr(felt),
        "sentiment_score": F.expr(f"({felt}).compound"),
        "entities": F.expr(found),
        "keywords": F.expr(T.keywords("tokens", "lang")),
        "topics": F.expr(T.topics("lower(cleaned_text)")),
        "grammar_issues": F.expr(T.grammar_issues("cleaned_text", "lang")),
    })


def process(
    df: DataFrame, techniques=DEFAULT_TECHNIQUES, text: str = "query",
    max_length: int | None = None,
) -> DataFrame:
    """Only the columns of the chosen techniques; the rest stay empty.

    Texts are taken whole unless ``max_length`` asks for a cut.
    """
    unknown = [t for t in techniques if t not in TECHNIQUES]
    if unknown:
        raise ValueError(f"unknown techniques: {', '.join(unknown)}")
    df = df.withColumn("cleaned_text", F.expr(T.collapse_space(f"coalesce({text}, '')")))
    df = df.withColumn("lang", F.expr(T.language_of("cleaned_text")))
    if max_length is not None:
        df = df.withColumn("cleaned_text", F.expr(T.clip("cleaned_text", max_length)))
    df = df.withColumn("_parts", F.expr(T.tokens("cleaned_text")))

    def chosen(technique: str, value: str, otherwise: str) -> Column:
        return F.expr(value if technique in techniques else otherwise)

    tag, dep = "array<struct<token:string,tag:string>>", (
        "array<struct<text:string,head:string,dep:string,pos:string>>"
    )
    nothing = "cast(null as struct<compound:double,pos:double,neu:double,neg:double>)"
    return df.withColumns({
        "tokens": chosen("tokenization", "_parts", T.empty()),
        "pos_tags": chosen("pos_tagging", T.default_tags("_parts"), T.empty(tag)),
        "lemmas": chosen("lemmatization", "_parts", T.empty()),
        "entities": F.expr(T.empty(T.ENTITIES)),
        "sentiment": chosen("sentiment_analysis", T.neutral_sentiment(), nothing),
        "dependencies": chosen(
            "dependency_parsing", T.default_dependencies("_parts"), T.empty(dep)
        ),
    }).drop("_parts")


def analysis_table(typed: DataFrame) -> DataFrame:
    """The full analysis of a request table (T26): one row per request."""
    return analyze(typed).withColumns({
        "pos_tags": F.expr(T.default_tags("tokens")),
        "language_confidence": F.lit(1.0),
        "success": F.lit(True),
        "error_message": F.lit(None).cast("string"),
    })


def sentence_report(
    typed: DataFrame, groups=("FUNCTION_CALLING", "DOC_SEARCH"), n: int = 300, seed: int = 42,
    order: Column | None = None,
) -> DataFrame:
    """Analysis of a seeded sample per single-label group."""
    whole = None
    for name in groups:
        part = sample_rows(filters.by_joined_labels(typed, name), n, seed, order=order)
        whole = part if whole is None else whole.unionByName(part)
    return analysis_table(whole)
