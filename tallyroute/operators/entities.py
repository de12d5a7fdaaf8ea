"""Entity spans from BIO tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text as T


def fold_tag_rows(tags: DataFrame, id_column: str = "query_id") -> DataFrame:
    """Spans of a tag table with one row per token (``id, pos, token, tag``).

    B starts a span, I adds its token, O closes it, and an I without an open
    span is ignored. Both windows and the final grouping use the document id,
    so the table is shuffled once.
    """
    window = Window.partitionBy(id_column).orderBy("pos")
    begins = F.col("tag").startswith("B-")
    opened = tags.withColumns({
        "_span": F.sum(begins.cast("int")).over(window),
        "_closed": F.sum((F.col("tag") == "O").cast("int")).over(window),
    })
    member = begins | F.col("tag").startswith("I-")
    start = F.first(F.when(begins, F.col("_closed")), ignorenulls=True)
    in_span = Window.partitionBy(id_column, "_span").orderBy("pos")
    kept = (
        opened.filter((F.col("_span") > 0))
        .withColumn("_open", F.col("_closed") == start.over(in_span))
        .filter(member & F.col("_open"))
    )
    parts = F.sort_array(F.collect_list(F.struct("pos", "token", "tag")))
    return (
        kept.groupBy(id_column, "_span").agg(parts.alias("_parts"))
        .select(
            id_column,
            F.col("_span").alias("span"),
            F.array_join("_parts.token", " ").alias("text"),
            F.element_at(F.split(F.get("_parts.tag", F.lit(0)), "-"), -1).alias("label"),
        )
    )


def fold_tags(tokens: str, tags: str, text: str) -> str:
    """The same within one row: ``array<struct<text,label,start,end>>``.

    ``tokens`` and ``tags`` are aligned arrays; offsets are first occurrences
    in ``text``, an extended span ends at its last token found from its start.
    """
    edges = (
        "filter(sequence(0, size(tg) - 1),"
        " i -> get(tg, i) = 'O' or startswith(get(tg, i), 'B-'))"
    )
    stop = "coalesce(get(ed, k + 1), size(tg))"
    inside = f"filter(sequence(s, {stop} - 1), j -> j = s or startswith(get(tg, j), 'I-'))"
    words = f"transform({inside}, j -> get(tk, j))"
    start = "instr(tx, get(tk, s)) - 1"
    last = "get(ws, size(ws) - 1)"
    end = f"locate({last}, tx, greatest({start} + 1, 1)) - 1 + length({last})"
    span = T.let("ws", words, (
        "named_struct('text', array_join(ws, ' '), 'label', element_at(split(get(tg, s), '-'), -1),"
        f" 'start', {start}, 'end', {end})"
    ))
    spans = (
        "filter(transform(ed, (s, k) -> case when startswith(get(tg, s), 'B-')"
        f" then {span} end), e -> e is not null)"
    )
    body = T.let("ed", edges, spans)
    guarded = f"case when size(tg) > 0 then {body} else {T.empty(T.ENTITIES)} end"
    return T.let("tx", text, T.let("tk", tokens, T.let("tg", tags, guarded)))
