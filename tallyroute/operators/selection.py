"""The first n rows of an order, per table or per group, without sorting them.

``ORDER BY ... LIMIT n`` ends in one task that holds n rows. Here the n-th key is
found by counting: rows are counted per leading digit of the key, the digit in
which the n-th row lies is opened to the next digit, and so on until the rows
in question are few. Everything below passes by a filter where it is; only the rows of
the last digit are ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

DIGIT_BITS = 16
# rows of a boundary digit that are ranked by a window; larger ones are opened further
BOUNDARY_ROWS = 10_000
# n up to which a heap per task is cheaper than counting
FEW_ROWS = 10_000
_WHOLE = ("tinyint", "smallint", "int", "bigint")


def smallest_rows(
    df: DataFrame, n: int | dict[str, int], order: list[str], group: str | None = None
) -> DataFrame:
    """The ``n`` rows that come first by the columns of ``order`` (nulls last).

    With ``group``, ``n`` names the quota of each group, and rows of other groups
    are dropped. Rows that agree in all of ``order`` are taken by the hash of their
    content. The result has the columns of ``df``, in no particular order.
    """
    if group is None:
        if n <= FEW_ROWS:
            return df.orderBy(*[F.col(c).asc_nulls_last() for c in order]).limit(max(n, 0))
        return _select(df, {0: n}, order, F.lit(0))
    wanted = {g: q for g, q in n.items() if q > 0}
    return _select(df, wanted, order, F.col(group)) if wanted else df.limit(0)


def _select(df: DataFrame, quotas: dict, order: list[str], group: Column) -> DataFrame:
    from .ordering import content_hash, unused_names, with_positions

    kinds = dict(df.dtypes)
    depth = next((i for i, c in enumerate(order) if kinds[c] not in _WHOLE), len(order))
    own = unused_names(df, "g", "digits", "bound", "level", "need", "many")
    g, digits, bound, level, need, many = own
    (place,) = unused_names(df, "place")
    key = F.concat(*(_hex_digits(c) for c in order[:depth])) if depth else F.lit("")
    rows = df.withColumns({g: group, digits: key})
    step, widest = DIGIT_BITS // 4, 16 * depth
    # of each group: the digits known of its last row, how many rows with them are wanted, and how many there are
    state = {k: ("", wanted, None) for k, wanted in quotas.items()}

    def unsettled(prefix: str, wanted: int, there: int | None) -> bool:
        return there is None or there > max(wanted, BOUNDARY_ROWS)

    while open_ := {k: v for k, v in state.items() if len(v[0]) < widest and unsettled(*v)}:
        found = _next_digit(rows, open_, g, digits, step)
        for k, (prefix, wanted, _) in open_.items():
            digit, before, there, total = found.get(k, ("", 0, 0, 0))
            state[k] = (prefix, wanted, total) if total <= wanted else (prefix + digit, wanted - before, there)
    kind = dict(rows.dtypes)[g]
    settled = [
        # a bound behind all its digits: every row that has them is wanted
        (k, prefix + "G", len(prefix), 0, False) if there is not None and there <= wanted
        else (k, prefix, len(prefix), wanted, unsettled(prefix, wanted, there))
        for k, (prefix, wanted, there) in state.items()
    ]
    states = df.sparkSession.createDataFrame(
        settled, f"`{g}` {kind}, `{bound}` string, `{level}` int, `{need}` bigint, `{many}` boolean"
    )
    marked = rows.join(F.broadcast(states), g)
    lead = F.substring(F.col(digits), F.lit(1), F.col(level))
    below = marked.filter(lead < F.col(bound)).drop(*own)
    edge = marked.filter(lead == F.col(bound))
    in_order = [F.col(c).asc_nulls_last() for c in order]
    rank = F.row_number().over(Window.partitionBy(g).orderBy(*in_order, content_hash(df)))
    ranked = edge.filter(~F.col(many)).withColumn(place, rank)
    result = below.unionByName(ranked.filter(F.col(place) <= F.col(need)).drop(place, *own))
    if not any(row[-1] for row in settled):
        return result
    # more rows than a window should rank agree in every digit there is
    numbered = with_positions(edge.filter(many), [g, *order])
    starts = numbered.groupBy(g).agg(F.min("position").alias(place))
    taken = numbered.join(F.broadcast(starts), g).filter(F.col("position") - F.col(place) < F.col(need))
    return result.unionByName(taken.drop("position", place, *own))


def _hex_digits(column: str) -> Column:
    """Sixteen digits that sort as the whole number does; null after all others (and equal to the largest)."""
    shifted = F.col(column).cast("long").bitwiseXOR(F.lit(-(1 << 63)))
    return F.coalesce(F.lpad(F.hex(shifted), 16, "0"), F.lit("F" * 16))


def _next_digit(
    rows: DataFrame, state: dict, g: str, digits: str, step: int
) -> dict[object, tuple[str, int, int, int]]:
    """For each open group: the digit of its last wanted row, the rows before it, in it, and in all digits."""
    kind = dict(rows.dtypes)[g]
    schema = f"`{g}` {kind}, lead string, size int, need bigint"
    opened = rows.sparkSession.createDataFrame([(k, p, len(p), w) for k, (p, w, _) in state.items()], schema)
    inside = rows.select(g, digits).join(F.broadcast(opened), g)
    inside = inside.filter(F.substring(F.col(digits), 1, F.col("size")) == F.col("lead"))
    digit = F.substring(F.col(digits), F.col("size") + 1, F.lit(step))
    counts = inside.groupBy(g, digit.alias("digit"), "need").agg(F.count("*").alias("n"))
    upto = Window.partitionBy(g).orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
    summed = counts.withColumns({
        "upto": F.sum("n").over(upto), "total": F.sum("n").over(Window.partitionBy(g)),
    })
    last = summed.filter(F.col("upto") >= F.least("need", "total"))
    hit = last.groupBy(g).agg(F.min(F.struct("upto", "digit", "n", "total")).alias("hit")).select(g, "hit.*")
    return {r[0]: (r.digit, r.upto - r.n, r.n, r.total) for r in hit.collect()}
