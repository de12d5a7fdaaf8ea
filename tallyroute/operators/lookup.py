"""Lookups: joins against small and large dimension tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T, vocab
from .ordering import content_hash

# Rows up to which a lookup side is broadcast or written into the plan.
BROADCAST_ROWS = 200_000
INLINE_NAMES = 20_000
# First words of names that are tested as one short list.
FEW_HEADS = 64
# Copies of a large lookup side, to spread its hot keys.
SALTS = 16
# Words of a text whose places are looked up from one row.
PLACE_BLOCK = 32


def fits(df: DataFrame, rows: int) -> bool:
    """True when the table has at most ``rows`` rows; reads no more than that."""
    return df.limit(rows + 1).count() <= rows


def computed_once(
    df: DataFrame, keep: Sequence[str], computed: Sequence[str | Column]
) -> DataFrame:
    """Keep Spark from moving later filters into the work behind ``computed``.

    A filter on a projected column is pushed below the projection, and with it
    goes a second copy of the whole expression. A filter on generated columns
    stays put, so the one-row ``inline`` makes every label be worked out once.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*computed))))


def known_locations(
    df: DataFrame, column: str, gazetteer: DataFrame, rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Rows whose whole text is a gazetteer name."""
    names = gazetteer.select("name_norm").distinct()
    return (
        df.withColumn("name_norm", F.expr(T.normalize(column)))
        .transform(lambda keyed: spread_join(keyed, names, ["name_norm"], content_hash(df), "left_semi", rows))
        .drop("name_norm")
    )


def inline_names(gazetteer: DataFrame, limit: int = INLINE_NAMES) -> list[str] | None:
    """Normalised names when there are at most ``limit`` of them, else ``None``."""
    names = gazetteer.select("name_norm").distinct().limit(limit + 1).collect()
    return None if len(names) > limit else sorted(r[0] for r in names)


def place_word_list(text: str, spaced: str | None = None) -> str:
    return f"split({T.place_words(text, spaced)}, ' ')"


def mentions_location(text: str, words: str, names: list[str]) -> str:
    """True when some n-gram of the text is one of ``names``; per row, no join.

    ``words`` is a column holding ``place_word_list`` of the text. Only positions
    that hold the first word of some name start n-grams, and only up to the
    longest name. A text with underscores, which turn into spaces inside a
    candidate, takes the general route over all n-grams.
    """
    if not names:
        return "false"
    known = T.listed(names)
    first = sorted({n.split(" ")[0] for n in names})
    heads = T.listed(first)
    # few words are compiled into a set test, many into one per word
    some = T.has_word(words, first) if len(first) <= FEW_HEADS else f"exists({words}, w -> w in ({heads}))"
    longest = longest_name(names)
    named = (
        f"exists(sequence(1, {longest}),"
        f" n -> array_join(slice({words}, i + 1, n), ' ') in ({known}))"
    )
    plain = f"{some} and exists(sequence(0, size({words}) - 1), i -> get({words}, i) in ({heads}) and {named})"
    general = f"exists({T.place_candidates(text, longest)}, g -> g.text in ({known}))"
    return f"coalesce(case when contains({text}, '_') then {general} else {plain} end, false)"


def longest_name(names: list[str]) -> int:
    return max((n.count(" ") + 1 for n in names), default=1)


def text_key(text: str) -> Column:
    """A text's identity in a join; 256 bits, so no two texts share one."""
    return F.sha2(F.col(text).cast("binary"), 256)


def name_levels(names: DataFrame, longest: int) -> list[tuple[int, DataFrame]]:
    """Tables of the names' first 1, 2, 4, .. words: (``prefix``, ``sizes``, ``more``).

    ``sizes`` are the word counts of the names that begin so and are shorter than the
    next level's prefixes; ``more`` says that longer ones exist. ``names`` is (gram, size).
    """
    levels, width = [], 1
    while width <= longest:
        sizes = F.collect_set(F.when(F.col("size") < 2 * width, F.col("size")))
        table = names.filter(F.col("size") >= width).groupBy(F.substring_index("gram", " ", width).alias("prefix"))
        levels.append((width, table.agg(sizes.alias("sizes"), (F.max("size") >= 2 * width).alias("more"))))
        width *= 2
    return levels


def _meet(rows: DataFrame, table: DataFrame, key: str, small: bool, how: str) -> DataFrame:
    """Join with a lookup table: broadcast when ``small``, else salted by the text.

    A phrase of every third text is one join key, so no key stays in one place.
    """
    if small:
        return rows.join(F.broadcast(table), key, how)
    salts = F.array(*[F.lit(i) for i in range(SALTS)])
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("_text_key"), F.lit(SALTS)).cast("int"))
    return salted.join(table.withColumn("_salt", F.explode(salts)), [key, "_salt"], how).drop("_salt")


def name_places(texts: DataFrame, longest: int) -> DataFrame:
    """(``_text_key``, ``pos``, ``prefix``, ``window``) of every word of ``texts`` (``_text_key``, ``_text``).

    ``window`` holds the words from ``pos`` on, as many as the longest name has, and ``prefix``
    is the first word a name could begin with. Long texts are cut into overlapping
    blocks first, so no row carries a whole text once per word.
    """
    block = f"named_struct('base', b, 'words', slice(w, b + 1, {PLACE_BLOCK + longest - 1}))"
    blocks = T.let(
        "w", f"array_remove({place_word_list('_text')}, '')",
        f"case when size(w) > 0 then transform(sequence(0, size(w) - 1, {PLACE_BLOCK}), b -> {block}) end",
    )
    places = texts.select("_text_key", F.explode(F.expr(blocks)).alias("block"))
    starts = F.expr(f"sequence(0, least({PLACE_BLOCK}, size(block.words)) - 1)")
    places = places.select("_text_key", "block", F.explode(starts).alias("i"))
    places = places.selectExpr("_text_key", "block.base + i as pos", f"slice(block.words, i + 1, {longest}) as window")
    # a word of underscores alone is none: the name begins behind it
    opening = f"case when {T.matches('window[0]', '^_+$')} then array_join(window, ' ') else window[0] end"
    return places.withColumn("prefix", F.substring_index(F.expr(T.collapse_space(f"translate({opening}, '_', ' ')")), " ", 1))


def matched_texts(df: DataFrame, text_column: str, gazetteer: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(``_text_key``, ``hit``) of the distinct texts with a name of a large gazetteer.

    Candidates grow by prefixes: a place in a text is looked up by its first word, by its
    first two words if names go on from there, then by four, eight and so on.
    n-grams are formed only where prefixes have matched, and only as long as a
    name with that prefix is, so a single long name adds next to none.
    """
    known = gazetteer.select(F.col("name_norm").alias("gram")).filter("gram <> ''").distinct()
    sized = known.withColumn("size", F.size(F.split("gram", " ")))
    longest, names, heads = sized.agg(
        F.max("size"), F.count("*"), F.count_distinct(F.substring_index("gram", " ", 1))
    ).first()
    longest = longest or 1
    texts = df.select(text_key(text_column).alias("_text_key"), F.col(text_column).alias("_text"))
    texts = texts.filter("_text is not null").dropDuplicates(["_text_key"])
    span = T.collapse_space("translate(array_join(window, ' '), '_', ' ')")
    (_, first), *later = name_levels(sized, longest)
    places = _meet(name_places(texts, longest), first, "prefix", heads <= broadcast_rows, "inner").drop("prefix")
    if later:
        places = places.withColumn("span", F.expr(span))
    for width, table in later:
        table = table.select("prefix", F.col("sizes").alias("_sizes"), F.col("more").alias("_more"))
        # places where no name goes on get a key of their own, so they are not all one null
        done = F.concat(F.lit("_"), "_text_key")
        places = places.withColumn("prefix", F.when(F.col("more"), F.substring_index("span", " ", width)).otherwise(done))
        places = _meet(places, table, "prefix", names <= broadcast_rows, "left").select(
            "_text_key", "pos", "window", "span", F.coalesce("_more", F.lit(False)).alias("more"),
            F.when(F.col("_sizes").isNull(), F.col("sizes")).otherwise(F.concat("sizes", "_sizes")).alias("sizes"),
        )
    # words joined by underscores count one by one in a name
    gram = T.collapse_space("translate(array_join(slice(window, 1, n), ' '), '_', ' ')")
    grams = (
        f"filter(transform(sequence(1, size(window)), n -> named_struct('n', n, 'pos', pos, 'text', {gram})),"
        " g -> g.text <> '' and array_contains(sizes, size(split(g.text, ' '))))"
    )
    plain = (
        "transform(filter(sizes, n -> n <= size(window)), n -> named_struct('n', n, 'pos', pos,"
        " 'text', array_join(slice(window, 1, n), ' ')))"
    )
    grams = f"case when exists(window, x -> contains(x, '_')) then {grams} else {plain} end"
    grams = places.select("_text_key", F.explode(F.expr(grams)).alias("g")).withColumn("gram", F.col("g.text"))
    hits = _meet(grams, known, "gram", names <= broadcast_rows, "inner")
    rank = F.struct((-F.col("g.n")).alias("rank"), "g.pos", "g.n", "g.text")
    return hits.groupBy("_text_key").agg(F.min(rank).alias("hit"))


def location_matches(
    df: DataFrame,
    id_column: str,
    text_column: str,
    gazetteer: DataFrame,
    inline_limit: int = INLINE_NAMES,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Longest, then leftmost gazetteer name in each text.

    Returns ``id, location, n_tokens, position`` for rows whose text has a match;
    the text alone decides, so rows with one id or none are told apart. A
    gazetteer of bounded size is tested inside the row; a larger one is joined
    on the n-grams of the distinct texts, and texts meet their match by digest.
    """
    names = inline_names(gazetteer, inline_limit)
    if names is not None:
        # the cheap test settles most texts; n-grams are built for the others only
        known = f"g.text in ({T.listed(names)})" if names else "false"
        hit = f"get(filter({T.place_candidates(text_column, longest_name(names))}, g -> {known}), 0)"
        keep = [id_column, text_column]
        texts = df.select(*keep, F.expr(place_word_list(text_column)).alias("_place"))
        mentioned = mentions_location(text_column, "_place", names)
        texts = computed_once(texts.selectExpr(*keep, f"{mentioned} as _hit"), keep, ["_hit"])
        found = texts.filter("_hit").select(id_column, F.expr(hit).alias("hit"))
    else:
        hits = matched_texts(df, text_column, gazetteer, broadcast_rows)
        keyed = df.select(id_column, text_key(text_column).alias("_text_key"))
        found = keyed.join(hits, "_text_key").select(id_column, "hit")
    return found.select(
        id_column,
        F.col("hit.text").alias("location"),
        F.col("hit.n").alias("n_tokens"),
        F.col("hit.pos").alias("position"),
    )


def spread_join(
    df: DataFrame, table: DataFrame, keys: list[str], salt_by: Column, how: str = "left", rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join a large side with a lookup table: broadcast up to ``rows`` rows, beyond that salted.

    ``salt_by`` tells rows of one key apart, so a key of a third of all rows is met in
    SALTS places.
    """
    if fits(table, rows):
        return df.join(F.broadcast(table), keys, how)
    salts = F.array(*[F.lit(i) for i in range(SALTS)])
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(SALTS)).cast("int"))
    return salted.join(table.withColumn("_salt", F.explode(salts)), [*keys, "_salt"], how).drop("_salt")


def map_labels_by_table(
    df: DataFrame, id_column: str, labels_column: str, mapping: DataFrame,
    rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """J3 for a mapping table (``label, group``) too large for a literal map.

    The work is done once per distinct list, and rows meet the list that stands for
    theirs by its digest, so ids may be null or repeated. A null list maps to an empty one.
    """
    key = F.sha2(F.to_json(F.struct(labels_column)), 256)
    lists = df.filter(F.col(labels_column).isNotNull()).select(F.col(labels_column).alias("_labels")).distinct()
    pairs = lists.select(
        F.sha2(F.to_json(F.struct(F.col("_labels").alias(labels_column))), 256).alias("_list"),
        F.posexplode("_labels").alias("pos", "label"),
    )
    met = spread_join(pairs, mapping.select("label", "group"), ["label"], F.col("_list"), "left", rows)
    mapped = (
        met.select("_list", "pos", F.coalesce("group", "label").alias("label"))
        .groupBy("_list", "label").agg(F.min("pos").alias("pos"))
        .groupBy("_list")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "label"))).alias("kept"))
        .select("_list", F.col("kept.label").alias("mapped"))
    )
    joined = spread_join(df.withColumn("_list", key), mapped, ["_list"], F.col(id_column), "left", rows)
    return joined.drop("_list").withColumn("mapped", F.coalesce("mapped", F.expr(T.empty())))


def remove_stop_words_exploded(
    tokens: DataFrame, stop_words: DataFrame, rows: int = BROADCAST_ROWS
) -> DataFrame:
    """J4 over one token per row: anti-join on (language, lower-cased token)."""
    keyed = tokens.withColumn("word", F.lower("token"))
    return spread_join(
        keyed, stop_words.select("language", "word"), ["language", "word"], F.struct(*tokens.columns), "left_anti", rows
    ).drop("word")


def settle_predictions(
    predicted: DataFrame, id_column: str = "query_id", latest: Sequence[str] = (),
) -> DataFrame:
    """One prediction per id: the last by ``latest`` (attempt, time; nulls first).

    Answers that ``latest`` does not tell apart are decided by a hash of their
    content, so the choice is the same each time. A prediction without an id answers
    nothing and is left out. Partial maxima are taken in each task, so an id with
    many answers is no hot key.
    """
    columns = [F.col(c) for c in predicted.columns if c != id_column]
    kept = F.max_by(F.struct(*columns), F.struct(*latest, content_hash(predicted)))
    settled = predicted.filter(F.col(id_column).isNotNull()).groupBy(id_column).agg(kept.alias("_kept"))
    return settled.select(id_column, "_kept.*")


def clashing_predictions(
    predicted: DataFrame, id_column: str = "query_id", latest: Sequence[str] = (),
) -> DataFrame:
    """Ids whose last answers differ, and predictions without an id: (id, n_answers, reason)."""
    digest = content_hash(predicted)
    last = F.struct(*latest) if latest else F.lit(0)
    marked = predicted.select(id_column, last.alias("_last"), digest.alias("_digest"))
    per_answer = marked.groupBy(id_column, "_last").agg(
        F.count("*").alias("n"), F.min("_digest").alias("low"), F.max("_digest").alias("high")
    )
    ends = per_answer.groupBy(id_column).agg(F.max_by(F.struct("n", "low", "high"), "_last").alias("end"))
    reason = F.when(F.col(id_column).isNull(), "no id").when(F.col("end.low") != F.col("end.high"), "different answers")
    return ends.select(id_column, F.col("end.n").alias("n_answers"), reason.alias("reason")).filter("reason is not null")


def pair_predictions(
    expected: DataFrame, predicted: DataFrame, id_column: str = "query_id", latest: Sequence[str] = (),
) -> DataFrame:
    """One prediction per id; a missing one becomes an explicit failed row.

    Of several predictions of an id ``settle_predictions`` keeps the last, so
    every expected row comes out once. A row without an id has no prediction.
    """
    settled = settle_predictions(predicted, id_column, latest).drop(*latest)
    paired = expected.join(settled.withColumn("_answered", F.lit(True)), id_column, "left")
    missing = F.when(F.col("_answered").isNull(), F.lit("no prediction"))
    error = F.coalesce(F.col("error"), missing) if "error" in predicted.columns else missing
    scores = (
        F.coalesce("scores", F.expr(T.empty("array<double>")))
        if "scores" in predicted.columns else F.expr(T.empty("array<double>"))
    )
    return (
        paired.withColumn("error", error)
        .withColumn("predicted", F.coalesce("predicted", F.expr(T.empty())))
        .withColumn("scores", scores)
        .withColumn("success", F.col("error").isNull())
        .drop("_answered")
    )


def stop_word_table(spark) -> DataFrame:
    rows = [(code, w) for code, terms in vocab.STOP_WORDS.items() for w in terms]
    return spark.createDataFrame(rows, "language string, word string")
