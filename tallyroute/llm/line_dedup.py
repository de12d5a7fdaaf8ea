"""Near-equal lines across documents by a deletion-neighbourhood join.

Lines are sequences of words and two lines are near-equal if one edit of a word
(change, insertion or deletion) turns one into the other. Each line emits the
hashes of its deletion variants: the line without word p, keyed with p. Lines that
share a variant at the same place differ by that word at most, and a line that
equals another's variant lacks one word, so equal keys already name the pairs;
no pairs within a group are formed, each row meets the earliest of its key. The
words are then compared, and of near-equal lines the earliest stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import join_groups, key_bitmap, saved, text_of, with_maybe, without_ids

# lines of fewer words are compared exactly: one edit would be under 0.8 of similarity
MIN_WORDS = 5


def _without(words: Column, place: Column) -> Column:
    """The words but the one at ``place`` (from 1), joined."""
    return F.array_join(F.concat(F.slice(words, 1, place - 1), F.slice(words, place + 1, F.size(words))), " ")


def document_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, number, line, code, n_words) of every line with a word.

    Numbers count all lines from 0. Each white space of the contract becomes one
    space; ``code`` is the hash of the line.
    """
    text = text_of(text_column)
    plain = F.when(F.regexp_like(text, F.lit("[\\t\\x0b-\\r]")), F.translate(text, "\t\x0b\x0c\r", "    ")).otherwise(text)
    lines = docs.select(F.col(id_column).alias("id"), F.posexplode(F.split(plain, "\n")).alias("number", "raw"))
    single = F.when(F.contains("raw", F.lit("  ")), F.regexp_replace("raw", " +", " ")).otherwise(F.col("raw"))
    lines = lines.select("id", "number", F.trim(single).alias("line")).filter("line <> ''")
    words = F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    return lines.select("id", "number", "line", F.xxhash64("line").alias("code"), words.alias("n_words"))


def duplicate_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, number, first_id, first_number, near) of every line that an earlier line repeats.

    Order is by id and line number; ``first`` is an earlier equal line, or, if
    ``near``, an earlier line one edit away. Null and empty texts have no lines,
    lines without words are never repeats, rows repeated with one id repeat each
    other's lines with the same number and are left alone, a null id stands last.
    """
    lines = saved(document_lines(docs, id_column, text_column), "lines")
    place = F.struct(F.col("id").isNull().alias("last"), F.col("id"), F.col("number"))
    rows = lines.select("id", "number", "code")
    # equal lines first: one row per distinct line, the earliest
    distinct = saved(
        rows.groupBy("code").agg(F.min(place).alias("first"), F.count("*").alias("n")), "distinct-lines"
    )
    near = near_lines(lines, distinct)
    better = distinct.filter("n > 1").select("code", "first", "n").join(near.select("code", F.col("earlier")), "code", "full")
    better = saved(better.select("code", F.coalesce("n", F.lit(1)).cast("long").alias("n"), "first", "earlier"), "repeats")
    marked = with_maybe(rows, [F.col("code")], key_bitmap(better.select("code")), "maybe").filter("maybe").drop("maybe")
    met = join_groups(saved(marked, "repeat-rows"), better, "code", "n")
    own = F.struct(F.col("id").isNull().alias("last"), F.col("id"), F.col("number"))
    equal = F.coalesce(F.col("first") < own, F.lit(False))
    found = met.withColumn("source", F.when(equal, F.col("first")).otherwise(F.col("earlier"))).filter("source is not null")
    return found.select(
        F.col("id").alias(id_column), "number", F.col("source.id").alias("first_id"),
        F.col("source.number").alias("first_number"), (~equal).alias("near"),
    )


def near_lines(lines: DataFrame, distinct: DataFrame) -> DataFrame:
    """(code, earlier): distinct lines with an earlier line one edit away."""
    words = lines.filter(F.col("n_words") >= MIN_WORDS).select("code", "line", "n_words")
    # pigeonhole: an edit leaves the first or the second half as it was, so only
    # lines that share a half with another line can have a partner
    keys = []
    for least in ("n_words - 1", "n_words"):  # the shorter line of a pair decides where the halves part
        front = f"cast(floor(({least}) / 2) as int)"
        keys.append(F.expr(f"xxhash64(0, {least}, substring_index(line, ' ', {front}))"))
        keys.append(F.expr(f"xxhash64(1, {least}, substring_index(line, ' ', {front} - ({least})))"))
    halves = words.select("code", F.explode(F.array(*keys)).alias("half"))
    shared = halves.groupBy("half").agg(F.min("code").alias("low"), F.max("code").alias("high")).filter("low <> high")
    bitmap = saved(key_bitmap(shared.select("half")), "shared-halves")
    flag = None
    likely = words
    for i, key in enumerate(keys):
        likely = with_maybe(likely, [key], bitmap, f"h{i}")
        flag = F.col(f"h{i}") if flag is None else flag | F.col(f"h{i}")
    likely = likely.filter(flag).select("code", "line").dropDuplicates(["code"])
    likely = saved(likely.join(distinct.select("code", "first"), "code"), "likely-lines").withColumn("words", F.split("line", " "))
    variants = likely.select("code", F.explode(F.sequence(F.lit(1), F.size("words"))).alias("place"), "words")
    variants = variants.select("code", "place", F.xxhash64(_without(F.col("words"), F.col("place"))).alias("variant"))
    keyed = saved(variants.withColumn("key", F.xxhash64("variant", "place")), "variants")
    firsts = likely.select("code", "first")
    # changes: the same variant at the same place; every member meets the earliest
    twice = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    members = with_maybe(keyed.select("code", "key"), [F.col("key")], key_bitmap(twice), "maybe").filter("maybe")
    members = saved(members.drop("maybe").join(firsts, "code"), "changed-lines")
    changed = members.groupBy("key").agg(F.min(F.struct("first", "code")).alias("best"), F.count("*").alias("n"))
    pairs = join_groups(members, saved(changed.filter("n > 1"), "changed"), "key", "n").filter("best.first < first").select(
        "code", "first", F.col("best.code").alias("other"), F.col("best.first").alias("earlier")
    )
    # insertions: a whole line equals a variant; each side meets the earliest of the other
    inserted = with_maybe(keyed.select("code", "variant"), [F.col("variant")], key_bitmap(likely.select("code")), "maybe")
    inserted = saved(inserted.filter("maybe").drop("maybe").join(firsts, "code"), "inserted-lines")
    longer = inserted.groupBy("variant").agg(F.min(F.struct("first", "code")).alias("best"))
    shorter = firsts.join(longer, F.col("code") == F.col("variant")).filter("best.first < first")
    pairs = pairs.union(shorter.select("code", "first", F.col("best.code"), F.col("best.first")))
    whole = firsts.select(F.col("code").alias("other"), F.col("first").alias("earlier"))
    wider = inserted.join(whole, F.col("variant") == F.col("other")).filter("earlier < first")
    pairs = pairs.union(wider.select("code", "first", "other", "earlier")).distinct()
    # the hashes named the pairs; the words decide
    texts = likely.select("code", "words")
    checked = pairs.join(texts, "code").join(
        texts.select(F.col("code").alias("other"), F.col("words").alias("other_words")), "other"
    ).filter(one_edit(F.col("words"), F.col("other_words")))
    return checked.groupBy("code").agg(F.min("earlier").alias("earlier"))


def one_edit(a: Column, b: Column) -> Column:
    """Whether two word lists differ by one change, insertion or deletion at most."""
    shorter = F.least(F.size(a), F.size(b))
    same = F.aggregate(
        F.sequence(F.lit(1), F.greatest(shorter, F.lit(1))),
        F.lit(0),
        lambda n, i: F.when((n == i - 1) & (i <= shorter) & F.try_element_at(a, i).eqNullSafe(F.try_element_at(b, i)), i).otherwise(n),
    )
    rest = lambda w, skip: F.array_join(F.slice(w, same + 1 + skip, F.size(w)), " ")
    return F.when(F.size(a) == F.size(b), rest(a, F.lit(1)) == rest(b, F.lit(1))).when(
        F.size(a) == F.size(b) + 1, rest(a, F.lit(1)) == rest(b, F.lit(0))
    ).when(F.size(b) == F.size(a) + 1, rest(b, F.lit(1)) == rest(a, F.lit(0))).otherwise(F.lit(False))


def line_report(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_lines, n_equal, n_near, dropped) for every row: its lines with a word, the repeated
    ones and their numbers, comma-joined. A document's own numbers are all that is gathered."""
    found = duplicate_lines(docs, id_column, text_column)
    by_doc = found.groupBy(F.col(id_column).alias("id")).agg(
        F.count_distinct(F.when(~F.col("near"), F.col("number"))).alias("n_equal"),
        F.count_distinct(F.when(F.col("near"), F.col("number"))).alias("n_near"),
        F.array_join(F.array_sort(F.collect_set("number")), ",").alias("dropped"),
    )
    count = F.size(F.filter(F.split(text_of(text_column), "\n"), lambda x: F.regexp_like(x, F.lit("[^ \\t-\\r]"))))
    rows = docs.select(F.col(id_column).alias("id"), count.cast("long").alias("n_lines"))
    return rows.join(by_doc, rows["id"].eqNullSafe(by_doc["id"]), "left").select(
        rows["id"].alias(id_column), "n_lines", F.coalesce("n_equal", F.lit(0)).cast("long").alias("n_equal"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.coalesce("dropped", F.lit("")).alias("dropped"),
    )


def drop_duplicate_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` without the repeated lines, all columns as they were. Texts without one stay in place."""
    found = duplicate_lines(docs, id_column, text_column)
    numbers = saved(found.groupBy(F.col(id_column).alias("__id")).agg(F.collect_set("number").alias("__drop")), "dropped-lines")
    same = without_ids(docs, numbers.select(F.col("__id").alias(id_column)), id_column)
    changed = docs.join(numbers, F.col(id_column) == F.col("__id"))
    kept = F.filter(F.split(F.col(text_column), "\n"), lambda x, i: ~F.array_contains(F.col("__drop"), i))
    return same.unionByName(changed.withColumn(text_column, F.array_join(kept, "\n")).select(*docs.columns))
