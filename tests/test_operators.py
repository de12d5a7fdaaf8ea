"""Operators against brute force, skewed input, and plan shape."""

import random
from collections import Counter

import pandas as pd
import pyarrow.parquet as pq
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallyroute.functions import text as T, vocab
from tallyroute.operators import (
    cleaning, keywords, lookup, ordering as O, selection, statistics as S, userfn as U, validation as K,
)
from tallyroute.plans.labelling import label_queries
from tallyroute.plans.table_job import run_table_job
from tallyroute.sources import commits, sinks
from tallyroute.sources.commits import committed
from tallyroute.sources.gazetteer import build_gazetteer
from tallyroute.sources.tables import TableLayout, check_columns, read_requests
from tallyroute.operators.detectors import default_detectors
from tallyroute.streaming.requests import progress_totals, read_stream, run_batches, run_stream, write_batch

DETECTORS = default_detectors("orbit desk")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- positions, samples -----------------------------------------------------------

def test_positions_for_clustered_and_negative_ids(spark):
    rng = random.Random(3)
    ids = sorted({rng.randrange(100) for _ in range(60)} | {-5, -70000, 2**40, 2**40 + 1, 65536, 65535})
    df = spark.createDataFrame([(i,) for i in rng.sample(ids, len(ids))], "query_id bigint")
    got = {r.query_id: r.position for r in O.with_positions(df).collect()}
    assert got == {i: n for n, i in enumerate(ids)}


def test_positions_of_hashed_ids(spark):
    rng = random.Random(4)
    ids = sorted(rng.randrange(-2**63, 2**63) for _ in range(3000))
    df = spark.createDataFrame([(i,) for i in rng.sample(ids, len(ids))], "query_id bigint")
    got = {r.query_id: r.position for r in O.with_positions(df).collect()}
    assert got == {i: n for n, i in enumerate(ids)}


def test_portable_hash_takes_ids_of_any_size(spark):
    df = spark.createDataFrame([(i,) for i in (0, 2**40, 2**62 + 5, 2**63 - 1, -3)], "query_id bigint")
    got = {r.query_id: r.h for r in df.select("query_id", O.portable_hash("query_id", 7).alias("h")).collect()}
    assert got == {i: ((i % 2**31) * 2654435761 + 7) % 2**32 for i in got}


def test_positions_of_null_repeated_and_text_keys(spark):
    rows = [(None, "a"), (1, "b"), (2**62, "c"), (None, "a"), (1, "b"), (-1, None), (1, "a"), (None, "z")] * 40
    df = spark.createDataFrame(rows, "query_id bigint, t string")
    got = O.with_positions(df).collect()
    assert sorted(r.position for r in got) == list(range(len(rows)))
    assert Counter((r.query_id, r.t) for r in got) == Counter(rows)
    by_place = [r.query_id for r in sorted(got, key=lambda r: r.position)]
    assert by_place == sorted((r[0] for r in rows), key=lambda i: (i is None, i))
    text = [r.t for r in sorted(O.with_positions(df, ["t", "query_id"]).collect(), key=lambda r: r.position)]
    assert text == sorted((r[1] for r in rows), key=lambda t: (t is None, t))
    assert O.with_positions(df.limit(0)).collect() == []
    named = df.withColumnRenamed("t", "_tie").withColumn("_at", F.lit(1)).withColumn("_part", F.lit(2))
    assert O.with_positions(named).columns == ["query_id", "_tie", "_at", "_part", "position"]


def test_positions_do_not_depend_on_the_partitions(spark):
    df = spark.range(500).selectExpr("id % 7 as query_id", "id as x", "map('k', id) as m")
    one = {(r.x, r.position) for r in O.with_positions(df.repartition(1)).collect()}
    assert one == {(r.x, r.position) for r in O.with_positions(df.repartition(13)).collect()}


def test_a_key_of_a_third_of_the_rows_is_spread_over_ranges(spark):
    df = spark.range(30_000).selectExpr("if(id % 3 = 0, 5, id) as query_id", "'same' as t")
    numbered = O.with_positions(df)
    assert numbered.select("position").distinct().count() == 30_000
    sizes = [pq.read_metadata(f.removeprefix("file://")).num_rows for f in numbered.inputFiles()]
    assert sum(sizes) == 30_000 and max(sizes) < 10_000


def test_positions_have_no_window_over_rows(inputs):
    text = plan(O.with_positions(inputs.records))
    assert text.count("SinglePartition") <= 1 and "Python" not in text


SELECT_ROWS = [(i * 7919 % 1000 - 500 if i % 9 else None, i % 5, f"s{i % 3}") for i in range(3000)]


@pytest.mark.parametrize("n", [0, 41, 2999, 9999])
@pytest.mark.parametrize("order", [["a", "b"], ["a"], ["s", "a", "b"]])
def test_selection_equals_a_sort(spark, monkeypatch, n, order):
    monkeypatch.setattr(selection, "FEW_ROWS", 0)
    monkeypatch.setattr(selection, "BOUNDARY_ROWS", 50)
    df = spark.createDataFrame(SELECT_ROWS, "a bigint, b int, s string")
    got = [tuple(r[c] for c in order) for r in selection.smallest_rows(df, n, order).collect()]
    key = lambda row: tuple((v is None, v) for v in row)
    want = sorted((tuple(dict(zip("abs", r))[c] for c in order) for r in SELECT_ROWS), key=key)[:n]
    assert sorted(got, key=key) == want


def test_selection_takes_the_same_of_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(selection, "FEW_ROWS", 0)
    monkeypatch.setattr(selection, "BOUNDARY_ROWS", 10)
    df = spark.range(2000).selectExpr("id % 3 as k", "id as x")
    one = {r.x for r in selection.smallest_rows(df.repartition(2), 100, ["k"]).collect()}
    two = {r.x for r in selection.smallest_rows(df.repartition(9), 100, ["k"]).collect()}
    assert one == two and len(one) == 100 and all(x % 3 == 0 for x in one)


def test_large_selection_sorts_and_gathers_nothing(spark):
    df = spark.range(200_000).selectExpr("xxhash64(id) as h", "id")
    chosen = selection.smallest_rows(df, 100_000, ["h", "id"])
    assert "Limit" not in plan(chosen) and "TakeOrdered" not in plan(chosen)
    assert chosen.count() == 100_000
    bound = chosen.agg(F.max("h")).first()[0]
    assert df.filter(F.col("h") <= bound).count() == 100_000


def test_quotas_with_a_hot_group(spark, monkeypatch):
    monkeypatch.setattr(selection, "BOUNDARY_ROWS", 20)
    rows = [(i, "hot" if i % 3 else f"g{i % 7}") for i in range(3000)]
    df = spark.createDataFrame(rows, "query_id bigint, g string")
    quotas = {"hot": 1500, "g0": 2, "g3": 10**6, "absent": 4, "g6": 0}
    got = selection.smallest_rows(df, quotas, ["query_id"], "g")
    want = []
    for name, limit in quotas.items():
        want += sorted(i for i, g in rows if g == name)[:limit]
    assert sorted(r.query_id for r in got.collect()) == sorted(want) and got.columns == df.columns
    assert selection.smallest_rows(df, {}, ["query_id"], "g").count() == 0


def test_first_per_group_with_a_hot_group(spark):
    rows = [(i, "hot" if i % 3 else f"g{i % 7}") for i in range(3000)]
    df = spark.createDataFrame(rows, "query_id bigint, g string")
    got = O.first_per_group(df, "g", [F.col("query_id")], {"hot": 1500, "g0": 2, "g3": 10**6}, salts=8)
    want = []
    for name, limit in (("hot", 1500), ("g0", 2), ("g3", 10**6)):
        want += sorted(i for i, g in rows if g == name)[:limit]
    assert sorted(r.query_id for r in got.collect()) == sorted(want)


def test_until_critical_keeps_everything_without_a_critical_error(spark):
    df = spark.createDataFrame([(i, None if i % 2 else "slow") for i in range(10)], "query_id bigint, error string")
    assert O.until_critical(df).count() == 10
    stopped = O.until_critical(df.withColumn("error", F.expr("if(query_id in (4, 7), 'a CRITICAL one', error)")))
    assert sorted(r.query_id for r in stopped.collect()) == [0, 1, 2, 3, 4]


def test_sample_is_repeatable_and_bounded(inputs):
    one = [r.query_id for r in O.sample_rows(inputs.records, 50, seed=1).collect()]
    assert one == [r.query_id for r in O.sample_rows(inputs.records, 50, seed=1).collect()]
    assert one != [r.query_id for r in O.sample_rows(inputs.records, 50, seed=2).collect()]
    assert O.sample_rows(inputs.records, 10**6).count() == inputs.records.count()


# --- keywords ------------------------------------------------------------------------

def expected_keywords(text, language):
    stop = set(vocab.STOP_WORDS.get(language, ()))
    kept = [t.lower() for t in text.split() if t.lower() not in stop]
    return [w for w, _ in Counter(t for t in kept if len(t) > 2).most_common(10)]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("abcA \t ", max_size=60), min_size=1, max_size=8))
def test_keywords_match_brute_force(spark, texts):
    rows = [(i, t, "en" if i % 2 else "unknown") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id bigint, text string, lang string")
    want = {i: expected_keywords(t, lang) for i, t, lang in rows}
    in_row = df.withColumn("k", F.expr(T.tokens("text"))).selectExpr("id", T.keywords("k", "lang") + " as w")
    assert {r.id: r.w for r in in_row.collect()} == want
    job = keywords.document_keywords(df, "id", "text", "lang")
    assert {r.id: r.keywords for r in job.collect()} == {i: w for i, w in want.items() if w}


def test_keyword_job_shuffles_once(inputs):
    text = plan(keywords.document_keywords(inputs.documents, "doc_id", "text", "lang"))
    assert text.count("Exchange hashpartitioning") == 1


def test_keyword_job_shuffles_neither_texts_nor_tokens(inputs):
    text = plan(keywords.document_keywords(inputs.documents, "doc_id", "text", "lang"))
    assert "Generate" not in text and "first(_text" not in text


def test_keywords_of_texts_cut_into_pieces(spark, monkeypatch):
    monkeypatch.setattr(keywords, "PIECE", 7)
    texts = ["Alpha beta  the\u3000beta\x1fGAMMA ΟΔΟΣ\u00a0ΟΔΟΣ. İstanbul abc\n", "x" * 50 + " ab", " " * 20, "\t\tthe abc"]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "id bigint, text string, lang string")
    got = {r.id: r.keywords for r in keywords.document_keywords(df, "id", "text", "lang").collect()}
    assert got == {i: w for i, t in enumerate(texts) if (w := expected_keywords(t, "en"))}


# --- gazetteer ------------------------------------------------------------------------

def test_gazetteer_match_inline_equals_joined(spark):
    names = ["Hà Nội", "Nội Bài", "Thành phố Hồ Chí Minh", "Huế", "nan", "", "a b c d e f g", "x_y"]
    gaz = build_gazetteer(spark.createDataFrame([(n,) for n in names], "n string"))
    rng = random.Random(5)
    pool = ["hà", "Nội", "bài", "thành", "phố", "hồ", "chí", "minh", "huế", "a", "b", "c", "d", "e", "f", "g",
            "hà_nội", "x", "y", "x_y", "__", "!", ","]
    texts = [" ".join(rng.choices(pool, k=rng.randrange(0, 12))) for _ in range(300)] + [None, "Sân bay Nội-Bài"]
    df = spark.createDataFrame(list(enumerate(texts)), "query_id bigint, query string")
    inline = lookup.location_matches(df, "query_id", "query", gaz)
    joined = lookup.location_matches(df, "query_id", "query", gaz, inline_limit=0, broadcast_rows=0)
    assert sorted(inline.collect()) == sorted(joined.collect())
    flags = {r.query_id for r in inline.collect()}
    names = lookup.inline_names(gaz)
    test = df.withColumn("w", F.expr(lookup.place_word_list("query"))).selectExpr(
        "query_id", lookup.mentions_location("query", "w", names) + " as hit")
    assert {r.query_id for r in test.collect() if r.hit} == flags


@pytest.mark.parametrize("broadcast_rows", [0, 1000])
def test_prefix_levels_equal_brute_force(spark, broadcast_rows):
    """Names of up to 40 words that share prefixes; long texts, underscores, repeated and missing ids."""
    rng = random.Random(11)
    pool = ["old", "north", "bay", "of", "the", "hill", "x"]
    long_name = " ".join(rng.choices(pool, k=40))
    names = {" ".join(rng.choices(pool, k=k)) for k in (1, 2, 2, 3, 4, 5, 8, 9, 17)}
    names |= {long_name, *(" ".join(long_name.split()[:k]) for k in (2, 3, 16))}
    names -= {w for w in pool}  # else every text has a match of one word
    texts = [" ".join(rng.choices([*pool, "old_north", "_", "bay__of"], k=rng.randrange(0, 90))) for _ in range(150)]
    texts += [f"to the {long_name} and back", long_name.replace(" ", "_"), "x " * 300 + long_name, "", None, texts[0]]
    df = spark.createDataFrame(
        [(n % 9 or None, t) for n, t in enumerate(texts)], "query_id bigint, query string"
    )
    gaz = build_gazetteer(spark.createDataFrame([(n,) for n in names], "n string"))
    found = lookup.location_matches(df, "query_id", "query", gaz, inline_limit=0, broadcast_rows=broadcast_rows)

    def brute(text):
        parts = text.split()
        for n in range(min(40, len(parts)), 0, -1):
            for at in range(len(parts) - n + 1):
                gram = " ".join(" ".join(parts[at : at + n]).replace("_", " ").split())
                if gram in names:
                    return gram, n, at

    want = [(n % 9 or None, *hit) for n, t in enumerate(texts) if t and (hit := brute(t))]
    got = [(r.query_id, r.location, r.n_tokens, r.position) for r in found.collect()]
    assert want and sorted(got, key=str) == sorted(want, key=str)


def test_long_name_does_not_multiply_candidates(spark):
    """A name of 40 words beside short ones: candidates are formed only behind matching prefixes."""
    names = [("red house", 2), (" ".join(["red", "door"] * 20), 40)]
    levels = lookup.name_levels(spark.createDataFrame(names, "gram string, size int"), 40)
    assert [width for width, _ in levels] == [1, 2, 4, 8, 16, 32]
    first = {r.prefix: (sorted(r.sizes), r.more) for r in levels[0][1].collect()}
    second = {r.prefix: (sorted(r.sizes), r.more) for r in levels[1][1].collect()}
    assert first == {"red": ([], True)}
    assert second == {"red house": ([2], False), "red door": ([], True)}


def test_known_locations_of_a_large_table_keep_every_row(spark):
    df = spark.createDataFrame([(1, "Huế"), (1, "Huế"), (None, "hue"), (2, "x"), (3, None)], "query_id bigint, query string")
    gaz = build_gazetteer(spark.createDataFrame([("Huế",), ("Hà Nội",)], "n string"))
    rows = [lookup.known_locations(df, "query", gaz, rows=n).collect() for n in (0, 100)]
    assert sorted(map(str, rows[0])) == sorted(map(str, rows[1])) and len(rows[0]) == 3
    assert rows[0][0].asDict().keys() == {"query_id", "query"}


def test_balanced_sample_counts_rows_not_ids(spark, inputs):
    from tallyroute.plans.evaluation import balanced_sample

    shared = inputs.typed.withColumn("query_id", F.expr("nullif(query_id div 50, 0)"))
    categories = [r[0] for r in balanced_sample(shared).select("category").distinct().collect()]
    sample = balanced_sample(shared, dict.fromkeys(categories, 3))
    counts = {r.category: r["count"] for r in sample.groupBy("category").count().collect()}
    assert counts and max(counts.values()) <= 3


def test_size_check(spark):
    small, large = spark.range(5), spark.range(50)
    assert lookup.fits(small, 5) and not lookup.fits(large, 49)


# --- cleaning, validation, sources ----------------------------------------------------

def test_strict_check_names_the_record(inputs):
    with pytest.raises(PySparkException, match="record "):
        cleaning.check_strict(inputs.typed).collect()


def test_missing_columns_are_all_named(spark):
    with pytest.raises(ValueError, match="missing columns: knowledge_domain, worker"):
        check_columns(spark.createDataFrame([("a",)], "query string"))


def test_read_formats_with_other_names(spark, inputs, tmp_path):
    layout = TableLayout("text", "area", "agents", ";")
    raw = inputs.corpus.selectExpr("query_id", "query as text", "knowledge_domain as area",
                                   "replace(worker, ',', ';') as agents")
    want = sorted(inputs.requests.select("query_id", "workers").collect())
    for fmt, path in sinks.export(raw, str(tmp_path), ("csv", "json", "parquet")).items():
        typed = cleaning.typed_table(read_requests(spark, path, fmt, layout), layout.separator)
        assert sorted(typed.select("query_id", "workers").collect()) == want
    with pytest.raises(ValueError, match="unsupported format"):
        read_requests(spark, "x", "xlsx")


def test_large_csv_files_are_split(spark, tmp_path):
    path = str(tmp_path / "csv")
    spark.range(20_000).selectExpr("id as query_id", "'some text to fill the file' as query", "'D' as knowledge_domain", "'W' as worker").coalesce(1).write.csv(path, header=True)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128k")
    try:
        assert read_requests(spark, path, "csv").rdd.getNumPartitions() > 1
        assert read_requests(spark, path, "csv", multi_line=True).rdd.getNumPartitions() == 1
        assert read_requests(spark, path, "csv").count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_csv_files_with_other_headers_are_errors(spark, tmp_path):
    good = "query_id,query,knowledge_domain,worker\n1,a,D,W\n"
    folder = tmp_path / "same"
    folder.mkdir()
    (folder / "a.csv").write_text(good)
    (folder / "b.csv").write_text(good.replace("1,a", "2,b"))
    assert sorted(r.query for r in read_requests(spark, str(folder), "csv").collect()) == ["a", "b"]
    for name, other in (("swapped", "query_id,worker,knowledge_domain,query\n2,W,D,b\n"), ("short", "query_id,query,worker\n2,b,W\n")):
        folder = tmp_path / name
        folder.mkdir()
        (folder / "a.csv").write_text(good + "3,c,D,W\n")
        (folder / "b.csv").write_text(other)
        for columns in (["query_id", "query", "knowledge_domain", "worker"], ["query", "worker"]):
            with pytest.raises(Exception, match="(?i)header"):
                read_requests(spark, str(folder), "csv").select(*columns).collect()


def test_missing_json_columns_are_errors(spark, tmp_path):
    path = str(tmp_path / "json")
    spark.createDataFrame([(1, "a")], "query_id bigint, query string").write.json(path)
    with pytest.raises(ValueError, match="knowledge_domain, worker"):
        read_requests(spark, path, "json")


def test_row_functions_keep_large_and_missing_integers(spark):
    df = spark.createDataFrame([(2**53 + 1, "a"), (None, "b")], "query_id bigint, query string")
    rows = U.apply_rows(df, lambda r: {"query_id": r["query_id"], "seen": str(r["query_id"])}, "query_id bigint, seen string").collect()
    assert {(r.query_id, r.seen) for r in rows} == {(2**53 + 1, str(2**53 + 1)), (None, "None")}
    noted = U.annotate(df, lambda: lambda text: {"tokens": [text]}).collect()
    assert {(r.query_id, r.tokens[0]) for r in noted} == {(2**53 + 1, "a"), (None, "b")}


def test_partial_functions_do_not_depend_on_group_size(spark):
    df = spark.createDataFrame([(i, "g" if i else "h", float(i)) for i in range(500)], "query_id bigint, g string, x double")

    def sums(part):
        return part.groupby("g").agg(n=("x", "size"), s=("x", "sum")).reset_index()

    for rows in (1, 7, 640):
        got = U.apply_groups(df, "g", sums, "g string, n bigint, s double", [(F.sum("s") / F.sum("n")).alias("mean")], rows=rows)
        assert {r.g: r["mean"] for r in got.collect()} == {"g": 250.0, "h": 0.0}


def test_export_reports_errors_and_goes_on(spark, inputs, tmp_path):
    done = sinks.export(inputs.requests.drop("workers_list"), str(tmp_path), ("xlsx", "json", "csv"))
    assert done["xlsx_error"] == "Unsupported format: xlsx"
    assert set(done) == {"xlsx_error", "json", "csv"}
    # a column type the format cannot hold fails only that format
    done = sinks.export(inputs.requests, str(tmp_path / "b"), ("csv", "json"))
    assert "csv_error" in done and "json" in done
    again = sinks.manifest(spark, done)
    assert again.agg(F.sum("records")).first()[0] == inputs.requests.count()


def test_table_job(inputs, tmp_path):
    job = run_table_job(inputs.dirty, str(tmp_path), ("parquet",))
    row = job.analysis.first()
    assert row.row_count == inputs.records.count() and job.rejected.count() > 0
    assert sum(r.query_count for r in job.domains.collect()) == row.row_count
    assert sum(r.query_count for r in job.labels.collect()) == row.label_assignments


def test_size_warnings(spark):
    rows = [("q" * 10001, "D", ["a"]), ("q", "D-1", [str(i) for i in range(11)]), ("q", "D 1", ["b!"])]
    df = spark.createDataFrame(rows, "query string, knowledge_domain string, workers_list array<string>")
    got = [r.warnings for r in K.validate(df).collect()]
    assert got == [[vocab.LONG_QUERY], [vocab.MANY_LABELS], [vocab.DOMAIN_CHARACTERS, vocab.LABEL_CHARACTERS + "b!"]]


def test_composite_success_threshold(spark):
    df = spark.createDataFrame([(True, True), (True, False), (True, True)], "a boolean, b boolean")
    row = S.composite_success(df, ["a", "b"]).first()
    assert (row.tests, row.passed, row.success_rate, row.suite_passed) == (6, 5, 83.333333, True)
    assert S.composite_success(df.limit(0), ["a", "b"]).first().success_rate == 0.0


# --- user functions -----------------------------------------------------------------------

def test_no_batch_of_a_hot_group_is_above_the_bound(spark):
    df = spark.range(30_000, numPartitions=2).selectExpr("id as query_id", "if(id % 3 = 0, 'cold', if(id = 1, null, 'hot')) as g")

    def count(part):
        assert len(part) <= 1000 and part["g"].nunique(dropna=False) == 1
        return pd.DataFrame({"g": [part["g"].iloc[0]], "n": [len(part)], "most": [len(part)]})

    got = U.apply_groups(df, "g", count, "g string, n bigint, most bigint", [F.sum("n").alias("n"), F.max("most").alias("most")], rows=1000)
    assert {r.g: r.n for r in got.collect()} == {"hot": 19_999, "cold": 10_000, None: 1}
    text = plan(got).split("Initial Plan")[-1]
    # partial rows are merged before they are shuffled, and rows of the table never are
    assert "FlatMapGroups" not in text and text.count("Exchange hashpartitioning") == 1
    assert text.index("MapInArrow") > text.index("partial_sum")


def test_group_functions_with_rows_of_odd_types(spark):
    rows = [(1, "a", [1, 2], 2**53 + 1), (2, "a", None, None), (3, None, [], 5)]
    df = spark.createDataFrame(rows, "query_id bigint, g string, xs array<int>, big bigint")

    def biggest(part):
        values = [v for v in part["big"] if v is not None and v == v]
        return pd.DataFrame({"g": [part["g"].iloc[0]], "big": pd.array([int(max(values))] if values else [None], "Int64")})

    got = U.apply_groups(df, "g", biggest, "g string, big bigint", [F.max("big").alias("big")])
    assert {r.g: r.big for r in got.collect()} == {"a": 2**53 + 1, None: 5}
    assert U.apply_groups(df.limit(0), "g", biggest, "g string, big bigint", [F.max("big").alias("big")]).collect() == []


def test_partial_rows_are_combined_in_the_task(spark):
    df = spark.range(4000, numPartitions=1).selectExpr("id as query_id", "'g' as g")
    seen = spark.sparkContext.accumulator(0)

    def count(part):
        return pd.DataFrame({"g": ["g"], "n": [len(part)], "calls": [1]})

    def together(parts):
        seen.add(1)
        return parts.groupby("g", dropna=False, as_index=False).agg(n=("n", "sum"), calls=("calls", "sum"))

    got = U.apply_groups(
        df, "g", count, "g string, n bigint, calls bigint", [F.sum("n").alias("n"), F.sum("calls").alias("calls")],
        rows=10, combine=together, held=50,
    ).first()
    assert (got.n, got.calls) == (4000, 400) and seen.value >= 7


# --- streaming ----------------------------------------------------------------------------------

def test_stream_equals_batch_and_resumes(spark, inputs, tmp_path):
    corpus = inputs.corpus
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    corpus.filter("query_id < 400").repartition(3).write.parquet(source)

    def label(df):
        return label_queries(df, DETECTORS, gazetteer=inputs.gazetteer, top=2).select("query_id", "labels", "votes")

    def go():
        run_stream(read_stream(spark, source, corpus.schema, files_per_batch=1), label, out, state)

    go()
    corpus.filter("query_id >= 400").write.mode("append").parquet(source)
    go()
    go()
    assert sorted(spark.read.parquet(out).collect()) == sorted(label(corpus).collect())


def test_counters_cover_every_batch(spark, inputs, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    inputs.corpus.filter("query_id < 500").repartition(110).write.parquet(source)
    stream = read_stream(spark, source, inputs.corpus.schema, files_per_batch=1)
    run_batches(stream, lambda s: s.selectExpr("query_id", "if(query_id % 10 = 0, 'bad', null) as error"), out, state, failed="error is not null")
    assert progress_totals(spark, out).first().asDict() == {"processed": 500, "successful": 450, "failed": 50}


def test_a_batch_delivered_again_replaces_itself(spark, inputs, tmp_path):
    out = str(tmp_path / "out")
    for _ in range(2):
        found = write_batch(inputs.corpus, 3, lambda s: s.select("query_id"), out, failed="query_id < 10")
    assert committed(spark, out, "query_id bigint").count() == inputs.corpus.count()
    assert progress_totals(spark, out).first().asDict() == {
        "processed": found["processed"], "successful": inputs.corpus.count() - 10, "failed": 10}


def test_a_batch_that_dies_before_its_entry_is_not_seen(spark, tmp_path, monkeypatch):
    path, schema = str(tmp_path / "t"), "id bigint"
    assert committed(spark, path, schema).count() == 0 and commits.totals(spark, path).first().processed == 0
    commits.commit_batch(spark.range(10), path, "day")
    commits.commit_batch(spark.range(100, 103), path, "other")

    def die(*_):
        raise OSError("gone")

    with monkeypatch.context() as broken:
        broken.setattr(commits, "_write_entry", die)
        with pytest.raises(OSError):
            commits.commit_batch(spark.range(50, 55), path, "day")
    assert sorted(r.id for r in committed(spark, path, schema).collect()) == [*range(10), 100, 101, 102]
    commits.commit_batch(spark.range(50, 55), path, "day")
    assert sorted(r.id for r in committed(spark, path, schema).collect()) == [*range(50, 55), 100, 101, 102]
    assert commits.totals(spark, path).first().processed == 8
    assert commits.damaged_batches(spark, path, schema).count() == 0
    # a folder that lost a file no longer fits its entry
    entry = commits.entries(spark, path).filter("batch = 'other'").first()
    spark.range(100, 102).write.mode("overwrite").parquet(f"{path}/data/batch_folder={entry.folder}")
    assert [r.batch for r in commits.damaged_batches(spark, path, schema).collect()] == ["other"]
    commits.commit_batch(spark.range(0), path, "other")
    assert commits.damaged_batches(spark, path, schema).count() == 0


def test_counts_of_an_export_are_taken_while_it_is_written(spark, inputs, tmp_path):
    counted = {}
    done = sinks.export(inputs.records.select("query_id", "query"), str(tmp_path), ("csv", "json", "parquet", "xml"), counted=counted)
    rows = {r.format: r for r in sinks.manifest_at_write(spark, done, counted).collect()}
    assert {r.records for r in rows.values()} == {inputs.records.count()} and set(rows) == {"csv", "json", "parquet"}
    assert sum(r.size_bytes for r in sinks.manifest(spark, {"csv": done["csv"]}).collect()) == rows["csv"].size_bytes
    text = plan(sinks.manifest_at_write(spark, done, counted))
    assert "content" not in text.replace("contentFilter", "")


# --- predictions, labels and keywords of repeated and null ids -------------------------------------

def test_one_prediction_per_id(spark):
    rows = [(1, ["a"], 1), (1, ["b"], 2), (2, ["c"], 1), (2, ["c"], 1), (3, ["x"], None), (3, ["y"], 0), (None, ["z"], 9), (4, ["p"], 5), (4, ["q"], 5)]
    predicted = spark.createDataFrame(rows, "query_id bigint, predicted array<string>, attempt int")
    expected = spark.createDataFrame([(i, ["e"]) for i in (1, 1, 2, 3, 5, None)], "query_id bigint, expected array<string>")
    got = lookup.pair_predictions(expected, predicted, latest=["attempt"]).collect()
    assert Counter((r.query_id, tuple(r.predicted), r.success) for r in got) == Counter({
        (1, ("b",), True): 2, (2, ("c",), True): 1, (3, ("y",), True): 1, (5, (), False): 1, (None, (), False): 1})
    clashes = lookup.clashing_predictions(predicted, latest=["attempt"]).collect()
    assert {(r.query_id, r.n_answers, r.reason) for r in clashes} == {(4, 2, "different answers"), (None, 1, "no id")}
    one = {r.query_id: r.predicted for r in lookup.settle_predictions(predicted.repartition(5)).collect()}
    assert one == {r.query_id: r.predicted for r in lookup.settle_predictions(predicted.coalesce(1)).collect()}


@pytest.mark.parametrize("rows", [0, 10**6])
def test_joined_labels_of_repeated_and_null_ids(spark, rows):
    df = spark.createDataFrame([(1, ["A", "B"]), (1, ["C"]), (None, ["A"]), (2, []), (3, None), (4, ["B", "Z", "B", None])], "id bigint, labels array<string>")
    mapping = spark.createDataFrame([("A", "X"), ("B", "Y"), ("C", "Y")], "label string, group string")
    got = lookup.map_labels_by_table(df, "id", "labels", mapping, rows=rows)
    assert got.columns == ["id", "labels", "mapped"]
    assert sorted(((r.id, r.mapped) for r in got.collect()), key=repr) == sorted(
        [(1, ["X", "Y"]), (1, ["Y"]), (None, ["X"]), (2, []), (3, []), (4, ["Y", "Z", None])], key=repr)


def test_keywords_of_repeated_and_null_ids(spark):
    texts = [(1, "alpha beta beta"), (1, "gamma"), (None, "delta delta"), (1, "alpha beta beta"), (2, None), (3, "")]
    df = spark.createDataFrame([(i, t, "en") for i, t in texts], "id bigint, text string, lang string")
    got = Counter((r.id, tuple(r.keywords)) for r in keywords.document_keywords(df, "id", "text", "lang").collect())
    assert got == Counter({(1, ("beta", "alpha")): 2, (1, ("gamma",)): 1, (None, ("delta",)): 1})


# --- plan shape -------------------------------------------------------------------------------------

def test_labelling_stays_in_the_jvm_without_joins_or_shuffles(spark, inputs, tmp_path):
    path = str(tmp_path / "c")
    inputs.corpus.write.parquet(path)
    text = plan(label_queries(spark.read.parquet(path).select("query_id", "query"), DETECTORS, gazetteer=inputs.gazetteer))
    for word in ("Python", "Exchange", "Join", "Sort "):
        assert word not in text
    assert "ReadSchema: struct<query_id:bigint,query:string>" in text


def test_filters_on_labels_do_not_repeat_the_work(spark, inputs):
    df = label_queries(inputs.corpus, DETECTORS, gazetteer=inputs.gazetteer).filter("labels[0] = 'REMINDER_AGENT'")
    optimized = df._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.count("erinnern") == label_queries(
        inputs.corpus, DETECTORS, gazetteer=inputs.gazetteer)._jdf.queryExecution().optimizedPlan().toString().count("erinnern")


def test_domain_filter_reaches_the_scan(spark, inputs, tmp_path):
    path = str(tmp_path / "r")
    inputs.records.write.parquet(path)
    from tallyroute.operators import filters
    text = plan(filters.combined(spark.read.parquet(path), "mạng", "BRCD", None))
    assert "EqualTo(knowledge_domain,BRCD)" in text
