"""Hand-derived rows for the detectors, label mapping, normalising and entity spans."""

import pytest
from pyspark.sql import functions as F

from tallyroute.functions import text as T, vocab
from tallyroute.functions.labels import map_labels
from tallyroute.operators import detectors as D, entities as N
from tallyroute.plans.analysis import analyze
from tallyroute.plans.labelling import VOTES, label_queries, label_votes
from tallyroute.sources.gazetteer import build_gazetteer

DETECTORS = D.default_detectors("orbit desk")
GOLDEN = [
    ("Orbitdesk là gì", {2: 1.0}),
    ("Orbit  desk là gì", {2: 1.0}),
    ("/remind me to call mom", {7: 1.0}),
    ("Số điện thoại của tôi là 0912345678", {7: 0.55, 6: 0.45}),
    ("Top 5 tỉnh có hiệu suất cao hơn 50%", {0: 0.8, 1: 0.2}),
    ("Chất lượng mạng từ ngày 3/1/2024", {5: 0.75, 7: 0.25}),
    ("Quy trình phê duyệt click như thế nào", {1: 1.0}),
    ("nation_3", {3: 0.6, 1: 0.2, 4: 0.2}),
    ("Tài khoản tungdd12 thuộc phòng nào", {6: 0.9, 7: 0.1}),
    ("Đồng chí Đào Duy Tùng là ai", {2: 1.0}),
    ("Bạn làm được gì?", {2: 1.0}),
    ("xyz view", {}),
    ("", {}),
    (None, {}),
]


def frame(spark, texts):
    return spark.createDataFrame(
        list(enumerate(texts)), "query_id bigint, query string"
    )


@pytest.fixture(scope="module")
def gazetteer(spark):
    return build_gazetteer(spark.createDataFrame([(f"NATION_{i}",) for i in range(5)], "n string"))


@pytest.mark.parametrize("inline_limit", [100, 0])
def test_votes(spark, gazetteer, inline_limit):
    df = frame(spark, [t for t, _ in GOLDEN])
    rows = label_votes(df, DETECTORS, gazetteer=gazetteer, inline_limit=inline_limit).collect()
    got = {r.query_id: {i: r[v] for i, v in enumerate(VOTES) if r[v]} for r in rows}
    assert got == {i: votes for i, (_, votes) in enumerate(GOLDEN)}


def test_ties_and_zero_votes_rank_by_name(spark):
    row = label_queries(frame(spark, ["xyz view"]), DETECTORS).first()
    assert row.labels == sorted(vocab.LABELS)
    assert set(row.votes) == {0.0}


def test_person_entity(spark):
    df = frame(spark, ["Đồng chí Đào Duy Tùng là ai"]).withColumn("entities", F.expr(
        "array(named_struct('text', 'Đào Duy Tùng', 'label', 'PER', 'start', 9, 'end', 21))"))
    row = label_votes(df, DETECTORS, entities="entities").first()
    assert {i: row[v] for i, v in enumerate(VOTES) if row[v]} == {6: 0.5, 7: 0.5}


COMRADE = [
    ("đồng chí: “Đào Duy” ở đâu", [("PER", 11)], False),     # after punctuation and a quote
    ("đồng chí ở đâu, Đào Duy", [("PER", 16)], True),        # the name is further away
    ("đồng chí đồng chí Lan", [("PER", 18)], True),          # the first one has no name
    ("đồng chíx Lan", [("PER", 10)], False),                 # not a whole word
    ("hđồng chí Lan", [], False),
    ("đồng chí Lan", [("LOC", 9)], True),
    ("đồng   chí Lan", [("PERSON", 11)], False),
    ("không có gì", [], False),
]


def test_comrade_with_entities(spark):
    rows = [
        (i, text, [("x", label, start, start + 3) for label, start in ents])
        for i, (text, ents, _) in enumerate(COMRADE)
    ]
    df = spark.createDataFrame(rows, f"query_id bigint, query string, entities {T.ENTITIES}")
    flag = D.comrade(D.TextViews.of("query", "entities"))
    got = [r[0] for r in df.orderBy("query_id").selectExpr(flag).collect()]
    assert got == [want for _, _, want in COMRADE]


COMMANDS = [
    ("/remind me to call mom", (1, 0, 0, 0)),
    ("please /task finish work", (0, 1, 0, 0)),
    ("use /tasks to organize", (0, 0, 1, 0)),
    ("schedule /meeting tomorrow", (0, 0, 0, 1)),
    ("/remind and /task both", (1, 1, 0, 0)),
    ("no commands here", (0, 0, 0, 0)),
    ("/remind /task /meeting all", (1, 1, 0, 1)),
    ("the folder contains /tasks for x", (0, 0, 0, 0)),
    ("begin /task now", (0, 0, 0, 0)),            # the veto word has no left edge
    ("in /tasks or /task", (0, 0, 0, 0)),         # the veto has no right edge
    ("in /tasks or \\task", (0, 1, 0, 0)),
    ("a/task", (0, 0, 0, 0)),
]


def test_commands(spark):
    flags = D.command_flags(D.TextViews.of("query"))
    df = frame(spark, [t for t, _ in COMMANDS]).orderBy("query_id")
    got = [tuple(int(x) for x in r) for r in df.selectExpr(*flags.values()).collect()]
    assert got == [want for _, want in COMMANDS]


SINGLE = [
    # detector expression, hits, misses
    (D.phone, ["a 0 912 345 678", "+84912345678", "x0912345678y"], ["00912345678", "091234567"]),
    (D.user_id, ["id 123456.", "123456"], ["1234567", "a123456", "12345"]),
    (D.self_reference, ["tôi đi", "cháux", "vợ  mày"], ["tôim", "xem phim", "mày"]),
    (D.short_definition, ["adsl là gì vậy"], ["adsl là gìx"]),
    (lambda v: D.quantity_flags(v)["regex"], ["hạng 3", "50 %a"], ["50%", "tophat 3"]),
    (lambda v: D.quantity_flags(v)["keyword"], ["max 3", "thống kê"], ["admin", "maximum"]),
    (lambda v: D.time_flags(v)["regex"], ["9:05", "thứ tư", "năm 2024"], ["123:456", "3024"]),
    (D.simple_question, ["a b?", "nó là gì"], [" ".join(["a"] * 13) + "?", " ".join(["là gì"] * 9)]),
]


@pytest.mark.parametrize("case", range(len(SINGLE)))
def test_hits_and_misses(spark, case):
    build, hits, misses = SINGLE[case]
    expression = build(D.TextViews.of("query"))
    df = frame(spark, hits + misses).orderBy("query_id").selectExpr(f"{expression} as hit")
    assert [r.hit for r in df.collect()] == [True] * len(hits) + [False] * len(misses)


def test_label_mapping(spark):
    raw = ["REGION_IDENTIFIER_AGENT", "FUNCTION_CALLER_AGENT", "DOCS_SEARCHER_AGENT", "WEBS_SEARCHER_AGENT"]
    df = spark.createDataFrame([(raw,)], "a array<string>").selectExpr(map_labels("a") + " as m")
    assert df.first().m == ["FUNCTION_CALLING", "DOC_SEARCH", "WEBS_SEARCHER_AGENT"]


def test_normalize(spark):
    df = frame(spark, ["Khánh Hòa", "Đà_Nẵng", "  A-B/C ", "été", None])
    got = [r[0] for r in df.orderBy("query_id").selectExpr(T.normalize("query")).collect()]
    assert got == ["khanh hoa", "đa nang", "a b c", "ete", ""]


TOKENS = ["x", "Đào", "Duy", "là", "Lan", "Hà_Nội", "x", "a", "Huế", "b"]
TAGS = ["I-PER", "B-PER", "I-PER", "O", "B-PER", "B-LOC", "I-LOC", "O", "I-LOC", "O"]
SPANS = [("Đào Duy", "PER"), ("Lan", "PER"), ("Hà_Nội x", "LOC")]


def test_entity_spans(spark):
    rows = [(1, i, t, g) for i, (t, g) in enumerate(zip(TOKENS, TAGS))]
    table = spark.createDataFrame(rows, "query_id bigint, pos int, token string, tag string")
    got = N.fold_tag_rows(table).orderBy("span").collect()
    assert [(r.text, r.label) for r in got] == SPANS
    df = spark.createDataFrame([(TOKENS, TAGS, " ".join(TOKENS))], "k array<string>, g array<string>, q string")
    ents = df.selectExpr(N.fold_tags("k", "g", "q") + " as e").first().e
    assert [(e.text, e.label) for e in ents] == SPANS
    assert (ents[0].start, ents[0].end) == (2, 9)


# --- detectors: texts that must hit and texts that must miss, patterns written out by hand ---------

SUB_DETECTORS = {
    "remind": (lambda v: D.command_flags(v)["remind"],
               ["/remind me", "please /remind us", "\\remind now", "ok /remind", "/REMIND all"],
               ["remind me", "/reminder", "a folder", "the/remindx", ""]),
    "tasks": (lambda v: D.command_flags(v)["tasks"],
              ["use /tasks to organize", "/tasks", "show /tasks now", "\\tasks", "/Tasks please"],
              ["the folder contains /tasks for x", "/task", "tasks", "/tasksx", ""]),
    "user_id": (D.user_id, ["123456", "id 000123 here", "(654321)", "a 111111", "999999."],
                ["12345", "1234567", "a123456", "12 3456", ""]),
    "phone": (D.phone, ["0912345678", "gọi 0912345678 nhé", "+84912345678", "09 1234 5678", "x0912345678y"],
              ["091234567", "1912345678", "09123456789", "phone", ""]),
    "name": (lambda v: D.names_assistant(v, "orbit desk"),
             ["orbit desk", "Orbitdesk là gì", "hỏi ORBIT  DESK", "(orbitdesk)", "orbit desk?"],
             ["orbit", "desk orbit", "orbitdesks", "xorbitdesk", ""]),
}


@pytest.mark.parametrize("name", SUB_DETECTORS)
def test_sub_detector_hits_and_misses(spark, name):
    flag, hits, misses = SUB_DETECTORS[name]
    rows = frame(spark, hits + misses).selectExpr("query_id", f"{flag(D.TextViews.of('query'))} as hit").collect()
    got = {r.query_id: r.hit for r in rows}
    assert [got[i] for i in range(len(hits + misses))] == [True] * len(hits) + [False] * len(misses)


def test_user_names_are_found_beyond_ten_keywords(spark):
    text = " ".join(f"chủđề{i} chủđề{i}" for i in range(15)) + " tungdd12"
    assert frame(spark, [text]).selectExpr(D.user_name(D.TextViews.of("query")) + " as hit").first().hit


def test_evaluation_in_one_label_space(spark):
    from tallyroute.operators import evaluation as E

    rows = [
        (["FUNCTION_CALLER_AGENT"], ["FUNCTION_CALLING"], True),
        (["DOCS_SEARCHER_AGENT", "REMINDER_AGENT"], ["DOC_SEARCH"], True),
        (["REMINDER_AGENT"], ["DOC_SEARCH"], True),
        (["REMINDER_AGENT"], [], False),
    ]
    df = spark.createDataFrame(rows, "expected array<string>, predicted array<string>, success boolean")
    matches = E.with_matches(df)
    assert tuple(E.exact_set_accuracy(matches).first()) == (3, 1, 0.333333)
    assert {tuple(r) for r in E.hit_rates(matches).collect()} == {
        ("FUNCTION_CALLING", 1, 1, 1.0), ("DOC_SEARCH", 1, 1, 1.0), ("REMINDER", 2, 0, 0.0)}


def test_response_shapes(spark):
    from tallyroute.plans.evaluation import predictions_from_responses

    cases = [
        ('{"success": false, "labels": ["REMINDER_AGENT"]}', [], "failed response"),
        ('{"workers": 5, "result": "REMINDER_AGENT"}', ["REMINDER"], None),
        ('{"workers": ["[x]", 7, "MEETING_AGENT"]}', ["[x]", "MEETING_AGENT"], None),
        ('{"predicted_workers": "[x"}', ["[x"], None),
        ('{"labels": ["DOCS_SEARCHER_AGENT", "REMINDER_AGENT", "X"], "votes": [2, 1, 0]}', ["DOC_SEARCH", "REMINDER"], None),
        ("not json", None, None),
        (None, None, None),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "query_id bigint, response string")
    got = {r.query_id: r for r in predictions_from_responses(df).collect()}
    for i, (_, predicted, error) in enumerate(cases):
        assert got[i].error == error and (got[i].predicted or []) == (predicted or [])


SENTENCES = [
    ("One. Two! Three?", ["One.", "Two!", "Three?"]),
    ("Dr. Smith paid 3.50 to J. R. R. Doe. Then he left", ["Dr. Smith paid 3.50 to J. R. R. Doe.", "Then he left"]),
    ("J.R.R. Doe wrote it, e.g. at www.site.org. Yes.", ["J.R.R. Doe wrote it, e.g. at www.site.org.", "Yes."]),
    ('He said "Stop!" (Really?) Wait...  What?!', ['He said "Stop!"', "(Really?)", "Wait...", "What?!"]),
    ("Xin chào. Tôi ở TP. Hồ Chí Minh! GS. TS. Nguyễn Văn A. đã đến… Ai vậy?",
     ["Xin chào.", "Tôi ở TP. Hồ Chí Minh!", "GS. TS. Nguyễn Văn A. đã đến…", "Ai vậy?"]),
    ("Giá là 1.200.000 đồng. Được không", ["Giá là 1.200.000 đồng.", "Được không"]),
    ("1. first line\n2. second line.\n\nA title\n \nEnd", ["1. first line\n2. second line.", "A title", "End"]),
    ("你好。「再见！」谢谢", ["你好。", "「再见！」", "谢谢"]),
    ("kept\x01a\x02b. c", ["kept a b.", "c"]),
    ("no stop at all\n", ["no stop at all"]),
    (" ... ?! \n\n . ", []),
    ("at 9 a.m. or so. Version 2.10. Next U.S. one", ["at 9 a.m. or so.", "Version 2.10.", "Next U.S. one"]),
    ("", []),
    (None, []),
]


def test_sentences(spark):
    rows = frame(spark, [t for t, _ in SENTENCES]).selectExpr("query_id", f"{T.sentences('query')} as s").collect()
    assert {r.query_id: r.s for r in rows} == {i: want for i, (_, want) in enumerate(SENTENCES)}


def test_analysis_counts_sentences_when_asked(spark):
    df = frame(spark, ["One. Two!", "", None])
    assert [r.sentence_count for r in analyze(df).orderBy("query_id").collect()] == [1, 0, 0]
    assert [r.sentence_count for r in analyze(df, segment=True).orderBy("query_id").collect()] == [2, 0, 0]


def test_sentences_of_a_long_text(spark):
    text = "a b c d. " * 200_000
    assert frame(spark, [text]).selectExpr(f"{T.sentence_count('query')} as n").first().n == 200_000


def test_terms_are_looked_for_only_where_their_letters_can_be(spark):
    from tallyroute.functions import patterns as P
    terms = ["top", "lúc", "đặt", "năm", "nào để", "日本"]
    test = T.contains_any("t", terms)
    assert "octet_length(t) <> length(t)" in test and P.WIDE in test
    texts = ["stop", "lúc", "luc", "é năm", "xđặt", "nào  để", "nào để", "đ", "日本語", "ā", "", "plain", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.f for r in df.selectExpr(f"{test} as f").collect()]
    assert got == [None if t is None else any(x in t for x in terms) for t in texts]


def test_white_space_and_words_as_by_replacing_every_run(spark):
    from tallyroute.functions import patterns as P
    texts = ["a b", "a  b", " a\tb ", "a  b", "a  b", "  ", "", "é_1, ơ!! x", "a-b c", ", a ,", "　x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.selectExpr(
        f"{T.collapse_space('t')} as a", f"trim(regexp_replace(t, {T.quote(P.SPACES)}, ' ')) as b",
        f"{T.word_list('t')} as c", f"split(regexp_replace(t, {T.quote(P.NOT_WORD + '+')}, ' '), ' ') as d").collect()
    assert all(r.a == r.b and r.c == r.d for r in rows)


def test_tests_before_a_pattern_lose_no_match(spark):
    texts = ["x 1/2", "12-3-2020", "at 9:05", "in 1999", "in 2099x", "thứ  hai", "ngày 1  tháng 2", "top5", "hạng \t7", "stop a", "5 %x", "5 %",
             "123456", "a123456", "0912 345 678", "+84 912345678", "09123456", "con  em", "cony em", "tung12", "x tung12 y", "mất  bao \t lâu"]
    df = spark.createDataFrame([(t,) for t in texts], "query string")
    v = D.TextViews.of("query")
    flags = {**D.time_flags(v), **{f"q_{n}": e for n, e in D.quantity_flags(v).items()}, "id": D.user_id(v), "phone": D.phone(v), "self": D.self_reference(v)}
    got = {n: [r.query for r in df.filter(e).collect()] for n, e in flags.items()}
    assert got["regex"] == ["x 1/2", "12-3-2020", "at 9:05", "in 1999", "thứ  hai", "ngày 1  tháng 2"]
    assert got["indicator"] == ["mất  bao \t lâu"]
    assert got["q_regex"] == ["top5", "hạng \t7", "5 %x"]
    assert got["id"] == ["123456"] and got["phone"] == ["0912 345 678", "+84 912345678"]
    assert got["self"] == ["con  em", "cony em"]
