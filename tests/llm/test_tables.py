"""Archives, quality, toxicity, shards, packing, mixing and the pipeline."""

import base64
import gzip
import hashlib
import io
import pickle
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyroute.llm import mixing, packing, quality, queries, sharding, toxicity, warc

from ..conftest import DATA
from .samples import AWKWARD, SCHEMA, WORDS, documents, read


# ---- archives -------------------------------------------------------------------

def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_archive_round_trip(spark, tmp_path):
    rows = [(1, "http://a/ b%\r\n", "<p>é</p>"), (2, None, None), (3, "u", "<p>é</p>"), (4, "v", ""), (None, "w", "x"), (5, "z", "<p>é</p>")]
    folder, listed = warc.write_warc(pages_of(spark, rows), str(tmp_path / "w"))
    got = {r.url: r for r in warc.read_warc(folder, listed, with_payload=True).collect()}
    assert set(got) == {r[1] for r in rows}
    digest = base64.b32encode(hashlib.sha1("<p>é</p>".encode()).digest()).decode()
    assert [(got[u].record_type, got[u].refers_to, got[u].payload_digest) for u in ("u", "z")] == [("revisit", "5", digest), ("response", None, digest)]
    assert bytes(got["z"].payload).decode() == "<p>é</p>" and got["u"].payload_bytes == 9
    assert (got[None].record_type, got[None].refers_to) == ("revisit", "4")


def test_query_equals_brute_force_pages(spark):
    pages = read(spark, DATA, "pages").collect()
    best = {}
    for p in pages:
        best[p.html or ""] = max(best.get(p.html or "", -1), p.page_id)
    rows = queries.op3_warc(spark, DATA).collect()
    want = {}
    for p in pages:
        data = (p.html or "").encode()
        first = best[p.html or ""] == p.page_id
        want[p.page_id] = (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if first else "revisit", None if first else best[p.html or ""])
    assert {r.page_id: tuple(r)[1:] for r in rows} == want and len(rows) == len(pages)


def test_reader_refuses_broken_archives():
    good = warc.record(1, "u", b"payload" * 9000, None, False)
    stream = lambda *records: io.BytesIO(b"".join(map(warc.gzip_member, records)))
    assert [r.payload_bytes for r in warc.read_records(stream(good, good))] == [63_000, 63_000]
    for bad in (good.replace(b"payload", b"Payload", 1), good[:-5], good + b"x", good.replace(b"sha1:", b"sha1:A", 1)):
        with pytest.raises(ValueError):
            list(warc.read_records(stream(bad)))
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(warc.gzip_member(good)[:-20])))
    assert gzip.decompress(stream(good, good).read()) == good + good


def test_empty_pages(spark):
    folder, listed = warc.write_warc(pages_of(spark, []))
    assert warc.read_warc(folder, listed).count() == 0


# ---- quality --------------------------------------------------------------------

def base_counts(text):
    words = WORDS.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    inside = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(inside)


def test_rule_counts():
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice(["a ", "b ", "c\n", "# ", "é|", "\n", "a b c "]) for _ in range(rng.randint(0, 40)))
        assert quality.rule_counts(text)[:5] == base_counts(text)


def test_quality_query(spark):
    texts = {r.doc_id: r.text for r in read(spark, DATA, "documents").collect()}
    good = {r.doc_id: r.quality for r in read(spark, DATA, "labels").collect()}
    rows = queries.op4_quality(spark, DATA).collect()
    assert len(rows) == len(texts)
    for r in rows:
        counts = base_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        assert r.base_failed == failed and not (failed and r.kept)
    passing = [r for r in rows if not r.base_failed and r.doc_id in good]
    kept = [r.kept for r in passing if good[r.doc_id] == 1]
    assert sum(kept) >= 0.97 * len(kept)


def test_forest_paths_are_short_for_odd_values():
    rng = np.random.default_rng(0)
    x = np.concatenate((np.zeros(5000), rng.uniform(0.3, 3, 300)))
    paths = quality.fit_forest(x).paths(x)
    assert paths[5000:].max() < paths[:5000].min()
    assert quality.fit_forest(np.zeros(0)).paths(np.zeros(3)).tolist() == [0, 0, 0]


def test_quality_of_awkward_rows(spark):
    docs, labels = documents(spark, AWKWARD, extra=True), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality.judge(docs, labels).collect()
    assert len(rows) == len(AWKWARD) and all(r.base_failed for r in rows if r.doc_id != 8)
    assert quality.judge(docs.filter(F.lit(False)), labels).count() == 0


# ---- toxicity -------------------------------------------------------------------

def test_toxicity_on_held_out_rows(spark, tmp_path):
    folder = DATA.replace("sf0.001", "sf0.01")
    marks = {r.doc_id: r.toxic for r in read(spark, folder, "labels").collect()}
    rows = queries.op6_toxicity(spark, folder).collect()
    assert len(rows) == read(spark, folder, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    judged = [(r.predicted, marks[r.doc_id]) for r in rows if r.held_out and r.doc_id in marks]
    assert sum(a == b for a, b in judged) >= 0.96 * len(judged) and sum(a for a, _ in judged) > 0


def test_held_out_labels_are_never_read(spark):
    docs, labels = read(spark, DATA, "documents"), read(spark, DATA, "labels")
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.train(docs, x).curve for x in (labels, turned))
    assert np.array_equal(a, b)


def test_shared_backoff_tells_unseen_forms_by_their_stem():
    words, counts = [], []
    for i in range(400):
        words.append("plain" + "abcdefgh"[i % 8] * (1 + i % 3))
        counts.append((40, 4))
    for end in ("a", "ando", "ito", "ura"):
        words.append("zork" + end)
        counts.append((0, 30))
    import pyarrow as pa

    n0, n1 = zip(*counts)
    batch = pa.RecordBatch.from_arrays([pa.array(words), pa.array(n0, pa.int64()), pa.array(n1, pa.int64())], ["word", "ordinary", "toxic"])
    table = next(toxicity._count_grams(iter([batch])))
    model = toxicity.build_model({n: table.column(n).to_numpy() for n in table.schema.names})
    unseen, usual = model.word_ratios(["zorkelle", "plainb"])
    assert unseen > usual + 1
    sent = pickle.dumps(model)
    assert len(sent) < 1 << 20 and pickle.loads(sent).word_ratios(["zorkelle", "plainb"]).tolist() == [unseen, usual]


def test_toxicity_of_awkward_rows(spark):
    docs = documents(spark, AWKWARD, extra=True)
    labels = spark.createDataFrame([(4, 1, None), (None, 1, 1), (5, 1, 1), (5, 1, 0), (8, 1, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    scored = toxicity.with_toxicity(docs, model)
    assert scored.columns == [*docs.columns, "toxicity"]
    assert all(0 <= r.toxicity <= 1 for r in scored.collect())
    assert toxicity.drop_toxic(docs.filter(F.lit(False)), labels).count() == 0


# ---- shards ---------------------------------------------------------------------

def test_cuts_are_minimax():
    rng = random.Random(4)
    for _ in range(200):
        sizes, shards = [rng.randint(1, 30) for _ in range(rng.randint(0, 12))], rng.randint(1, 4)
        capacity, cuts = sharding.cuts_for(sizes, shards)
        best = {(0, 0): 0}
        for k in range(1, shards + 1):
            for end in range(len(sizes) + 1):
                options = [max(best[k - 1, at], sum(sizes[at:end])) for at in range(end + 1) if (k - 1, at) in best]
                if options:
                    best[k, end] = min(options)
        assert capacity == best[shards, len(sizes)]
        bounds = [0, *cuts, len(sizes)]
        assert len(cuts) < shards and all(sum(sizes[a:b]) <= capacity for a, b in zip(bounds, bounds[1:]))


def check_shards(rows, source):
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in rows) == sorted(
        (i is None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in source
    )
    for shard in {r.shard for r in rows}:
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots))) and 0 <= shard < 16
    by_text = {}
    for r in rows:
        by_text.setdefault((r.size, r.text_crc32), set()).add(r.shard)
    assert all(len(shards) == 1 for shards in by_text.values())


def test_shards(spark):
    source = [(r.doc_id, r.text) for r in read(spark, DATA, "documents").collect()]
    rows = queries.op7_sharding(spark, DATA).collect()
    check_shards(rows, source)
    bytes_ = Counter()
    for r in rows:
        bytes_[r.shard] += r.size
    largest = max(len((t or "").encode()) for _, t in source)
    assert max(bytes_.values()) <= sum(bytes_.values()) / 16 + 2 * largest
    awkward = documents(spark, AWKWARD, extra=True)
    check_shards(sharding.shard_documents(awkward).collect(), [(i, t) for i, t, _ in AWKWARD])
    assert sharding.shard_documents(awkward.filter(F.lit(False))).count() == 0


@pytest.mark.parametrize("range_bits, hot, shards", [(16, 0, 16), (4, 0, 16), (4, 40, 16), (8, 700, 5), (0, 0, 3)])
def test_capacity_is_the_smallest_over_groups(spark, monkeypatch, range_bits, hot, shards):
    """Ranges of many groups, or a group of a third of all bytes: the cuts are those of a search over groups."""
    from hashlib import md5

    monkeypatch.setattr(sharding, "RANGE_BITS", range_bits)
    texts = [f"text {n} " * (1 + n * n % 37) for n in range(1500)] + ["hot " * 30] * hot
    groups = Counter()
    for text in texts:
        groups[md5(text.encode()).hexdigest()] += len(text) + 1
    order = sorted(groups)
    capacity, cuts = sharding.cuts_for([groups[h] for h in order], shards)
    rows = spark.createDataFrame(
        [(md5(t.encode()).hexdigest(), len(t) + 1) for t in texts], "hash string, size long"
    ).coalesce(4).cache()
    found, prefixes = sharding.group_cuts(rows, shards)
    assert found == capacity
    starts = [next(k for k, h in enumerate(order) if h >= p) for p in prefixes]
    assert starts == cuts


def test_shards_stay_native(spark):
    plan = sharding.shard_documents(documents(spark, ["a"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---- packing --------------------------------------------------------------------

def tokens(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [e.ids + [1] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check_packing(rows, source):
    want = Counter()
    for (i, _), ids in zip(source, tokens([t for _, t in source])):
        want[i, tuple(ids)] += 1
    by_id = {}
    for i, ids in want:
        by_id.setdefault(i, []).append(ids)
    covered = Counter()
    for r in rows:
        fits = [ids for ids in by_id[r.doc_id] if len(ids) == r.doc_tokens and zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32]
        assert fits
        covered[r.doc_id] += r.length
    assert covered == Counter({i: sum(len(ids) * want[i, ids] for ids in own) for i, own in by_id.items()})
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    padding = 0
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding == 0


def test_packing(spark):
    source = [(r.doc_id, r.text) for r in read(spark, DATA, "documents").collect()]
    check_packing(queries.op9_packing(spark, DATA).collect(), source)
    awkward = documents(spark, AWKWARD, extra=True)
    check_packing(packing.pack_documents(awkward).collect(), [(i, t) for i, t, _ in AWKWARD])
    assert packing.pack_documents(awkward.filter(F.lit(False))).count() == 0


def test_pieces_encode_as_whole_texts():
    import public_tokenizers as P

    encoder = packing.Encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    rng = random.Random(6)
    parts = ["a", "b c", " ", "  ", "\n", "\t", "\r\n", "é", "日本", "😀", "'s", "12", "!!", ".", ",", "x.", "\x0b", "\x1c", "\xa0", " ", "​", "<|endoftext|>", "²"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    assert [x.tolist() for x in encoder.encode_batch(texts)] == [ids[:-1] for ids in tokens(texts)]


def test_placement_takes_the_least_sum_of_squares():
    rng = random.Random(7)
    packer, counts = packing.Packer(16), [0] * 17
    for i in range(300):
        size = rng.randint(1, 15)
        before = packer.open.copy()
        list(packer.place(i, np.zeros(size, "<u4")))

        def total(fill):
            n = before.copy()
            if fill:
                n[fill] -= 1
            if fill + size < 16:
                n[fill + size] += 1
            return int((n[:16] ** 2).sum())

        fills = [f for f in range(16 - size + 1) if f == 0 or before[f]]
        assert int((packer.open[:16] ** 2).sum()) == min(map(total, fills))
    del counts


# ---- mixing ---------------------------------------------------------------------

def test_targets_and_seats():
    assert mixing.targets_of([10, 100, 100], [5, 2, 1]) == [30.0, 120.0, 60.0]
    assert mixing.targets_of([], []) == [] and mixing.targets_of([0, 0], [5, 2]) == [0.0, 0.0]
    rng = random.Random(8)
    for _ in range(100):
        votes, seats = [rng.choice([0, rng.random() * 100]) for _ in range(rng.randint(1, 6))], rng.randint(0, 60)
        held = [0] * len(votes)
        for _ in range(seats if sum(votes) else 0):
            held[max(range(len(votes)), key=lambda i: (votes[i] / (2 * held[i] + 1), -i))] += 1
        assert mixing.apportion(seats, votes) == held


def check_mix(rows, source):
    sizes = Counter()
    for _, text, name in source:
        sizes[name] += len(WORDS.findall(text or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = [(5, 2, 1)[i % 3] for i in range(len(order))]
    targets = dict(zip(order, mixing.targets_of([sizes[s] for s in order], weights)))
    assert len(rows) == len(source)
    taken = Counter()
    names = {(i, len(WORDS.findall(t or ""))): s for i, t, s in source}
    for r in rows:
        name = names[r.doc_id, r.size]
        assert 0 <= r.taken <= 3 * r.size and abs(r.target - targets[name]) < 1e-6 * max(1, r.target)
        assert r.source_size == sizes[name]
        taken[name] += r.taken
    assert sum(targets.values()) == pytest.approx(sum(sizes.values()))
    for name in order:
        assert abs(taken[name] - targets[name]) <= 64 + 1e-6


def test_mixing(spark):
    source = [(r.doc_id, r.text, r.source) for r in read(spark, DATA, "documents").collect()]
    rows = queries.op10_mixing(spark, DATA).collect()
    check_mix(rows, source)
    assert sorted(rows) == sorted(queries.op10_mixing(spark, DATA).collect())
    check_mix(mixing.mix(documents(spark, AWKWARD, extra=True)).collect(), [r for r in AWKWARD])
    assert mixing.mix(documents(spark, [])).count() == 0


def test_mixed_documents_hold_the_words_taken(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(5 + i)) + " \nend  ", f"s{i % 3}") for i in range(40)]
    docs = documents(spark, rows, extra=True)
    taken = {r.doc_id: r.taken for r in mixing.mix(docs, block=4).collect()}
    out = mixing.mixed_documents(docs, block=4)
    assert out.columns == docs.columns
    words, texts = Counter(), {i: t for i, t, _ in rows}
    for r in out.collect():
        words[r.doc_id] += len(WORDS.findall(r.text))
        assert texts[r.doc_id].startswith(r.text)
    assert words == Counter({i: n for i, n in taken.items() if n})


def test_mixed_documents_keep_rows_of_one_id_apart(spark):
    """Null and repeated ids: rows of other sizes keep their own counts, equal rows share theirs."""
    sizes = [1000, 10, 37, 37, 1, 0]
    rows = [(None, " ".join(f"n{i}x{j}" for j in range(n)), "s") for i, n in enumerate(sizes)]
    rows += [(7, "a b c", "s"), (7, "d e f g h", "t"), (7, None, "t"), (8, "same words here", "t"), (8, "same words here", "t")]
    docs = documents(spark, rows).selectExpr("*", "1 as taken", "2 as copy", "3 as size", "4 as `row`")
    taken = Counter()
    held = Counter()
    for r in mixing.mix(docs, block=4).collect():
        taken[r.doc_id, r.size] += r.taken
        held[r.doc_id, r.size] += 1
    out = mixing.mixed_documents(docs, block=4)
    assert out.columns == docs.columns
    whole = {t: (i, len(t.split())) for i, t, _ in rows if t}
    words = Counter()
    for r in out.collect():
        assert (r.taken, r.copy, r.size, r.row) == (1, 2, 3, 4)
        key = next(k for t, k in whole.items() if t.startswith(r.text) and k[0] == r.doc_id)
        words[key] += len(WORDS.findall(r.text))
    assert any(taken.values())
    for key, n in taken.items():
        assert n - held[key] < words[key] <= n or not n


# ---- pipeline -------------------------------------------------------------------

def test_pipeline_stages(spark):
    from . import test_groups

    docs = read(spark, DATA, "documents")
    left = docs
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES[:4]:
        before = {(r.doc_id): r.text for r in left.collect()}
        left = corpus_pipeline.saved(stage(spark, left, DATA), "test")
        assert left.columns == docs.columns
        after = [(r.doc_id, r.text) for r in left.collect()]
        if name == "exact_dedup":
            assert len(after) == len({test_groups.bare(t) for t in before.values()})
        if name == "simhash_near_dedup":
            _, names = test_groups.near_components(list(before.items()))
            assert sorted(i for i, _ in after) == sorted(i for i, c in names.items() if i == c)
        if name in ("exact_dedup", "toxicity"):
            assert all(before[i] == t for i, t in after)
    rows = corpus_pipeline.run(spark, DATA).collect()
    check_packing(rows, [(r.doc_id, r.text) for r in left.collect()])


def test_pipeline_of_awkward_rows(spark, tmp_path):
    extra = documents(spark, AWKWARD).select(*[c.split()[0] for c in SCHEMA.split(", ")])
    for name, rows in (("awkward", extra), ("empty", extra.filter(F.lit(False)))):
        folder = str(tmp_path / name)
        rows.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        assert corpus_pipeline.run(spark, folder).count() > 0 or name == "empty"
