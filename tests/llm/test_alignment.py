"""Tokenizer alignment against a walk over the tokens of each text."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tallyroute.llm import alignment, queries

from ..conftest import DATA
from .samples import AWKWARD, documents, read


@pytest.fixture(scope="module")
def both():
    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def brute_text(both, text):
    """Ids, links as a counter of id pairs, and the groups as text; nothing without tokens."""
    a_tok, b_tok = both
    if not text:
        return [], [], Counter(), ""
    a_ids = a_tok.encode(" " + text, add_special_tokens=False).ids
    b_ids = b_tok.encode(text)
    byte_of = {c: x for x, c in ((x, chr(x)) for x in [*range(33, 127), *range(161, 173), *range(174, 256)])}
    byte_of |= {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in set(byte_of.values()))}
    a_bytes = [bytes(byte_of[c] for c in a_tok.id_to_token(i)) for i in a_ids]
    b_bytes = []
    for i in b_ids:
        piece = b_tok.id_to_piece(i)
        is_byte = len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">")
        b_bytes.append(bytes([int(piece[3:5], 16)]) if is_byte else piece.replace("▁", " ").encode())
    want = b" " + text.encode()
    if b"".join(a_bytes) != want or b"".join(b_bytes) != want:
        return [], [], Counter(), ""
    spans = []
    for parts in (a_bytes, b_bytes):
        at, out = 0, []
        for p in parts:
            out.append((at, at + len(p)))
            at += len(p)
        spans.append(out)
    links, groups = Counter(), []
    i = j = 0
    left, right = [a_ids[0]], [b_ids[0]]
    while True:
        links[a_ids[i], b_ids[j]] += 1
        end_a, end_b = spans[0][i][1], spans[1][j][1]
        if end_a == end_b:
            groups.append(",".join(map(str, left)) + "|" + ",".join(map(str, right)))
            i, j = i + 1, j + 1
            if i == len(a_ids):
                return a_ids, b_ids, links, ";".join(groups)
            left, right = [a_ids[i]], [b_ids[j]]
        elif end_a < end_b:
            i += 1
            left.append(a_ids[i])
        else:
            j += 1
            right.append(b_ids[j])


def brute_rows(both, source):
    known = {t: brute_text(both, t) for t in {t for _, t in source}}
    counts = Counter(pair for _, t in source for pair in known[t][2])
    most = {}
    for (a, _), n in counts.items():
        most[a] = max(most.get(a, 0), n)
    out = Counter()
    for doc_id, t in source:
        a, b, links, groups = known[t]
        out[
            doc_id, len(a), len(b), groups.count(";") + bool(groups), sum(links.values()),
            sum(m for p, m in links.items() if counts[p] == most[p[0]]), sum(m * counts[p] for p, m in links.items()),
            hashlib.sha256(groups.encode()).hexdigest() if groups else "",
        ] += 1
    return out


NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def rows_of(df):
    assert df.columns == NAMES and {k for _, k in df.dtypes[1:-1]} == {"bigint"}
    return Counter(tuple(r) for r in df.collect())


def test_merge_of_random_ends_does_not_depend_on_the_pieces():
    rng = np.random.default_rng(4)
    for _ in range(300):
        size = int(rng.integers(1, 60))
        a, b = (np.append(np.flatnonzero(rng.random(size) < rng.choice([0.1, 0.5, 0.9])), size) + 1 for _ in "ab")
        want = set()
        for i in range(len(a)):
            for j in range(len(b)):
                if max(a[i - 1] if i else 0, b[j - 1] if j else 0) < min(a[i], b[j]):
                    want.add((i, j))
        shared = sorted(set(a) & set(b))
        for piece in (1, 2, 3, 7, 1000):
            first, second, group_a, group_b = alignment.align(a, b, piece)
            assert len(first) == len(want) and set(zip(first.tolist(), second.tolist())) == want
            assert group_a.tolist() == [sum(s < e for s in shared) for e in a]
            assert group_b.tolist() == [sum(s < e for s in shared) for e in b]


def test_pieces_have_equal_work():
    rng = np.random.default_rng(5)
    a, b = (np.sort(rng.choice(10**6, n, replace=False)) for n in (9000, 100))
    at_a, at_b = alignment.diagonal_splits(a, b, 500)
    work = np.diff(at_a) + np.diff(at_b)
    assert (work[:-1] == 500).all() and work[-1] <= 500 and at_a[-1] == 9000 and at_b[-1] == 100


TEXTS = [
    "Hello world, this is tokenization", "Ünïcödé 日本 😀 ﬁ ﬁle", "two  spaces", "tabs\tand\nlines", " leads", "ends ",
    "a<|endoftext|>b", "<s> </s> <unk>", "▁mark", "<0x41>", "é combining", " nbsp", "​zero", "x" * 500, "1234567890" * 9,
]


def test_rows_equal_brute_force(spark, both):
    rng = random.Random(8)
    source = [*enumerate(TEXTS), (99, TEXTS[0]), (99, TEXTS[0]), (None, TEXTS[0]), (None, None), (7, "")]
    letters = "ab cdé.,\n日😀 "
    source += [(100 + i, "".join(rng.choice(letters) for _ in range(rng.randint(1, 80)))) for i in range(200)]
    df = documents(spark, [(i, t, "s") for i, t in source], extra=True)
    want = brute_rows(both, source)
    assert sum(n for row, n in want.items() if row[1]) > 150
    for hot in (0, 40, 10**6):  # all pairs by a shuffle, some by a broadcast, all by a broadcast
        assert rows_of(alignment.align_tokenizers(df, piece=7, hot_pairs=hot)) == want


def test_the_broadcast_is_bounded(spark):
    counts = spark.createDataFrame([(c,) for c in [1] * 50 + [2, 3] * 20 + [4] * 9 + [100]], "count long")
    for most in (0, 1, 5, 10, 30, 50, 60, 1000):
        bound = alignment._hot_bound(counts, most)
        assert counts.filter(counts["count"] >= bound).count() <= most
    assert alignment._hot_bound(counts, 50) == 2 and alignment._hot_bound(counts, 1000) == 1
    assert alignment._hot_bound(counts.limit(0), 10) == 1


def test_awkward_rows(spark, both):
    source = [(r[0], r[1]) for r in AWKWARD]
    assert rows_of(alignment.align_tokenizers(documents(spark, AWKWARD))) == brute_rows(both, source)
    assert alignment.align_tokenizers(documents(spark, [])).count() == 0


def test_query_equals_brute_force(spark, both):
    source = [(r.doc_id, r.text) for r in read(spark, DATA, "documents").collect()]
    want = brute_rows(both, source)
    assert rows_of(queries.op12_alignment(spark, DATA)) == want
    assert sum(n for row, n in want.items() if row[1]) > 0.9 * len(source)
