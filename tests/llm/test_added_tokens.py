"""Texts that hold the tokenizer's added token have the ids of ``tokenizers``."""

import random
import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from tallyroute.llm import packing

from .samples import documents


def tokens(texts):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_encoder_cuts_at_added_tokens():
    encoder = packing.Encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN, packing.added_tokens(P.path("byte_bpe_50k.json")))
    rng = random.Random(11)
    parts = ["a", "b c", " ", "\n", "é", "日本", "'s", "12", ".", "\t", "<|endoftext|>", "<|endoftext|>", "<|endof", "|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    assert [x.tolist() for x in encoder.encode_batch(texts)] == tokens(texts)


def test_packed_documents_with_an_added_token(spark):
    texts = ["a<|endoftext|>b", "<|endoftext|>", "one two <|endoftext|>\nthree<|endoftext|>", "plain words"]
    want = [ids + [1] for ids in tokens(texts)]
    assert want[0] == [64, 50256, 65, 1]
    rows = packing.pack_documents(documents(spark, texts)).collect()
    covered = dict.fromkeys(range(len(texts)), 0)
    for r in rows:
        ids = want[r.doc_id]
        covered[r.doc_id] += r.length
        assert r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    assert covered == {i: len(ids) for i, ids in enumerate(want)}
