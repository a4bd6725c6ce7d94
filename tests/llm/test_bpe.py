import base64
import random

import pytest

from skein.llm.bpe import PATTERN, Encoder, encode_corpus, load_ranks

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def ranks():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return load_ranks(f.read())


def naive(ranks, piece):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: (ranks.get(parts[i] + parts[i + 1], 1 << 30), i))
        if parts[best] + parts[best + 1] not in ranks:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return [ranks[p] for p in parts]


TEXTS = [
    "", " ", "Hello  world's\n\n\ttest", "<|endoftext|> is text", "naïve café — “quotes” 日本語 🚀👩‍👩‍👧", "a" * 3000, "ab" * 1500 + "!" * 500, "x\r\n\r\ny", "١٢٣ ½ Ⅷ", "\x00\x1f﻿​", "日" * 700, "''''s 'll 're", " " * 400 + "z",
]


def test_like_the_library(ranks):
    tiktoken = pytest.importorskip("tiktoken")
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = Encoder(ranks)
    rng = random.Random(5)
    made = ["".join(rng.choice("ab cdé\n日1.'🚀\t-_") for _ in range(rng.randrange(200))) for _ in range(300)]
    for t in TEXTS + made:
        assert own.encode(t) == enc.encode_ordinary(t), t[:50]


def test_merge_like_the_plain_loop(ranks):
    own, rng = Encoder(ranks), random.Random(9)
    for _ in range(300):
        piece = bytes(rng.randrange(256) if rng.random() < 0.3 else rng.choice(b"aeinrst lo") for _ in range(rng.randrange(1, 60)))
        assert own.merge(piece) == naive(ranks, piece)


def test_round_trip(ranks):
    own, back = Encoder(ranks), {v: k for k, v in ranks.items()}
    for t in TEXTS:
        assert b"".join(back[i] for i in own.encode(t)).decode() == t


def test_small_vocabulary_prefers_the_leftmost():
    ranks = {bytes([i]): i for i in range(256)} | {b"aa": 256, b"aaa": 257}
    assert Encoder(ranks).merge(b"aaaaa") == [256, 257] == naive(ranks, b"aaaaa")
    assert load_ranks(base64.b64encode(b"xy") + b" 7\n\n") == {b"xy": 7} and PATTERN


def test_frame(spark):
    df = spark.createDataFrame([(1, "hi", "x"), (2, None, "x"), (3, "", "x"), (3, "hi", "x"), (None, "hi", "x")], "doc_id long, text string, ids string")
    got = sorted(((r.doc_id, r.ids) for r in encode_corpus(df, "doc_id", "text", public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()), key=str)
    assert [(k, bool(v)) for k, v in got] == [(1, True), (2, False), (3, True), (3, False), (None, True)]
    assert encode_corpus(df.limit(0), "doc_id", "text", public_tokenizers.path("byte_bpe_50k.tiktoken")).count() == 0
