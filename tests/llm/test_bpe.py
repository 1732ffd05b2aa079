"""Byte-level BPE against tiktoken, and the round trip."""

import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from cuewright.llm import bpe


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(None, P.path("byte_bpe_multi_50k.tiktoken"))


def test_encode_is_tiktoken(ranks):
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ours = bpe.Codec(ranks, P.PATTERN)
    rng = random.Random(1)
    texts = ["", "<|endoftext|>", "a" * 3000, " " * 2000 + "x", "thth" * 900, "日本" * 700, "it's we'll I'M"]
    texts += ["".join(rng.choice("\x1c\x85\xa0 ²½Ⅷ٣一_-$#ab c\n\té日😀'sthe  ") for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    for t in texts:
        ids = ours.encode(t)
        assert ids == theirs.encode_ordinary(t)
        assert ours.decode(ids) == t.encode()


def test_merge_of_one_byte_and_nothing(ranks):
    assert bpe.merge(b"", ranks) == [] and bpe.merge(b"a", ranks) == [ranks[b"a"]]


def test_cache_is_bounded(ranks, monkeypatch):
    monkeypatch.setattr(bpe, "KEEP_PIECES", 10)
    codec = bpe.Codec(ranks, P.PATTERN)
    text = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200))
    assert codec.decode(codec.encode(text)) == text.encode() and len(codec.known) <= 10


def test_operator(spark, ranks):
    rows = [(1, "the cat", 1, "x"), (1, "the cat", 1, "x"), (None, None, 2, "x"), (2, "", 3, "x"), (3, "z" * 50_000, 4, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, ids string")
    got = bpe.digest(df, ranks, P.PATTERN).collect()
    assert len(got) == 5
    for r in got:
        text = next(t for i, t, *_ in rows if i == r["doc_id"]) or ""
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert {r["n_tokens"] for r in got if r["doc_id"] in (None, 2)} == {0}
    back = bpe.decode(bpe.encode(df, ranks, P.PATTERN), ranks)
    assert sorted(r["text"] for r in back.collect()) == sorted(t or "" for _, t, *_ in rows)
    assert bpe.digest(spark.createDataFrame([], "doc_id long, text string"), ranks, P.PATTERN).count() == 0
