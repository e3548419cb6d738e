from __future__ import annotations

import hashlib
import random
import struct

import public_tokenizers
import pytest
import regex
import tiktoken

from ticketmill.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(PATH)


@pytest.fixture(scope="module")
def own(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def expected(own, text):
    ids = own.encode_ordinary(text or "")
    raw = struct.pack(f"<{len(ids)}I", *ids)
    return len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


TEXTS = [
    None, "", " ", "\n\n  \t x", "It's they'll WE'RE", "<|endoftext|> is text", "naïve Straße 東京 🙂🙂", "aaaaaaaaaaaaaaaaaaaab" * 40,
    "0123456789 " * 30, "a" * 5000, "!!! ??? ...     end", "the the the", "the the the",
]


def test_rows_as_tiktoken(spark, own):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "null id", "y"), (3, TEXTS[3], "x")],
                               "doc_id long, text string, n_tokens string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.ids_sha256, r.decoded_sha256)
                 for r in bpe.encode_documents(df, PATH, public_tokenizers.PATTERN).collect())
    rows = list(enumerate(TEXTS)) + [(-1, "null id"), (3, TEXTS[3])]
    assert got == sorted((i, *expected(own, t)) for i, t in rows)


def test_random_words(ranks, own):
    rng = random.Random(5)
    words = {"".join(rng.choice("abehinorst ÉñßZ09'") for _ in range(rng.randint(1, 60))) for _ in range(3000)}
    encoder = bpe.Encoder(bpe.Vocabulary(ranks), public_tokenizers.PATTERN)
    assert all(list(struct.unpack(f"<{len(b) // 4}I", b)) == own.encode_ordinary(w) for w in words for b in [encoder.ids(w)])


def test_lower_rank_made_by_a_merge():
    # 'bc' merges at rank 9, which makes 'abc' of the lower rank 4 before the second 'bc'
    ranks = {b"a": 0, b"b": 1, b"c": 2, b"abc": 4, b"cb": 8, b"bc": 9, b"abcb": 10}
    own = tiktoken.Encoding("small", pat_str=r"\w+", mergeable_ranks=ranks, special_tokens={})
    for word in ("abcbc", "abcabc", "bcabcb", "cbabcbcb"):
        assert bpe.replay([word.encode()], bpe.Vocabulary(ranks))[0] == own.encode_ordinary(word) or word.encode() in ranks


@pytest.mark.parametrize("together", [1, 2, 10**9])
def test_merges_at_once_and_one_by_one(ranks, own, monkeypatch, together):
    monkeypatch.setattr(bpe, "TOGETHER", together)
    rng = random.Random(8)
    words = ["".join(rng.choices("aab tthheeinors'", k=rng.randrange(0, 30))) for _ in range(2000)]
    words += ["a" * k for k in range(1, 60)] + ["ab" * k for k in range(1, 40)]
    pieces = [w for text in words for w in regex.findall(public_tokenizers.PATTERN, text)]
    vocabulary = bpe.Vocabulary(ranks)
    for word, ids in zip(pieces, bpe.replay([w.encode() for w in pieces], vocabulary)):
        assert b"".join(vocabulary.token[i] for i in ids) == word.encode()
        # words that are one token are looked up before any merge
        assert ids == own.encode_ordinary(word) or word.encode() in ranks
    small = bpe.Vocabulary({b"a": 0, b"b": 1, b"c": 2, b"abc": 4, b"cb": 8, b"bc": 9, b"abcb": 10})
    listed = [w.encode() for w in ("abcbc", "abcabc", "bcabcb", "cbabcbcb") for _ in range(5)]
    assert bpe.replay(listed, small) == [bpe.replay([w], small)[0] for w in listed]
    with pytest.raises(ValueError):
        bpe.replay([b"abd"], small)


def test_long_text_streams(spark, ranks, own, monkeypatch):
    monkeypatch.setattr(bpe, "LONG_TEXT", 10)
    encoder = bpe.Encoder(bpe.Vocabulary(ranks), public_tokenizers.PATTERN)
    text = "many words in a row, " * 50
    assert list(encoder.digests([text, "x"])) == [expected(own, text), expected(own, "x")]


def test_ids_and_empty(spark, own):
    df = spark.createDataFrame([(1, "hello world")], "doc_id long, text string")
    out = bpe.encode_documents(df, PATH, public_tokenizers.PATTERN, with_ids=True)
    assert out.first().ids == own.encode_ordinary("hello world")
    assert bpe.encode_documents(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
