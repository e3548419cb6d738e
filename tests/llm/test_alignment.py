from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from ticketmill.llm import alignment
from ticketmill.llm.queries import BYTE_LEVEL, PIECES

SCHEMA = "doc_id long, text string, n_a string, text_key int, tiles int, salt int"


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(BYTE_LEVEL)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PIECES)


def token_bytes(libraries):
    a, b = libraries
    # the byte-level characters, found by encoding every byte that is a text
    table = alignment.byte_level_table()
    left = {k: bytes(table[c] for c in v) for v, k in a.get_vocab(with_added_tokens=False).items()}
    right = {}
    for i in range(b.get_piece_size()):
        piece = b.id_to_piece(i)
        code = re.fullmatch("<0x(..)>", piece)
        right[i] = bytes([int(code[1], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()
    return left, right


def brute(libraries, rows):
    """The contract, whole text by whole text."""
    a, b = libraries
    left, right = token_bytes(libraries)
    per_row, corpus = [], Counter()
    for doc_id, text in rows:
        ids_a = a.encode(" " + (text or ""), add_special_tokens=False).ids
        ids_b = b.encode(text or "")
        whole = (" " + (text or "")).encode()
        if not text or b"".join(left[i] for i in ids_a) != whole or b"".join(right[i] for i in ids_b) != whole:
            per_row.append((doc_id, 0, 0, "", []))
            continue
        ends_a, ends_b, at = [], [], 0
        for i in ids_a:
            ends_a.append(at := at + len(left[i]))
        at = 0
        for i in ids_b:
            ends_b.append(at := at + len(right[i]))
        groups, links, ga, gb, j = [], [], [], [], 0
        for i, end in zip(ids_a, ends_a):
            ga.append(str(i))
            while j < len(ids_b) and ends_b[j] <= end:
                gb.append(str(ids_b[j]))
                if ends_b[j] == end:
                    links.append((i, ids_b[j]))
                    groups.append(",".join(ga) + "|" + ",".join(gb))
                    ga, gb = [], []
                j += 1
        corpus.update(links)
        per_row.append((doc_id, len(ids_a), len(ids_b), ";".join(groups), links))
    best = Counter()
    for (_, j), n in corpus.items():
        best[j] = max(best[j], n)
    return sorted((
        (doc_id, n_a, n_b, groups.count(";") + bool(groups), len(links), sum(corpus[p] == best[p[1]] for p in links),
         sum(corpus[p] for p in links), hashlib.sha256(groups.encode()).hexdigest() if groups else "")
        for doc_id, n_a, n_b, groups, links in per_row), key=str)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
TEXTS = [
    None, "", " ", "   ", "\n", "\n\n x\ty ", "the cat sat", "the cat sat", "the cat  sat ", "tail \n", "naïve Straße 東京 🙂🙂 é́",
    "a▁b", "▁", "if (x) {\r\n\t}\r\n end;\r y\r", "a\r b\r\r c", "<|endoftext|> and <s> </s> <0x41> [INST]", "one\x1ctwo\x1f three\x1d\x1e", "!\x1c?　x\xa0y z\x85w",
    "nul\x00l \x00", "x" * 300, "word" * 200 + " " + "!?" * 90, "​ ‍", "ﬁ ½ １", "'s 're it's ' s", " leading", "　",
]


def run(spark, rows, partitions=3):
    df = spark.createDataFrame([(i, t, "x", 1, 2, 3) for i, t in rows], SCHEMA).repartition(partitions)
    found = alignment.align_documents(df, BYTE_LEVEL, PIECES)
    assert found.columns == COLUMNS
    return sorted(map(tuple, found.collect()), key=str)


def test_edges_as_brute_force(spark, libraries):
    rows = [*enumerate(TEXTS), (6, "the cat sat"), (None, "the cat sat"), (None, None)]
    assert run(spark, rows) == brute(libraries, rows)


def test_copies_count_and_hot_texts_are_dealt_out(spark, libraries, monkeypatch):
    rng = random.Random(3)
    words = ["alpha", "beta", "Gamma,", "delta-9", "\n", "zwölf", "12345", "..."]
    rows = [(k, "the hot text of many rows") for k in range(400)]
    rows += [(1000 + k, " ".join(rng.choices(words, k=rng.randrange(1, 30)))) for k in range(200)]
    monkeypatch.setattr(alignment, "HOT_SHARE", 8)
    assert run(spark, rows, 7) == brute(libraries, rows)


def test_small_cache_and_long_text(libraries, monkeypatch):
    monkeypatch.setattr(alignment, "CACHE_WORDS", 50)
    monkeypatch.setattr(alignment, "TOGETHER", 100)
    rng = random.Random(5)
    aligner = alignment.Aligner(open(BYTE_LEVEL, "rb").read(), open(PIECES, "rb").read())
    assert aligner.by_words
    text = "".join(rng.choice(" \n\t") * rng.randrange(1, 3) + "".join(rng.choices("abcé9!", k=rng.randrange(1, 9)))
                   for _ in range(180_000))
    assert len(text) > 1_000_000
    n_a, n_b, n_groups, n_links, digest, codes, times = aligner.measure([text])[0]
    [(_, *expected)] = brute(libraries, [(0, text)])
    assert [n_a, n_b, n_groups, n_links, digest] == [expected[k] for k in (0, 1, 2, 3, 6)]
    assert times.sum() == n_links and len(aligner.known) <= 50 + 100_000
    assert len(codes) <= aligner.pair_bound()


def test_whole_texts_where_words_cannot_be_told(libraries):
    aligner = alignment.Aligner(open(BYTE_LEVEL, "rb").read(), open(PIECES, "rb").read())
    expected = [m[:5] for m in aligner.measure(["the cat  sat", "a\nb c "])]
    aligner.known.clear()
    aligner.by_words = False
    assert [m[:5] for m in aligner.measure(["the cat  sat", "a\nb c "])] == expected


def test_empty_table_and_one_text_per_shuffled_row(spark):
    assert run(spark, []) == []
    df = spark.createDataFrame([(1, "x y", "", 0, 0, 0), (2, "x y", "", 0, 0, 0), (3, None, "", 0, 0, 0)], SCHEMA)
    found = alignment.distinct_texts(df).collect()
    assert [(r.text, r.copies) for r in found] == [("x y", 2)]
    assert public_tokenizers.path("piece_bpe_32k.model") == PIECES
