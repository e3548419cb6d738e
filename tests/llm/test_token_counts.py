from __future__ import annotations

import random

import pytest
import sentencepiece
from tokenizers import Tokenizer

from ticketmill.llm import token_counts
from ticketmill.llm.queries import BYTE_LEVEL, PIECES

SCHEMA = "doc_id long, text string, n_tokens string, id int"
TEXTS = [
    None, "", " ", "    ", "\n\n x\ty ", "the cat  sat ", "naïve Straße 東京 🙂🙂 é́", "a▁b ▁▁ c", "<s> </s> <0x41> <|endoftext|>x",
    "nul\x00l \x00", "x" * 3000, "one\x1ctwo\x1f !\x1c?", "　x\xa0y z\x85w", "word " * 500, "\n".join("line %d" % k for k in range(300)),
    "東京都" * 400, "!?" * 700, "a\n" * 400, "   ".join("xyz") * 60,
]


def libraries(path):
    if path.endswith(".json"):
        library = Tokenizer.from_file(path)
        return lambda text: len(library.encode(text, add_special_tokens=False).ids)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda text: len(library.encode(text))


@pytest.mark.parametrize("path", [PIECES, BYTE_LEVEL])
@pytest.mark.parametrize("long_text", [10, 100, 100_000])
def test_rows_as_the_library(spark, monkeypatch, path, long_text):
    monkeypatch.setattr(token_counts, "LONG_TEXT", long_text)
    monkeypatch.setattr(token_counts, "BATCH_BYTES", 300)
    count = libraries(path)
    rows = [*enumerate(TEXTS), (5, TEXTS[5]), (None, "null id")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA).repartition(3)
    found = token_counts.count_tokens(df, path, 400)
    assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    wanted = [(i, len((t or "").encode()), n := count(t or ""), n > 400) for i, t in rows]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(wanted, key=str)
    assert len({r[3] for r in wanted}) == 2


@pytest.mark.parametrize("path", [PIECES, BYTE_LEVEL])
def test_random_texts_cut_anywhere(monkeypatch, path):
    monkeypatch.setattr(token_counts, "LONG_TEXT", 3)
    model, count, rng = token_counts.counter(open(path, "rb").read()), libraries(path), random.Random(9)
    cut = 0
    for _ in range(800):
        text = "".join(rng.choices("ab th ing\n\t  ▁é東🙂'9!\x1c\x00<s>", k=rng.randrange(1, 60)))
        parts = list(token_counts.parts_of(text, model))
        cut += len(parts) > 2
        assert "".join(p for p, _ in parts) == text
        assert sum(model.lengths(parts)) == count(text), text
    assert cut > 300


def test_batches_are_balanced_by_bytes(monkeypatch):
    import pyarrow as pa

    model = token_counts.counter(open(PIECES, "rb").read())
    texts = pa.array(["short text"] * 3000 + ["東京 " * 200_000] + [None, ""])
    sizes, seen = [], set()
    for rows, parts in token_counts.balanced(texts, model):
        sizes.append(sum(len(p.encode()) for p, _ in parts))
        seen.update(rows)
    assert seen == set(range(3003))
    assert max(sizes) < token_counts.BATCH_BYTES + 4 * token_counts.LONG_TEXT + 10


def test_other_files_get_whole_texts_and_empty_table(spark):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    assert not token_counts.counter(open(path, "rb").read()).plain
    rows = [(1, "Some Words  here"), (2, None)]
    found = token_counts.count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path, 3)
    count = libraries(path)
    assert sorted(map(tuple, found.collect())) == [(1, 16, count(rows[0][1]), count(rows[0][1]) > 3), (2, 0, 0, False)]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts.count_tokens(empty, PIECES, 3).collect() == []
