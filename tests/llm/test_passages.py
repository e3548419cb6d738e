from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest

from ticketmill.llm import paragraphs, passages, repeats
from ticketmill.llm.windows import Windows


def plain(rows, length):
    """Words in runs of ``length`` words or more that a different (id, text) also holds."""
    cut = [(t or "").encode().lower().split() for _, t in rows]
    held = defaultdict(set)
    for (i, t), words in zip(rows, cut):
        for k in range(len(words) - length + 1):
            held[tuple(words[k : k + length])].add((i, t))
    out = []
    for words in cut:
        on = np.zeros(len(words), bool)
        for k in range(len(words) - length + 1):
            if len(held[tuple(words[k : k + length])]) > 1:
                on[k : k + length] = True
        out.append(int(on.sum()))
    return out


def some_rows(seed, longest=40):
    rng = random.Random(seed)

    def piece(size):
        return [rng.choice(["a", "B", "ca", "é", "dd,", "e."]) for _ in range(size)]

    shared = [piece(rng.randint(8, longest)) for _ in range(8)]
    rows = []
    for i in range(80):
        words = []
        for _ in range(rng.randint(0, 5)):
            s = rng.choice(shared)
            words += piece(rng.randint(0, 12)) + s[rng.randint(0, 4) :] + rng.choice([[], s])
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(words)))
    # copies, a fully repeated row, null and empty texts, a text that repeats only itself, null ids
    own = " ".join(f"w{k}" for k in range(60))
    return rows + [(100, rows[3][1]), (101, rows[3][1].upper()), rows[5], (102, None), (103, ""), (104, f"{own} {own}"), (None, rows[7][1]), (None, rows[8][1])]


@pytest.mark.parametrize("seed, length, anchor", [(1, 9, 4), (2, 12, 5), (3, 20, 9)])
def test_shared_words_as_brute_force(spark, monkeypatch, seed, length, anchor):
    rows = some_rows(seed)
    df = spark.createDataFrame(rows, "id long, text string").repartition(5).selectExpr("id", "xxhash64(text) text_key", "text")
    got = {(r.id, r.text_key): r.n for r in passages.shared_words(df, length, anchor).collect()}
    keys = {(r.id, r.text): r.text_key for r in df.collect()}
    assert [got.get((row[0], keys[row]), 0) for row in rows] == plain(rows, length)
    assert max(got.values()) > length


def test_segments_do_not_depend_on_parts(monkeypatch):
    codes, bounds = passages.word_codes([t for _, t in some_rows(4)])

    def windows():
        return {(int(t), k) for t, _, _, a, b in passages.segments(codes, bounds, Windows(), 9, 4) for t, a, b in zip(t, a, b) for k in range(a, b + 1)}

    whole = windows()
    assert whole == {(t, k) for t in range(len(bounds) - 1) for k in range(bounds[t], bounds[t + 1] - 8)}
    monkeypatch.setattr(passages, "PART_WORDS", 37)
    assert windows() == whole


def test_passages_under_400_bytes_and_inside_lines_are_told(spark):
    def words(name, n):
        return " ".join(f"{name}{k}" for k in range(n))

    passage = words("p", 54)  # less than 400 bytes
    rows = [
        (1, f"{words('a', 90)} {passage} {words('b', 90)}"), (2, f"{words('c', 80)} {passage}"),
        (3, f"{words('d', 30)} {words('p', 50)} {words('e', 30)}"),  # 50 words are not over 50
        (4, f"{words('f', 60)} {words('f', 60)}"), (5, None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = {1: 54, 2: 54, 3: 0, 4: 0, 5: 0}
    removed = repeats.remove_repeats(df).collect()
    assert {r.doc_id: r.n_shared_words for r in removed} == wanted
    assert {r.doc_id: r.n_removed for r in removed} == dict.fromkeys(wanted, 0)
    found = paragraphs.repeated_paragraphs(df).collect()
    assert {r.doc_id: r.n_shared_words for r in found} == wanted
    assert {r.doc_id: r.n_shared for r in found} == dict.fromkeys(wanted, 0)
