from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from ticketmill.llm import repeats as R


def plain(texts, length):
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(d, np.uint8)[~gone])
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        out.append((len(d), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def some_texts(seed, alphabet, passage, n):
    rng = random.Random(seed)

    def piece(size):
        return "".join(rng.choice(alphabet) for _ in range(size))

    shared = [piece(rng.randint(passage // 2, 3 * passage)) for _ in range(6)]
    texts = []
    for _ in range(n):
        t = ""
        for _ in range(rng.randint(0, 4)):
            t += piece(rng.randint(0, passage))
            if rng.random() < 0.6:
                s = rng.choice(shared)
                a = rng.randint(0, len(s) // 3)
                t += s[a : len(s) - rng.randint(0, len(s) // 3)]
        texts.append(t)
    return texts + texts[:5]


@pytest.mark.parametrize("seed, alphabet", [(1, "ab"), (2, "abcdefgh é\n"), (3, "a")])
def test_transform_as_brute_force(seed, alphabet):
    rng = random.Random(seed)
    for length in (8, 11, 20):
        shared = "".join(rng.choice(alphabet) for _ in range(60))
        parts = []
        for _ in range(30):
            a = rng.randint(0, 40)
            own = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
            parts.append((own + shared[a : a + rng.randint(5, 30)] + own[::-1]).encode() + b"\0" * rng.randint(0, 2))
        parts = [p for p in parts if p]
        count = Counter(p[i : i + length] for p in parts for i in range(len(p) - length + 1))
        for p, flags in zip(parts, R.repeated_starts(parts, length)):
            assert flags.tolist() == [count[p[i : i + length]] > 1 for i in range(len(p) - length + 1)]


def test_segments_cover_all_starts(monkeypatch):
    data = random.Random(1).randbytes(3000)
    for part in (10**6, 500):
        monkeypatch.setattr(R, "PART_BYTES", part)
        rows = [np.stack(x[2:], axis=1) for x in R.segments(data, R.Windows(), 40, 15)]
        starts = [s for st, en in np.concatenate(rows).tolist() for s in range(st, en + 1)]
        assert starts == list(range(3000 - 39))
    assert list(R.segments(b"short", R.Windows(), 40, 15)) == []


def run(spark, texts, length, anchor):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, h string")
    out = R.remove_repeats(df, length=length, anchor=anchor, with_spans=True).collect()
    for r in out:
        data = (texts[r.doc_id] or "").encode()
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and len(r.spans) == r.n_spans
        assert sum(s.b - s.a for s in r.spans) == r.n_removed == len(data) - len(r.kept)
    return [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sorted(out, key=lambda r: r.doc_id)]


def test_documents_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(R, "TEXT_BYTES", 3000)
    texts = some_texts(5, "abcdefgh é", 60, 60) + [None, "", "a" * 500, "ab" * 300, "x" * 40, "x" * 41, "\0" * 90, "nul\0" * 30]
    want = plain(texts, 40)
    assert run(spark, texts, 40, 15) == want
    monkeypatch.setattr(R, "GROUP_SEGMENTS", 2)
    assert run(spark, texts, 40, 15) == want


def test_production_lengths(spark):
    texts = some_texts(6, "abcdefghij klmnop\n", 500, 40)
    base = texts[0] + "".join(random.Random(9).choice("abcdefgh ") for _ in range(3000))
    for k in range(5):
        texts.append(base[: 500 * k] + "changed" + base[500 * k + 7 :])
    assert run(spark, texts, R.LENGTH, R.ANCHOR) == plain(texts, R.LENGTH)


def test_repeated_rows_and_empty(spark):
    text = "".join(random.Random(2).choice("abcdef ") for _ in range(450))
    df = spark.createDataFrame([(1, text), (1, text), (None, "a" + text[:398]), (2, None)], "doc_id long, text string")
    got = {(r.doc_id, r.n_bytes, r.n_removed) for r in R.remove_repeats(df).collect()}
    assert got == {(1, 450, 450), (None, 399, 0), (2, 0, 0)}
    assert R.remove_repeats(df.limit(0)).count() == 0
