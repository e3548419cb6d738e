from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketmill.llm import recurrent as R
from ticketmill.llm.common import held_out


def weights(seed=1):
    rng = np.random.default_rng(seed)
    return {k: rng.normal(0, 0.3, s).astype(np.float32) for k, s in R.SHAPES.items()}


def plain_score(w, ids):
    def sigmoid(x):
        return 1 / (1 + np.exp(-x))

    h, before, total, u = np.zeros(R.UNITS), R.END_ID, 0.0, R.UNITS
    for t in ids:
        x = w["inputs"][before].astype(float)
        gate = sigmoid(x[: 2 * u] + h @ w["gates"])
        new = np.tanh(x[2 * u :] + (gate[:u] * h) @ w["state"])
        h = (1 - gate[u:]) * h + gate[u:] * new
        a = h @ w["class_w"] + w["class_b"]
        b = h @ w["word_w"][t // R.WIDTH] + w["word_b"][t // R.WIDTH]
        total += a[t // R.WIDTH] - np.log(np.exp(a).sum()) + b[t % R.WIDTH] - np.log(np.exp(b).sum())
        before = t
    return total


def test_score_as_one_step_after_another():
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, R.SLOTS, n) for n in (1, 50, 3, 16, 17, 33)]
    w = weights()
    assert R.score(w, texts) == pytest.approx([plain_score(w, t) for t in texts], rel=1e-4)


def test_probabilities_sum_to_one():
    w = weights()
    state = np.random.default_rng(3).normal(0, 1, (1, R.UNITS)).astype(np.float32)
    p = R.log_probability(w, np.repeat(state, R.SLOTS, axis=0), np.arange(R.SLOTS))
    assert np.exp(p).sum() == pytest.approx(1, abs=1e-4)


def test_gradients_as_differences():
    w = {k: v.astype(np.float64) for k, v in weights(4).items()}
    rng = np.random.default_rng(5)
    previous, target = rng.integers(0, 40, (2, 5, 3))
    mask = np.ones((5, 3), bool)
    mask[3:, 2] = False

    def loss():
        states = R.forward(w, previous, np.zeros((3, R.UNITS)))
        on = np.flatnonzero(mask.ravel())
        return -R.log_probability(w, states.reshape(-1, R.UNITS)[on], target.ravel()[on]).mean()

    g, _ = R.gradients(w, previous, target, mask, np.zeros((3, R.UNITS)))
    used, rows = R.summed_rows(previous.ravel(), g["inputs"])
    g["inputs"] = np.zeros(R.SHAPES["inputs"])
    g["inputs"][used] = rows
    for name, shape in R.SHAPES.items():
        for _ in range(4):
            at = tuple(int(rng.integers(0, min(s, 40))) for s in shape)
            old = w[name][at]
            w[name][at] = old + 1e-2
            up = loss()
            w[name][at] = old - 1e-2
            down = loss()
            w[name][at] = old
            assert g[name][at] == pytest.approx((up - down) / 2e-2, abs=2e-4), (name, at)


def test_softmax_of_a_window_is_taken_at_once(monkeypatch):
    calls, plain_surplus = [], R._surplus
    monkeypatch.setattr(R, "_surplus", lambda z, *rest: calls.append(len(z)) or plain_surplus(z, *rest))
    target = np.random.default_rng(8).integers(0, R.SLOTS, (16, 20))
    R.gradients(weights(), np.roll(target, 1, axis=0), target, np.ones((16, 20), bool), np.zeros((20, R.UNITS), np.float32))
    assert calls == [320, 320]  # classes, then words, not one call for each of the 32 classes


def plain(rows):
    def toks(t):
        return [x.lower() if x.isascii() else "".join(c.lower() if c.isascii() else c for c in x)
                for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + ["\n"]

    out = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    c = Counter(x for (_, t), o in zip(rows, out) if not o for x in toks(t))
    n, v = sum(c.values()), len(c)
    return [(o, len(toks(t)), sum(c[x] > 0 for x in toks(t)), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in toks(t)))
            for (_, t), o in zip(rows, out)]


def run(spark, rows):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, block string")
    return df, R.score_documents(df, held_out(F.col("doc_id"), 7, 2))


def test_documents(spark, monkeypatch):
    monkeypatch.setattr(R, "DICTIONARY_CHARS", 400)
    monkeypatch.setattr(R, "SCORE_CHARS", 300)
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(rng.choice(["Aa", "bb", "cc", "é", "dd\n", "ee", f"w{i}"], rng.integers(0, 60)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, " \t"), (None, "aa bb"), (5, rows[5][1]), (203, "É Aa " * 3000)]
    got = sorted(((r.doc_id if r.doc_id is not None else -1), r) for r in run(spark, rows)[1].collect())
    want = sorted(((-1 if i is None else i), p) for (i, _), p in zip(rows, plain(rows)))
    for (i, r), (j, p) in zip(got, want, strict=True):
        assert i == j and (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == p[:4]
        assert r.base_score == pytest.approx(p[4], rel=1e-9)
        assert r.score < 0
    held = [r for _, r in got if r.held_out and r.n_tokens > 5]
    assert sum(r.score for r in held) > 1.05 * sum(r.base_score for r in held)


def test_learns_order(spark):
    rows = [(i, "one two three four five six seven " * 30) for i in range(300)]
    got = run(spark, rows)[1].collect()
    assert sum(r.score for r in got) > 0.6 * sum(r.base_score for r in got)


def test_every_training_text_is_learned(spark):
    df = spark.createDataFrame([(i, f"word{i} " * 20) for i in range(40)], "id long, text string")
    slots = {R.END: R.END_ID} | {f"word{i}".encode(): R.FIRST_WORD + i for i in range(40)}
    words = R.Vocabulary(slots, np.array([0.0, 40.0] + [20.0] * 40), 840, 41)
    moved = np.abs(R.train(df, words)["inputs"] - R.initial(words.counts)["inputs"]).max(axis=1) > 1e-3
    assert moved[R.FIRST_WORD : R.FIRST_WORD + 40].all() and not moved[R.FIRST_WORD + 40 :].any()


def test_empty_and_untrained(spark):
    df, out = run(spark, [(2, "x")])
    assert R.score_documents(df.limit(0), held_out(F.col("doc_id"), 7, 2)).count() == 0
    none = R.score_documents(df, F.lit(True)).first()
    assert (none.n_tokens, none.n_known, none.train_tokens, none.base_score, none.score) == (2, 0, 0, 0.0, 0.0)
