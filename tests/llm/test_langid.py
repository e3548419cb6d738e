from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from ticketmill.llm import langid

TABLE = langid.symbol_table()
WORDS = {"aa": "lorem ipsum dolor sit amet".split(), "bb": "xylo zebra quark jinx waltz".split()}


def docs(n, seed=1):
    rng = random.Random(seed)
    return [(i, lang, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(3, 40))))
            for i in range(n) for lang in [rng.choice(["aa", "bb"])]]


def plain_models(texts):
    """Probability of a symbol after its context by recursion over counted strings."""
    def string(t):
        return "\1\1\1" + " ".join("".join(c if c.isalpha() else " " for c in t.lower()).split())

    top = Counter(s[i - 3 : i + 1] for s in map(string, texts) for i in range(3, len(s)))
    levels = {4: top}
    for n in (3, 2, 1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])

    def discount(c):
        ones, twos = (sum(v == k for v in c.values()) for k in (1, 2))
        return ones / (ones + 2 * twos) if ones and twos else 0.5

    def p(gram, alphabet):
        if not gram:
            return 1 / alphabet
        level, context = levels[len(gram)], gram[:-1]
        total = sum(v for g, v in level.items() if g[:-1] == context)
        if not total:
            return p(gram[1:], alphabet)
        d = discount(level)
        types = sum(g[:-1] == context for g in level)
        return max(level[gram] - d, 0) / total + d * types / total * p(gram[1:], alphabet)

    return p, string


def test_probabilities_as_recursion():
    texts = {"aa": ["abc abd, abc", "Cab!"], "bb": ["xyz xyzz abc"]}
    language, grams, counts = [], [], []
    for i, own in enumerate(texts.values()):
        s, _ = langid.symbols(own, TABLE)
        g, c = np.unique(langid.ngrams(s)[s != langid.BOUNDARY], return_counts=True)
        language += [i] * len(g)
        grams.append(g)
        counts.append(c)
    m = langid.build_models(list(texts), np.array(language), np.concatenate(grams), np.concatenate(counts), TABLE)
    alphabet = len({c for own in texts.values() for t in own for c in plain_models(own)[1](t)[3:]}) + 1
    for probe in ("abc", "xyz abd", "qqq", "a", "zzabq x"):
        sums, n, letters = m.score([probe])
        for i, own in enumerate(texts.values()):
            p, string = plain_models(own)
            s = string(probe)
            want = sum(np.log(p(s[k - 3 : k + 1], alphabet)) for k in range(3, len(s)))
            assert sums[0, i] == pytest.approx(want, rel=1e-4), (probe, i)
        assert n[0] == len(probe) and letters[0] == len(probe.replace(" ", ""))


def test_held_out_and_edge_rows(spark):
    rows = docs(400) + [(1000, "aa", None), (1001, None, ""), (1002, "bb", "123 !!"), (None, "aa", "lorem ipsum"),
                        (1003, None, "Привет мир это другой язык совсем " * 5), (7, "aa", "lorem ipsum dolor"), (7, "aa", "lorem ipsum dolor")]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").selectExpr("*", "'x' AS score")
    from ticketmill.llm.common import held_out

    out = langid.identify(df, held_out(df.doc_id, 5, 0)).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    assert all(by[i].lang_pred == lang and not by[i].rejected for i, lang, _ in rows[8:400])
    assert all(by[i].lang_pred == "und" and by[i].score == 0 and by[i].rejected for i in (1000, 1001, 1002))
    assert by[1003].rejected and by[1003].lang_pred in ("aa", "bb") and by[1003].score < 0.5
    assert all(0 <= r.score <= 1 for r in out)
    assert langid.identify(df.limit(0), held_out(df.doc_id, 5, 0)).count() == 0


def test_parts_and_cutoffs(spark, monkeypatch):
    monkeypatch.setattr(langid, "BLOCK_CHARS", 30)
    df = spark.createDataFrame([(i, la, t) for i, la, t in docs(60)], "id long, language string, text string")
    m = langid.train(df, max_ngrams=60)
    assert sum(len(t.hashes) for t in m.probability[-1:]) <= 60
    out = langid.predict(df, m, "id").collect()
    assert len(out) == 60 and np.mean([r.lang_pred == la for r, (_, la, _) in zip(sorted(out, key=lambda r: r.id), docs(60))]) > 0.9


def test_junk_in_calibration_does_not_loosen_the_limit(spark):
    rng = random.Random(4)

    def gibberish(n):
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(n))

    clean = [(i, la, t) for i, la, t in docs(600, 7)]
    junk = [(10_000 + i, "aa" if i % 2 else "bb", gibberish(300)) for i in range(18)]
    m = langid.train(spark.createDataFrame(clean + junk, "id long, language string, text string"))
    foreign = "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti e devono agire in spirito di fratellanza."
    probes = [(i, gibberish(n)) for i, n in enumerate([25, 50, 100, 1000] * 5)] + [(50 + n, foreign[:n]) for n in (40, 80, 112)]
    short = [(100 + k, t) for k, t in enumerate([" ".join(w[i : i + 2]) for w in WORDS.values() for i in range(4)])]
    short += [(200 + i, t) for i, _, t in docs(60, 8)]
    df = spark.createDataFrame(probes + short, "doc_id long, text string")
    rejected = {r.doc_id for r in langid.predict(df, m).where("rejected").collect()}
    assert rejected == {i for i, _ in probes}
    assert {r.doc_id for r in langid.accepted(df, m).collect()} == {i for i, _ in short}
