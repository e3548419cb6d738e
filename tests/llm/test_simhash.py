from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from ticketmill.llm import simhash
from ticketmill.llm.components import connected_components


def plain(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return "0" * 16
    n = min(4, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), 42) for i in range(len(words) - n + 1)]
    return f"{sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)):016x}"


def components(prints):
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def some_texts():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)] + ["É é", "ÀB", "Zz"]
    texts = [None, "", " \t\n\x0b", "one", "One two", "a b c", "a b c d", "a B c D e", "a b c d e"]
    for _ in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(3, 300))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            base[rng.randrange(len(base))] = rng.choice(words)
            texts.append("\n ".join(base))
    return texts + [texts[20]] * 5


def test_near_duplicates_as_brute_force(spark):
    texts = some_texts()
    ids = [7 * i % 1009 for i in range(len(texts))]
    df = spark.createDataFrame(list(zip(ids, texts, [1] * len(ids))), "doc_id long, text string, fp int")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()}
    prints = [plain(t) for t in texts]
    part = components([int(p, 16) for p in prints])
    least = {p: min(i for i, q in zip(ids, part) if q == p) for p in set(part)}
    assert got == {i: (f, least[p]) for i, f, p in zip(ids, prints, part)}


def test_links_connect_what_is_close(spark, monkeypatch):
    rng = random.Random(8)
    centre = [rng.getrandbits(64) for _ in range(40)]
    prints = {0, 1, 15, 31, 2**64 - 1}
    for c in centre:
        for _ in range(30):
            for bit in rng.sample(range(64), rng.randint(0, 3)):
                c ^= 1 << bit
            prints.add(c)
    prints = sorted(prints)
    want = components(prints)
    signed = [p - 2**64 if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    for tile in (simhash.TILE, 3):
        monkeypatch.setattr(simhash, "TILE", tile)
        links = simhash.fingerprint_links(df)
        part = {r.node: r.component for r in connected_components(links).collect()}
        got = [part.get(s, s) for s in signed]
        assert len(set(got)) == len(set(want)) == len(set(zip(got, want)))


def test_groups_give_a_forest():
    fps = np.arange(16, dtype=np.int64)
    a, b = simhash.linked(np.zeros(16, np.int64), fps)
    assert len(a) == 15


def test_long_text_in_parts(monkeypatch):
    text = " ".join(f"word{i % 97}" for i in range(5000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "PART_BYTES", 50)
    assert simhash.fingerprint(text) == whole and f"{whole % 2**64:016x}" == plain(text)
    for text in ("a b", "a b c d e" + " " * 200, " " * 300 + "x y z", "x " + " " * 300 + "y"):
        assert f"{simhash.fingerprint(text) % 2**64:016x}" == plain(text)


def test_one_of_each(spark):
    long = " ".join(f"w{i}" for i in range(300))
    rows = [(5, long, "a"), (2, long, "b"), (2, long, "b"), (9, "other words are here now", "c"), (None, None, "d"), (None, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component string")
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    got = sorted((r.doc_id or -1, r.component or "") for r in kept.collect())
    assert [g[0] for g in got] == [-1, 2, 9]
    assert simhash.near_duplicates(df.limit(0)).count() == 0 == simhash.one_of_each(df.limit(0)).count()


@pytest.mark.parametrize("links, want", [([], {}), ([(1, 1)], {}), ([(3, 2), (2, 1), (5, 4), (2, 3)], {1: 1, 2: 1, 3: 1, 4: 4, 5: 4})])
def test_components(spark, links, want):
    df = spark.createDataFrame(links, "a long, b long")
    assert {r.node: r.component for r in connected_components(df).collect()} == want


def test_components_of_a_path(spark):
    n = 200
    df = spark.range(n - 1).selectExpr("id * 37 % 199 AS a", "(id + 1) * 37 % 199 AS b")
    assert {r.component for r in connected_components(df).collect()} == {0}
