from __future__ import annotations

import random

import numpy as np

from ticketmill.llm import paragraphs as P

SCHEMA = "doc_id long, text string, par string"


def shingles(words):
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def plain(rows):
    """doc_id -> removed lines, by comparing everything with everything."""
    docs = {(i if i is not None else -1, t) for i, t in rows}
    occ = sorted((i, n, tuple(line.lower().split())) for i, t in docs for n, line in enumerate((t or "").split("\n")) if len(line.split()) >= 5)
    classes = sorted({w for _, _, w in occ})
    part = {w: w for w in classes}

    def find(w):
        while part[w] != w:
            w = part[w]
        return w

    sets = {w: shingles(w) for w in classes}
    for i, a in enumerate(classes):
        for b in classes[:i]:
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                part[find(a)] = find(b)
    first, removed = {}, {}
    for i, n, w in occ:
        if find(w) in first:
            removed.setdefault(i, []).append((n, *first[find(w)]))
        else:
            first[find(w)] = (i, n)
    return removed


def some_rows():
    rng = random.Random(4)
    words = [f"Word{i}" for i in range(3000)]

    def line(n):
        return [rng.choice(words) for _ in range(n)]

    shared = [line(n) for n in (5, 6, 12, 60, 80, 150, 400)]
    rows = []
    for i in range(150):
        lines = []
        for _ in range(rng.randint(1, 6)):
            own = list(rng.choice(shared)) if rng.random() < 0.5 else line(rng.randint(1, 60))
            if rng.random() < 0.5:
                for _ in range(rng.randint(1, 1 + len(own) // 60)):
                    own[rng.randrange(len(own))] = rng.choice(words)
            lines.append("  ".join(own) if rng.random() < 0.3 else " ".join(own).upper() if rng.random() < 0.3 else " ".join(own))
        rows.append((7 * i % 151, "\n".join(lines)))
    return rows + [(500, None), (501, ""), (502, "\n\n"), (503, "a b c d"), (504, "a b c d"), (505, " ".join(shared[3])), (None, "x y z u v w")]


def removed(found):
    return {(r.doc_id if r.doc_id is not None else -1): [(x.par, x.first_id, x.first_par) for x in r.repeats if x.removed]
            for r in found if r.n_removed}


def test_as_brute_force(spark, monkeypatch):
    rows = some_rows()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)
    want = plain(rows)
    for tile, cells in ((P.TILE, P.CELLS), (4, 50)):
        monkeypatch.setattr(P, "TILE", tile)
        monkeypatch.setattr(P, "CELLS", cells)
        got = P.repeated_paragraphs(df).collect()
        assert len(got) == len(rows) and removed(got) == want
    assert {r.doc_id: r.n_paragraphs for r in got}[500] == 0 and {r.doc_id: r.n_paragraphs for r in got}[502] == 3


def test_texts_and_repeated_rows(spark):
    line = "one two three four five six"
    rows = [(1, f"{line}\nown first line here is this\n{line}", "a"), (2, f"start of second one is here\n{line.upper()}", "b"), (2, f"start of second one is here\n{line.upper()}", "b")]
    df = spark.createDataFrame(rows, SCHEMA)
    found = P.repeated_paragraphs(df)
    assert sorted(r.n_removed for r in found.collect()) == [1, 1, 1]
    out = sorted(r.text for r in P.without_repeats(df, found).collect())
    assert out[0] == f"{line}\nown first line here is this"
    empty = P.repeated_paragraphs(df.limit(0))
    assert empty.count() == 0


def test_tuning_and_forest():
    bands, rows = P.tuned()
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999 and bands * rows <= 64
    same = [np.arange(20, dtype=np.int64)] * 40
    assert len(P.similar(same)) == 39
    assert P.similar([np.arange(10), np.arange(1, 11)]) == [(1, 0)] and P.similar([np.arange(10), np.arange(3, 13)]) == []
    assert P.similar([np.arange(5), np.arange(5, 9), np.arange(20, 30)]) == []


def test_repeated_passage_in_many(spark):
    passage = " ".join(f"common{i}" for i in range(60))
    df = spark.createDataFrame([(i, f"{' '.join(f'own{i}x{k}' for k in range(20))}\n{passage}", None) for i in range(400)], SCHEMA)
    got = P.repeated_paragraphs(df).collect()
    assert sum(r.n_removed for r in got) == 399 and all(r.n_repeated == 1 for r in got)


def test_shared_passages(spark):
    def line(tag, n):
        return " ".join(f"{tag}{k}" for k in range(n))

    rows = [(1, f"{line('p', 60)}\n{line('own', 30)}\n{line('own', 30)}"), (2, f"{line('x', 25)}\n{line('p', 60)} more"),
            (3, f"{line('s', 20)}\n{line('s', 20)}"), (4, line("s", 20)), (5, line("alone", 90)), (6, line("q", 21)), (None, line("q", 21).upper()),
            (7, line("twice", 40)), (7, line("twice", 40)), (8, None)]
    got = {r.doc_id: (r.n_shared, [(x.par, x.n_words, x.shared) for x in r.repeats]) for r in P.repeated_paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == (1, [(0, 60, True), (1, 30, False), (2, 30, False)]) and got[2] == (1, [(1, 61, True)])
    assert got[3] == (0, [(0, 20, True), (1, 20, True)]) and got[4] == (0, [(0, 20, True)])
    assert got[6] == got[None] == (1, [(0, 21, True)]) and got[5] == got[8] == (0, []) and got[7] == (0, [(0, 40, False)])


def test_paragraphs_of_a_block_are_hashed_together():
    hasher, hashed = P.Hasher(), []
    plain_hash = hasher.word_hash
    hasher.word_hash = lambda w: hashed.append(w) or plain_hash(w)
    listed = [[f"w{k * i % 7}" for k in range(n)] for i, n in enumerate((5, 9, 6, 5, 30), 1)]
    every, bounds = hasher.shingles(listed)
    assert sorted(hashed) == sorted({w for words in listed for w in words})
    parts = np.split(every, bounds[1:-1])
    assert [len(p) for p in parts] == [len(words) - 4 for words in listed]
    assert all((p == hasher.shingles([words])[0]).all() for p, words in zip(parts, listed))
    assert (hasher.bands(every, bounds) == [hasher.bands(*hasher.shingles([words]))[0] for words in listed]).all()


def test_band_keys_travel_without_pids(spark):
    rows = [(b"a" * 16, [1, 2]), (b"b" * 16, [1, 3]), (b"c" * 16, [4, 3]), (b"a" * 16, None), (b"d" * 16, [5, 6]), (b"d" * 16, [5, 6]), (b"b" * 16, [1, 3])]
    met = P.colliding(spark.createDataFrame(rows, "pid binary, bands array<bigint>"))
    assert sorted((r.key, bytes(r.pid)[:1]) for r in met.collect()) == [(1, b"a"), (1, b"b"), (3, b"b"), (3, b"c")]
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert "min(p#" in plan and "min(pid" not in plan
