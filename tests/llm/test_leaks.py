from __future__ import annotations

import random
import re

import duckdb
import pytest

from ticketmill.llm import leaks, paragraphs, simhash

DOCS = "doc_id long, text string"
ITEMS = "item_id long, text string"


def words(text):
    return [w for w in re.split(r"[^\w]+|_+", (text or "").lower()) if w]


def brute(docs, items):
    """Every item laid at every place of every text that shares a seed with it."""
    out = []
    for doc_id, text in docs:
        w, found = words(text), []
        for item_id, body in sorted({(i, t) for i, t in items if t is not None}):
            v, best = words(body), None
            for shift in range(-len(v) + 1, len(w)):
                ks = range(max(0, -shift), min(len(v), len(w) - shift))
                same = [w[k + shift] == v[k] for k in ks]
                seed = any(
                    at + len(m) <= len(same) and all(same[at + j] for j, bit in enumerate(m) if bit == "1")
                    for m in leaks.MASKS for at in range(len(same))
                )
                if not seed:
                    continue
                high = here = 0
                for s in same:
                    here = max(0, here + (1 if s else -leaks.PENALTY))
                    high = max(high, here)
                n = sum(same)
                if (len(same) >= 8 and n >= 0.8 * len(same)) or (len(v) < 8 and n == len(v)) or high >= leaks.STRETCH:
                    best = max(best or (0,), (n, -len(same), high))
            if best:
                found.append((best[0], -item_id, best[1]))
        top = max(found) if found else (0, None, 0)
        out.append((doc_id, bool(found), len(found), None if top[1] is None else -top[1], top[0], -top[2]))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(400)]

    def some(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    items = [(i, " ".join(some(n))) for i, n in enumerate([5, 6, 7, 8, 9, 12, 20, 40, 4, 0])] + [(90, None), (3, " ".join(some(8)))]
    items.append(items[5])  # listed twice
    docs = [(100 + i, " ".join(some(n))) for i, n in enumerate([0, 1, 4, 30, 60, 200])] + [(None, None), (200, None), (201, "")]
    for i, (_, text) in enumerate(items[:8]):
        v = text.split()
        docs.append((300 + i, " ".join(some(7) + v + some(9))))
        docs.append((320 + i, " ".join(some(3) + [x if k != len(v) // 2 else "other" for k, x in enumerate(v)] + some(3))))
        docs.append((340 + i, "; ".join(x.upper() for x in v)))
        docs.append((360 + i, " ".join(v[: max(len(v) - 2, 1)])))
    docs += [(300, docs[9][1]), (300, docs[9][1])]
    return docs, items


def test_against_brute_force_and_sql(spark, tables):
    docs, items = tables
    want = brute(docs, items)
    assert {r[0] for r in want if r[1]} >= {300, 301, 302, 303, 340, 341} and not {r[0] for r in want if r[1]} & {320, 321, 322, 200, 201}
    got = leaks.contamination(spark.createDataFrame(docs, DOCS).repartition(4), spark.createDataFrame(items, ITEMS))
    assert sorted(map(tuple, got.collect()), key=str) == want
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    # the SQL joins on the id, so each id once and none null
    single = [(i, t) for i, t in {i: t for i, t in docs}.items() if i is not None]
    listed = [(i, t) for i, t in dict(items).items()]
    con.executemany("INSERT INTO documents VALUES (?, ?)", single)
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", listed)
    assert sorted(con.execute(leaks.ORACLE).fetchall(), key=str) == brute(single, listed)


def test_shuffled_seeds_give_the_same(spark, tables, monkeypatch):
    docs, items = tables
    monkeypatch.setattr(leaks, "BROADCAST_SEEDS", 3)
    got = leaks.contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items)


def test_empty_tables(spark, tables):
    docs, items = (spark.createDataFrame(rows, schema) for rows, schema in zip(tables, (DOCS, ITEMS)))
    assert leaks.contamination(docs, items.limit(0)).where("contaminated").count() == 0
    assert leaks.contamination(docs.limit(0), items).count() == 0
    assert leaks.without_leaks(docs, items.limit(0)).count() == len(tables[0])


CLASH = "doc_id long, text string, _id string, _ID_ int, _key int, _copies string, _gone int, matched string"


def test_clashing_columns_pass_unchanged(spark, tables):
    docs, items = tables
    rows = [(i, t, "a", 1, 2, "b", 3, "c") for i, t in docs]
    df, known = spark.createDataFrame(rows, CLASH), spark.createDataFrame(items, ITEMS)
    clean = leaks.without_leaks(df, known)
    assert clean.columns == df.columns
    per_text = {(i, t): brute([(i, t)], items)[0][1] for i, t in set(docs)}
    assert sorted(((r.doc_id, r.text) for r in clean.collect()), key=str) == sorted((d for d in docs if not per_text[d]), key=str)
    one = simhash.one_of_each(df)
    assert one.columns == df.columns and {r[2:] for r in map(tuple, one.collect())} == {("a", 1, 2, "b", 3, "c")}
    kept = paragraphs.without_repeats(df, paragraphs.repeated_paragraphs(df.select("doc_id", "text")))
    assert kept.columns == df.columns and kept.count() == len(docs)
