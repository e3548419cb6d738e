from __future__ import annotations

import hashlib
import random

import duckdb
import pytest

from ticketmill.llm import fim
from ticketmill.llm.common import materialise

SCHEMA = "doc_id long, text string, frames string, id int, n int, h string"
TEXTS = [
    None, "", "a", "é", "🙂", "naïve 東京 🙂🙂 text", "has <P> inside", "ends with <", "<S", "<<S>>", "P><M", "<M>", "nul\x00l", " \n\t ",
    *("word 東京🙂 <x " * k for k in range(1, 40)),
]


def expected(doc_id, text, rate=90, spm=20):
    text = text or ""
    n = len(text)
    hashed = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hashed[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    parts = text[:a], text[a:b], text[b:]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < spm:
        return doc_id, n, "spm", a, b - a, f"<S>{parts[2]}<P>{parts[0]}<M>{parts[1]}"
    return doc_id, n, "psm", a, b - a, f"<P>{parts[0]}<S>{parts[2]}<M>{parts[1]}"


def hashed(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows_of(texts):
    return [(k, t) for k, t in enumerate(texts)] + [(5, TEXTS[5]), (None, "null id"), (-7, "negative id of a text")]


@pytest.mark.parametrize("frame", [4, 7, 65_536])
def test_rows_as_plain_strings(spark, monkeypatch, frame):
    monkeypatch.setattr(fim, "FRAME_BYTES", frame)
    rows = rows_of(TEXTS)
    df = spark.createDataFrame([(i, t, "f", 1, 2, "h") for i, t in rows], SCHEMA).repartition(3)
    found = fim.fill_in_middle(df)
    assert found.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    wanted = [(*(e := expected(i, t))[:5], hashed(e[5]), hashed(t or "")) for i, t in rows]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(wanted, key=str)
    assert {r[2] for r in wanted} == {"plain", "psm", "spm"}


def test_outputs_and_restoring_from_them(spark, monkeypatch):
    monkeypatch.setattr(fim, "FRAME_BYTES", 16)
    df = spark.createDataFrame(rows_of(TEXTS), "id long, text string")
    stored = materialise(fim.store_frames(df, "id"))
    for r in fim.transform(stored, rate=100, spm_share=50, with_output=True).collect():
        frames = fim.Frames(r.out_frames, r.out_ends, fim.Zstd())
        texts = {expected(i, t, 100, 50)[5] for i, t in rows_of(TEXTS) if i == r.id}
        assert b"".join(frames.stream()).decode() in texts
        assert hashed(b"".join(fim.restore(frames, r.form)).decode()) == r.restored_sha256


def test_only_needed_frames_are_decompressed(monkeypatch):
    monkeypatch.setattr(fim, "FRAME_BYTES", 100)
    text = "".join(random.Random(1).choices("ab東🙂 ", k=5000))
    out = fim.Writer(fim.Zstd())
    out.write(text.encode())
    frames = out.close()
    assert len(frames.frames) > 50 and frames.units == 5000
    opened = []
    reader = frames.frame
    frames.frame = lambda k: opened.append(k) or reader(k)
    assert b"".join(frames.stream(2500, 2510)).decode() == text[2500:2510]
    assert len(opened) <= 2
    for a, b in ((0, 0), (0, 1), (17, 4000), (4999, 5000), (5000, 5000)):
        assert b"".join(frames.stream(a, b)).decode() == text[a:b]


def test_marker_across_frames(monkeypatch):
    monkeypatch.setattr(fim, "FRAME_BYTES", 5)
    for lead in range(12):
        out = fim.Writer(fim.Zstd())
        out.write(("東" + "x" * lead + "<M>tail").encode())
        frames = out.close()
        assert frames.find(b"<M>") == lead + 1
        assert frames.find(b"<P>") == -1


def test_sql_and_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert fim.fill_in_middle(empty).collect() == []
    rows = rows_of(TEXTS)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    wanted = [(*(e := expected(i, t))[:5], hashed(e[5]), hashed(t or "")) for i, t in rows]
    assert sorted(con.execute(fim.ORACLE).fetchall(), key=str) == sorted(wanted, key=str)
