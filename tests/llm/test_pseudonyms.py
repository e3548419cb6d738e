from __future__ import annotations

import datetime as dt
import hashlib
import re

import pytest

from ticketmill.llm import pseudonyms as P

KEY = "test key"


def digest(tag, n, half, bits):
    raw = "\x1f".join([KEY, tag, str(n), str(half)]).encode()
    return hashlib.new(f"sha{bits}", raw).hexdigest()


def plain_numbers(a, b, size_a, size_b, tag):
    for n in range(P.ROUNDS):
        if n % 2 == 0:
            b = (b + int(digest(tag, n, a, 256)[:15], 16) % size_b) % size_b
        else:
            a = (a + int(digest(tag, n, b, 256)[:15], 16) % size_a) % size_a
    return a, b


def plain_digits(d, tag):
    u = len(d) // 2
    a, b = plain_numbers(int(d[:u] or 0), int(d[u:]), 10**u, 10 ** (len(d) - u), f"{tag}:{len(d)}")
    return (f"{a:0{u}d}" if u else "") + f"{b:0{len(d) - u}d}"


def plain_luhn(body):
    total = sum(sum(divmod(int(c) * (2 if k % 2 == 0 else 1), 10)) for k, c in enumerate(reversed(body)))
    return -total % 10


@pytest.fixture(scope="module")
def swap(spark):
    def run(texts, key=KEY, **more):
        df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, _found string")
        out = P.pseudonymise(df, key, count="n", **more)
        assert out.columns == ["doc_id", "text", "_found", "n"]
        return [(r.text, r.n) for r in sorted(out.collect(), key=lambda r: r.doc_id)]

    return run


VALUES = [
    "4539578763621486", "4539 5787 6362 1486", "4539-5787-6362-1486", "5927243074273351", "+1 (017) 555-7713", "555-123-4567",
    "+4915112345678", "248.167.124.71", "0.0.0.0", "255.255.255.255", "078-05-1120", "1984-02-29", "29.02.1984", "12/31/1999", "31/12/1999",
    "3/4/2020", "someone.else17@mail8.example.com", "A@b.org", "5e1f" * 10,
]


def test_layout_and_links(swap):
    texts = [f"Before {v}, and again {v}" for v in VALUES]
    got = swap(texts)
    for text, value, (out, n) in zip(texts, VALUES, got):
        assert n == 2 and value not in out
        new = re.fullmatch(r"Before (.*), and again \1", out, re.S).group(1)
        shape = lambda v: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d", "9", v)))
        if len(value) != 40 and value != "3/4/2020" and not re.fullmatch(r"[\d.]{7,15}", value):
            assert shape(new) == shape(value), value
    cards = [re.sub(r"\D", "", out.split(",")[0]) for out, _ in got[:3]]
    assert len(set(cards)) == 1


def test_values_as_plain_network(swap):
    texts = ["4539578763621486", "5927243074273351", "+1 (017) 555-7713", "248.167.124.71", "1984-02-29"]
    card, odd, phone, address, date = [t for t, _ in swap(texts)]
    for old, new in ((texts[0], card), (texts[1], odd)):
        body = plain_digits(old[:-1], "account")
        assert new == body + str((plain_luhn(body) + int(old[-1]) - plain_luhn(old[:-1])) % 10)
    assert plain_luhn(card[:-1]) == int(card[-1])
    d = plain_digits("0175557713", "phone")
    assert phone == f"+1 ({d[:3]}) {d[3:6]}-{d[6:]}"
    a, b = plain_numbers(248 * 256 + 167, 124 * 256 + 71, 65536, 65536, "address")
    assert address == f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
    day = (dt.date(1984, 2, 29) - dt.date(1800, 1, 1)).days
    a, b = plain_numbers(day // 773, day % 773, 189, 773, "date")
    assert date == str(dt.date(1800, 1, 1) + dt.timedelta(a * 773 + b))


def test_inverse_restores(swap):
    texts = [f"x {v} y" for v in VALUES if "/" not in v]
    assert [t for t, _ in swap([t for t, _ in swap(texts)], inverse=True)] == texts
    assert swap(texts, key="other") != swap(texts)


def test_dates_are_permuted(spark):
    days = spark.range(0, 146097, 7).selectExpr("CAST(date_add(DATE'1800-01-01', CAST(id AS int)) AS string) AS text")
    out = P.pseudonymise(days, KEY)
    assert out.distinct().count() == days.count() and out.where("NOT text RLIKE '^[0-9]{4}-[0-9]{2}-[0-9]{2}$'").count() == 0


def test_left_alone(swap):
    texts = [None, "", "no data", "2023-02-30", "256.1.1.1", "1.2.3.4.5", "Version 2.0 of 1999", "12345", "a" * 5000, "z" * 70 + "@x.org",
             "1" * 30, "http://example.com/825?page=2"]
    assert [t for t, _ in swap(texts)] == texts
    assert swap([None])[0] == (None, 0)


def test_edges(spark):
    df = spark.createDataFrame([("mail me@here.org",), ("mail me@here.org",), ("me@here.org\n10.0.0.1",), ("9.9.9.9",)], "text string")
    out = [r.text for r in P.pseudonymise(df, KEY).collect()]
    assert out[0] == out[1] and out[2].split("\n")[0] == out[0][5:] and out[3].count(".") == 3
    assert P.pseudonymise(df.limit(0), KEY).count() == 0
    long = spark.createDataFrame([("word " * 200_000 + "me@here.org",)], "text string")
    assert P.pseudonymise(long, KEY).first().text.endswith(out[0][5:])
