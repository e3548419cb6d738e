"""Text functions on literals and on generated strings."""

import random
import re
import time
from datetime import datetime

from pyspark.sql import functions as F

from ticketmill.functions import entities, rules, status, text, times

ODD = [
    "\xa0", "\xe9", "\xdf", "\r\n", "\u2028", "\x1c", "\x85", "_", "-", "\u0661", "\xf1", "  ", "\t", "\n",
    "A", "z", "9", ".", "\u0301",
]


def generated(n=400, seed=7):
    rng = random.Random(seed)
    words = ["Outlook", "can't", "log", "in", "0x80070005", "error", "x_y"]
    return ["".join(rng.choice(ODD + words + [" "]) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_strip_html_decodes_in_fixed_order(one):
    got = one(["<i>Tea</i> &amp;gt;c&lt; &#39;y&quot;", "", None], lambda t: text.strip_html(t))
    assert got == [" Tea  >c< 'y\"", "", ""]


def test_normalize_and_signature_parity(one):
    values = generated()
    assert one(values, lambda t: text.normalize(t)) == [" ".join(re.findall("[a-z0-9]+", v.lower())) for v in values]
    want = ["".join(c for c in v.lower() if c.isalnum() or c == "_")[:400] for v in values]
    assert one(values, lambda t: text.resolution_signature(t)) == want


def test_strip_space_parity(one):
    values = generated(seed=3)
    assert one(values, lambda t: text.strip_space(t)) == [v.strip() for v in values]


def test_clean_text_cuts_chain_and_signature(one):
    body = "The scale shows no weight.\nThanks,\nIda\n\nOn Tue, Mar 4, Omar wrote:\n>> earlier text"
    assert one([body], lambda t: text.clean_text(t)) == ["The scale shows no weight."]


QUOTES = ["On Tue, Omar wrote:", "  -- Original Message --", "From: a@b", "______"]
SIGNS = ["Thanks,", "best!", "Sent from my phone", "--", "Confidentiality notice: x", "THANK YOU. "]
OPENERS = ["Hello Ida, thank you for contacting us.", "hi thanks for contacting the desk"]
BODY = ["It fails", "  indented line", "on a Monday it broke", "thanks to Ida it works", "from home", "caf\xe9\xa0x", "- item"]
BREAKS = ["\n", "\r\n", "\r", "\n\n", " \n", "\n \t\n", "\u2028", "\x1d", "\x85", "\xa0\n"]


def test_clean_text_on_generated_messages(one):
    rng = random.Random(11)
    values, want = [], []
    for _ in range(500):
        pieces = [rng.choices((BODY, QUOTES, SIGNS, OPENERS), (12, 1, 1, 2))[0] for _ in range(rng.randint(1, 9))]
        lines = [rng.choice(p) for p in pieces]
        values.append("".join(line + rng.choice(BREAKS) for line in lines))
        kinds = list(zip(pieces, lines))
        for stop in (QUOTES, SIGNS):
            at = next((i for i, (p, _) in enumerate(kinds) if p is stop), len(kinds))
            kinds = kinds[:at]
        want.append("\n".join(line.rstrip() for p, line in kinds if p is not OPENERS).strip())
    assert one(values, lambda t: text.clean_text(t)) == want


def test_clean_text_is_linear_on_long_runs(one):
    assert one([" " * 200_000 + "x", "\n" * 200_000 + "y" + " " * 100_000], lambda t: text.clean_text(t)) == ["x", "y"]


def test_redact(one):
    value = (
        "pwd: Quartz#77 and recovery key: 0A1B2C3D-1111-2222-3333-444455556666 "
        "mail dana@example.org or 312-555-0188, not 98765432109876"
    )
    assert one([value], lambda t: text.redact(t)) == [
        "<redacted-secret> and recovery key: <redacted-key> mail <email> or <phone>, not 98765432109876"
    ]
    assert one(["ring 312 555 0188"], lambda t: text.redact(t, contacts=False)) == ["ring 312 555 0188"]


def test_secret_only(one):
    values = [
        "recovery key: 0A1B2C3D-1111-2222-3333-444455556666",
        "replaced the disk of the front desk and noted its key, it is 0A1B2C3D-1111-2222-3333-444455556666",
        "plain", None,
    ]
    assert one(values, lambda t: text.is_secret_only(t)) == [True, False, False, False]
    assert one(values, lambda t: text.contains_secret(t)) == [True, True, False, False]


def test_sanitize(one):
    assert one(["<b>Done</b> password: plum55"], lambda t: text.sanitize(t)) == ["Done  <redacted-secret>"]


def test_entities(one):
    value = "Stopped with 0x8004210B, code 4412, HTTP 503, CODE: 4412 on kio4-pos-207 and UPS-Lisbon3 at till.shop.example"
    assert one([value], lambda t: entities.extract_error_codes(t)) == [["0x8004210B", "4412", "503"]]
    hosts = one([value], lambda t: entities.extract_hostnames(t, patterns=None))[0]
    assert hosts == ["kio4-pos-207", "UPS-Lisbon3"]
    from ticketmill.defaults import hostname_patterns
    sites = one([value], lambda t: entities.extract_hostnames(t, patterns=hostname_patterns(("shop.example",))))[0]
    assert sites[-1] == "till.shop.example"
    assert one(["Outlook crossword, not Teams"], lambda t: entities.extract_apps(t)) == [["outlook", "teams", "word"]]


def test_spellings_of_many_words_take_no_time_each(one):
    words = [w for n in range(20_000) for w in (f"Word{n}", f"word{n}", f" WORD{n} ")]
    started = time.perf_counter()
    (got,) = one([words], entities.dedupe_ci, "array<string>")
    assert got == [f"Word{n}" for n in range(20_000)]
    assert time.perf_counter() - started < 60
    assert one([None, [], [None, "b", "B"], ["", " "]], entities.dedupe_ci, "array<string>") == [None, [], ["b"], []]


def test_dedupe_keeps_first_spelling(one):
    got = one([["b", " A", "a", "", "B ", "c"]], lambda t: entities.dedupe_ci(t), "array<string>")
    assert got == [["b", "A", "c"]]


def test_normalize_store(one):
    def stores(t):
        return entities.normalize_store(F.create_map(F.lit("store"), t, F.lit("location"), F.lit("2-Depot")))

    got = one(['["3-Lisbon", " 6-Turin ", ""]', "a, b,,", "", "[]", None, "[x"], stores)
    assert got == [["3-Lisbon", "6-Turin"], ["a", "b"], ["2-Depot"], ["2-Depot"], ["2-Depot"], ["[x"]]


def test_parse_ts(one):
    got = one(
        ["2025-02-18T10:00:00Z", "2025-02-18T10:00:00.250+02:00", "2025-02-18", "2025-02-18T10", "2025-02-18 10:05",
         "2026", "2026-9-1", "soon", "", None, "2026-02-30T00:00:00Z"],
        lambda t: times.parse_ts(t),
    )
    d = datetime
    assert got == [
        d(2025, 2, 18, 10), d(2025, 2, 18, 8, 0, 0, 250000), d(2025, 2, 18), d(2025, 2, 18, 10), d(2025, 2, 18, 10, 5),
        None, None, None, None, None, None,
    ]


def test_http_date_age(one):
    def age(t):
        return times.http_date_age_hours(t, F.lit("2025-03-15 16:00:00").cast("timestamp"))

    got = one(["Fri, 14 Mar 2025 09:10:30 GMT", "never", None, "Sun, 16 Mar 2025 16:00:00 GMT"], age)
    assert round(got[0], 3) == 30.825 and got[1:3] == [None, None] and got[3] == -24.0


def test_age_days_counts_whole_days(spark):
    df = spark.createDataFrame(
        [("2024-06-20 23:00:00", "2024-06-21 22:00:00"), ("2024-06-20 00:00:00", "2024-06-22 00:00:00"),
         ("2024-06-22 00:00:00", "2024-06-20 00:00:00"), (None, "2024-06-20 00:00:00")], "a string, b string")
    days = [r[0] for r in df.select(times.age_days(F.col("a").cast("timestamp"), F.col("b").cast("timestamp"))).collect()]
    assert days == [0, 2, 0, None]


def test_week_set(spark):
    weeks = times.week_set(spark, "2025-04-02 15:00:00", 4, "America/Detroit").collect()
    assert [(r.iso_year, r.iso_week) for r in weeks] == [(2025, w) for w in range(10, 15)]


def test_status_banner(one):
    pages = [
        "Parcel Desk status is up Last checked 2025-03-19T13:30:00.000Z",
        "Dial Tone status is down",
        "<h2>M status is up</h2><p>How can I check if M is experiencing an outage?</p>",
        "<h2>Edge Net is experiencing issues</h2><p>x</p>",
        '<h2 class="x">M<!-- --> status is up</h2><time id="c" dateTime="2025-03-19T13:30:00.000Z">x</time>',
        "<h2>Some Vendor</h2><p>welcome</p>",
    ]
    got = one(pages, lambda t: status.parse_status_banner(t))
    assert [r.status for r in got] == ["up", "issues", "up", "issues", "up", "unknown"]
    assert got[0].checked.startswith("2025-03-19T13:30") and got[4].checked == "2025-03-19T13:30:00.000Z"


def test_manifest_version(one):
    got = one(['<assemblyIdentity name="a" version="4.0.2.7"/>', '<x version="1.2.3.4"/>', "none"], lambda t: status.manifest_version(t))
    assert got == ["4.0.2.7", "1.2.3.4", None]


def test_small_rules(one):
    assert one(["4", "5", "2", None, "x", " 4 "], lambda t: rules.is_terminal_status(t)) == [True, True, False, False, False, True]
    assert one([None, 5, 30, 31, 180, 365, 900], lambda t: rules.recency_boost(t), "int") == [1.0, 1.15, 1.15, 1.05, 1.05, 1.0, 0.9]
    assert one([True, False, None], lambda t: rules.feedback_outcome(t), "boolean") == ["resolved", "not_resolved", "unknown"]
    assert one(["Computer KIO4-VDI-207 fails", "vpn"], lambda t: rules.pool_hint(t)) == ["kio4", None]
    assert one(["Engage Till", None, ""], lambda t: rules.system_key(F.lit(" Engage "), t)) == ["engage/engage till", "engage", "engage"]
    assert one([None, ""], lambda t: rules.system_key(t, F.lit(None))) == ["uncategorized", "uncategorized"]
