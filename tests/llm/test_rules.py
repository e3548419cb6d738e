from __future__ import annotations

import re

from ticketmill.llm import rules

SCHEMA = "doc_id long, lang string, source string, text string, kept string"


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""),
            len(lines) - len(set(lines)), len(covered))


TEXTS = [
    None, "", " \n\t", "one", "a b c d e a b c d e", "a a a a a a a a", "x\nx\n\ny\nx \n\x0b\n", "naïve 🙂🙂 #*$%&|<> end",
    "a b c d e f g h i j k l m n o p", "  lead and trail \r\n", "a b c d e f a b c d e g b c d e g", "word " * 5000,
    "  nbsp is no separator", "<b>|x|</b>",
]


def test_counts_as_plain(spark):
    rows = [(i, "en", None, t, "x") for i, t in enumerate(TEXTS)] + [(None, None, "s", "a b c", "x"), (3, "en", "s", "one", "x")]
    got = rules.filter_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = TEXTS[r.doc_id] if r.doc_id is not None else "a b c"
        counts = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert counts == plain(text), text
        assert r.base_failed == (counts[0] < 10 or 100 * counts[4] > 20 * counts[0])
        assert not (r.kept and r.base_failed)


def test_thresholds_follow_the_group(spark):
    def text(i, mark=""):
        return " ".join(f"word{i}x{k}{mark}" for k in range(20))

    rows = [(i, "en", "plain", text(i), None) for i in range(60)] + [(100, "en", "plain", text(100, "#$"), None)]
    rows += [(200 + i, "en", "shell", text(200 + i, "#$"), None) for i in range(60)]
    rows += [(300, "en", "rare", text(300), None), (301, "en", "rare", text(301, "#$" * 9), None)]
    kept = {r.doc_id: r.kept for r in rules.filter_documents(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not kept[100] and not kept[301] and kept[300]
    assert all(v for i, v in kept.items() if i not in (100, 301))


def test_sketches_merge(spark):
    rows = [(i, "en", "s", "w " * (10 + i % 3) + " ".join(f"v{k}" for k in range(30)), None) for i in range(80)]
    measured = rules.metrics(rules.text_features(spark.createDataFrame(rows, SCHEMA), ["doc_id", "lang", "source"], rules.F.col("text")))
    whole = rules.thresholds(rules.sketches(measured)).collect()
    halves = rules.sketches(measured.where("doc_id < 40")).unionAll(rules.sketches(measured.where("doc_id >= 40")))
    assert rules.thresholds(halves).collect() == whole


def test_empty(spark):
    assert rules.filter_documents(spark.createDataFrame([], SCHEMA)).count() == 0
