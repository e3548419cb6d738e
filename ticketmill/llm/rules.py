"""Quality rules whose thresholds come from quantile sketches per language and source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketmill.functions.once import compute_once
from ticketmill.llm.common import materialise, prepare

WHITE = " \t\n\x0b\f\r"
WHITE_RUN = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MARKS = "!?"
WINDOW = 5
MIN_WORDS, MAX_REPEAT = 10, 20  # the base rules: words, percent of repeated words

# Metric and slack: how far beyond the fence of its group a value may lie in any case.
METRICS = {
    "symbol_share": 0.05, "mark_rate": 0.25, "dup_line_share": 0.35, "repeat_share": 0.15, "word_length": 1.5,
}
# Size of a sketch, how many quartile distances make the fence, and the rows
# below which a group borrows the sketch of its language, or of all rows.
SKETCH_K, REACH, MIN_ROWS = 4096, 3.0, 30


def text_features(docs: DataFrame, keep: list[str], text: Column) -> DataFrame:
    """``keep`` and the counts of each whole text; see ``filter_documents`` for their meaning.

    Everything happens within the row: repeated windows are found by hashing
    each window of a text and, where two hashes are equal, sorting them.
    """
    whole = F.coalesce(text, F.lit(""))
    trimmed = F.btrim(whole, F.lit(WHITE))
    lines = F.filter(F.split(whole, "\n", -1), lambda line: F.btrim(line, F.lit(WHITE)) != "")
    first = compute_once(docs, keep, {
        "words": F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WHITE_RUN)),
        "lines": F.when(F.contains(whole, F.lit("\n")), lines).otherwise(F.array().cast("array<string>")),
        "word_chars": F.length(F.translate(whole, WHITE, "")).cast("bigint"),
        "n_symbols": (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("bigint"),
        "n_marks": (F.length(whole) - F.length(F.translate(whole, MARKS, ""))).cast("bigint"),
    })
    counts = ["n_words", "word_chars", "n_symbols", "n_marks", "n_lines", "n_dup_lines"]
    windows = F.transform(
        F.sequence(F.lit(0), F.size("words") - WINDOW),
        lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(WINDOW)]),
    )
    hashed = compute_once(first, [*keep, "word_chars", "n_symbols", "n_marks"], {
        "n_words": F.size("words").cast("bigint"),
        "n_lines": F.greatest(F.size("lines"), F.least(F.size("words"), F.lit(1))).cast("bigint"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint"),
        "hashes": F.when(F.size("words") >= WINDOW, windows).otherwise(F.array().cast("array<bigint>")),
    })
    ordered = compute_once(hashed, [*keep, *counts], {
        "ordered": F.when(
            F.size(F.array_distinct("hashes")) < F.size("hashes"),
            F.array_sort(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        )
    })

    def met(e: Column, k: Column) -> Column:
        return F.coalesce(F.get("ordered", k - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(
            F.get("ordered", k + 1)["h"] == e["h"], F.lit(False)
        )

    repeated = compute_once(ordered, [*keep, *counts], {
        "starts": F.sort_array(F.transform(F.filter("ordered", met), lambda e: e["i"]))
    })
    covered = F.aggregate(
        F.transform("starts", lambda p, k: F.least(F.coalesce(F.get("starts", k + 1) - p, F.lit(WINDOW)), F.lit(WINDOW))),
        F.lit(0).cast("bigint"), lambda total, x: total + x,
    )
    return repeated.select(*keep, *counts, F.coalesce(covered, F.lit(0).cast("bigint")).alias("n_repeat_words"))


def metrics(features: DataFrame) -> DataFrame:
    """The counts as shares, so that texts of any length compare."""
    def share(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.col(part).cast("double") / F.col(whole)).otherwise(F.lit(0.0))

    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    return features.withColumns({
        "base_failed": base_failed,
        "symbol_share": share("n_symbols", "word_chars"), "mark_rate": share("n_marks", "n_words"),
        "dup_line_share": share("n_dup_lines", "n_lines"), "repeat_share": share("n_repeat_words", "n_words"),
        "word_length": share("word_chars", "n_words"),
    })


def sketches(measured: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """One mergeable sketch per language, source and metric, over the rows that pass the base rules.

    Sketches are built in every task before the shuffle, so a source may hold
    any part of the rows. Tables of sketches of further data can be added with
    ``unionAll``: ``thresholds`` merges them.
    """
    passed = measured.where("NOT base_failed")
    return passed.groupBy(F.col(lang).alias("lang"), F.col(source).alias("source")).agg(
        F.count("*").alias("n"), *[F.kll_sketch_agg_double(m, F.lit(SKETCH_K)).alias(m) for m in METRICS]
    )


def thresholds(found: DataFrame) -> DataFrame:
    """``lang``, ``source`` and per metric the highest value that is usual there, ``max_<metric>``.

    The upper quartile plus ``REACH`` times the distance of the quartiles plus
    the slack of the metric. Groups of fewer than ``MIN_ROWS`` rows take the
    merged sketch of their language, and where that has too few rows too, of all.
    """
    def merged(df: DataFrame, *keys: str) -> DataFrame:
        return df.groupBy(*keys).agg(
            F.sum("n").alias("n"), *[F.kll_merge_agg_double(m).alias(m) for m in METRICS]
        )

    def fences(df: DataFrame, keys: list[str], suffix: str) -> DataFrame:
        def fence(m: str) -> Column:
            low, high = (F.kll_sketch_get_quantile_double(m, F.lit(q)) for q in (0.25, 0.75))
            return high + F.lit(REACH) * (high - low) + F.lit(METRICS[m])

        return df.select(*keys, F.col("n").alias(f"n{suffix}"), F.struct(*[fence(m).alias(m) for m in METRICS]).alias(f"f{suffix}"))

    own = merged(found, "lang", "source")
    by_lang = fences(merged(own, "lang"), ["lang"], "_lang").withColumnRenamed("lang", "_lang")
    over_all = fences(merged(own).where("n IS NOT NULL"), [], "_all")
    joined = fences(own, ["lang", "source"], "_own").join(by_lang, F.col("lang").eqNullSafe(F.col("_lang"))).join(
        F.broadcast(over_all)  # one row
    )
    best = F.when(F.col("n_own") >= MIN_ROWS, F.col("f_own")).when(
        F.col("n_lang") >= MIN_ROWS, F.col("f_lang")
    ).otherwise(F.col("f_all"))
    return joined.select("lang", "source", best.alias("f")).select(
        "lang", "source", *[F.col(f"f.{m}").alias(f"max_{m}") for m in METRICS]
    )


def filter_documents(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang: str = "lang", source: str = "source",
) -> DataFrame:
    """Per row: the id, the counts of its text, ``base_failed``, ``kept`` and the metrics.

    ``n_words``; ``word_chars``: code points in words; ``n_symbols``: characters
    of ``SYMBOLS``; ``n_dup_lines``: lines with a word that equal an earlier one;
    ``n_repeat_words``: words in five-word windows that the text has twice or
    more. ``base_failed``: fewer than ten words, or more than 20 % repeated.
    ``kept``: not failed, and no metric above the threshold of its language and
    source.

    Null and empty text have no words and fail. A null language or source is a
    group like any other. Repeated rows give repeated rows, a null id stays null,
    an empty table gives an empty table; other columns are not read.
    """
    prepare(docs.sparkSession)
    named = docs.select(
        docs[id_column].alias("id"), docs[lang].alias("lang"), docs[source].alias("source"), docs[text_column].alias("text")
    )
    measured = materialise(metrics(text_features(named, ["id", "lang", "source"], F.col("text"))))
    limits = thresholds(sketches(measured)).select(
        F.col("lang").alias("_lang"), F.col("source").alias("_source"), *[f"max_{m}" for m in METRICS]
    )
    usual = F.lit(True)
    for m in METRICS:
        usual = usual & (F.col(m) <= F.col(f"max_{m}"))
    joined = measured.join(
        limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left"
    )
    return joined.select(
        F.col("id").alias(id_column), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce(usual, F.lit(False))).alias("kept"), *METRICS,
    )


ORACLE = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents
), win AS (
  SELECT r, i, list_aggregate(w[i:i + {WINDOW - 1}], 'string_agg', ' ') AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW})
), rep AS (
  SELECT r, count(DISTINCT p) AS n FROM (
    SELECT r, unnest(range(i, i + {WINDOW})) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1
  ) GROUP BY r
), f AS (
  SELECT doc_id, lang, source, len(w) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, length(regexp_replace(t, '[^!?]', '', 'g')) AS n_marks,
         len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM d LEFT JOIN rep USING (r)
), m AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed,
         CASE WHEN word_chars > 0 THEN n_symbols::DOUBLE / word_chars ELSE 0 END AS symbol_share,
         CASE WHEN n_words > 0 THEN n_marks::DOUBLE / n_words ELSE 0 END AS mark_rate,
         CASE WHEN n_lines > 0 THEN n_dup_lines::DOUBLE / n_lines ELSE 0 END AS dup_line_share,
         CASE WHEN n_words > 0 THEN n_repeat_words::DOUBLE / n_words ELSE 0 END AS repeat_share,
         CASE WHEN n_words > 0 THEN word_chars::DOUBLE / n_words ELSE 0 END AS word_length
  FROM f
), q AS (
  SELECT lang, source, grouping(lang) AS no_lang, grouping(source) AS no_source, count(*) AS n,
         {", ".join(f"quantile_disc({x}, 0.25) AS {x}_low, quantile_disc({x}, 0.75) AS {x}_high" for x in METRICS)}
  FROM m WHERE NOT base_failed GROUP BY GROUPING SETS ((lang, source), (lang), ())
), t AS (
  SELECT m.doc_id, m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words, m.base_failed,
         {", ".join(f"m.{x}, b.{x}_high + {REACH} * (b.{x}_high - b.{x}_low) + {s} AS max_{x}" for x, s in METRICS.items())}
  FROM m
  LEFT JOIN q o ON o.lang IS NOT DISTINCT FROM m.lang AND o.source IS NOT DISTINCT FROM m.source AND o.no_source = 0
  LEFT JOIN q l ON l.lang IS NOT DISTINCT FROM m.lang AND l.no_source = 1 AND l.no_lang = 0
  LEFT JOIN q b ON b.no_source = CASE WHEN o.n >= {MIN_ROWS} THEN 0 ELSE 1 END
    AND b.no_lang = CASE WHEN o.n >= {MIN_ROWS} OR l.n >= {MIN_ROWS} THEN 0 ELSE 1 END
    AND (b.no_source = 1 OR b.source IS NOT DISTINCT FROM m.source) AND (b.no_lang = 1 OR b.lang IS NOT DISTINCT FROM m.lang)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {" AND ".join(f"coalesce({x} <= max_{x}, false)" for x in METRICS)} AS kept,
       {", ".join(METRICS)}
FROM t
"""
