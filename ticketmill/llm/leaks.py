"""Benchmark decontamination by spaced-seed hashing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketmill.functions.once import compute_once
from ticketmill.llm.common import free_names, materialise, prepare

# Positions with 1 must agree, positions with 0 are ignored. The first mask has
# no gap; the others find overlaps whose agreeing runs are shorter than five.
MASKS = ("11111", "110111", "1101011", "11001101")
# A leak: this share of the words where text and item lie side by side, if that
# is at least so many words (a shorter item: all of its words); or a stretch that scores as high (a word that
# agrees counts 1, another -4, so a stretch has four fifths of its words).
SHARE, LEAST_WORDS, PENALTY, STRETCH = 0.8, 8, 4, 13
# Seeds of the benchmark that are broadcast at most, about 40 bytes each.
BROADCAST_SEEDS = 1_000_000
SPLIT = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; none for null."""
    return F.coalesce(F.array_remove(F.split(F.lower(text), SPLIT), ""), F.array().cast("array<string>"))


def seed_hashes(own: str, at: Column) -> Column:
    """One hash per mask of the words at its ones, from word ``at`` (from 0); null beyond the end."""
    def one(number: int, mask: str) -> Column:
        picked = [F.get(own, at + k) for k, bit in enumerate(mask) if bit == "1"]
        return F.when(at + len(mask) <= F.size(own), F.xxhash64(F.lit(number), *picked))

    return F.array(*[one(n, m) for n, m in enumerate(MASKS)])


def seeds(df: DataFrame, keep: list[str], own: str) -> DataFrame:
    """``keep``, ``at``, ``mask``, ``seed``: every window of every mask."""
    starts = df.select(*keep, F.explode(F.sequence(F.lit(0), F.size(own) - len(MASKS[0]))).alias("at"))
    return starts.select(*keep, "at", F.posexplode(seed_hashes(own, F.col("at"))).alias("mask", "seed")).where("seed IS NOT NULL")


def _news() -> Column:
    """Whether a hit says something that no other hit on its diagonal says.

    Of a run of agreeing words only the first gapless window is kept, and a
    window with gaps only if a word in a gap differs (else the gapless one is there).
    """
    def same(k: int) -> Column:
        return F.get("words", F.col("at") + k) == F.get("item_words", F.col("item_at") + k)

    news = (F.col("mask") == 0) & ~F.when((F.col("at") > 0) & (F.col("item_at") > 0), same(-1)).otherwise(F.lit(False))
    for number, mask in enumerate(MASKS[1:], 1):
        gaps = F.lit(True)
        for k, bit in enumerate(mask):
            if bit == "0":
                gaps = gaps & same(k)
        news = news | ((F.col("mask") == number) & ~gaps)
    return news


def overlaps(docs: DataFrame, items: DataFrame, keep: list[str], text: Column) -> DataFrame:
    """Verified leaks: ``keep``, ``item_id``, ``matched``, ``overlap``, ``stretch``, one row per kept hit.

    ``items`` has ``item_id`` and ``text``. Seeds of texts and items are joined
    by their hash. Around a hit the whole item is laid beside the text and
    compared word by word.
    """
    listed = compute_once(items.where("text IS NOT NULL"), ["item_id"], {"item_words": words(F.col("text"))})
    listed = materialise(listed.where(F.size("item_words") >= len(MASKS[0])))
    known = seeds(listed, ["item_id", "item_words"], "item_words").select(
        "item_id", "seed", F.col("at").alias("item_at"), F.col("mask").alias("item_mask")
    )
    small = known.limit(BROADCAST_SEEDS + 1).count() <= BROADCAST_SEEDS
    known, texts = (F.broadcast(known), F.broadcast(listed)) if small else (known, listed)
    own = compute_once(docs, keep, {"words": words(text)}).where(F.size("words") >= len(MASKS[0]))
    hits = seeds(own, [*keep, "words"], "words").join(known, "seed").where("mask = item_mask").join(texts, "item_id").where(_news())
    shift = F.col("at") - F.col("item_at")
    begin, item_begin = F.greatest(shift, F.lit(0)), F.greatest(-shift, F.lit(0))
    length = F.least(F.size("words") - begin, F.size("item_words") - item_begin)
    beside = F.zip_with(
        F.slice("words", begin + 1, length), F.slice("item_words", item_begin + 1, length),
        lambda a, b: F.when(a == b, 1).otherwise(-PENALTY),
    )
    start = F.struct(F.lit(0).alias("best"), F.lit(0).alias("here"), F.lit(0).alias("same"))

    def step(s: Column, x: Column) -> Column:
        here = F.greatest(s["here"] + x, F.lit(0))
        return F.struct(F.greatest(s["best"], here).alias("best"), here.alias("here"), (s["same"] + (x == 1).cast("int")).alias("same"))

    found = compute_once(
        hits, [*keep, "item_id"], {"overlap": length, "size": F.size("item_words"), "s": F.aggregate(beside, start, step)}
    ).withColumns({"matched": F.col("s.same"), "stretch": F.col("s.best")})
    long = (F.col("overlap") >= LEAST_WORDS) & (F.col("matched") >= SHARE * F.col("overlap"))
    short = (F.col("size") < LEAST_WORDS) & (F.col("matched") == F.col("size"))
    return found.where(long | short | (F.col("stretch") >= STRETCH)).select(*keep, "item_id", "overlap", "matched", "stretch")


def leaks(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Leaked items of each text: the id, ``text_key``, ``n_items``, ``matched``, ``overlap``, ``item_id`` of the best.

    The best item is that with the most words that agree, then the smallest id.
    """
    text = F.col("text")
    named = docs.select(docs[id_column].alias("id"), F.xxhash64(docs[text_column]).alias("text_key"), docs[text_column].alias("text"))
    found = overlaps(named, items, ["id", "text_key"], text)
    best = F.max(F.struct(F.col("matched"), (-F.col("overlap")).alias("shorter"), "stretch")).alias("b")
    per_item = found.groupBy("id", "text_key", "item_id").agg(best)
    top = F.max(F.struct(F.col("b.matched"), (-F.col("item_id")).alias("first"), F.col("b.shorter"))).alias("t")
    return per_item.groupBy("id", "text_key").agg(F.count("*").alias("n_items"), top).select(
        F.col("id").alias(id_column), "text_key", "n_items", F.col("t.matched").alias("matched"),
        (-F.col("t.shorter")).alias("overlap"), (-F.col("t.first")).alias("item_id"),
    )


def contamination(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row of ``docs``: the id, ``contaminated``, ``n_items``, ``item_id``, ``matched``, ``overlap``.

    Words are lower-cased runs of letters and digits, so case, punctuation and
    line breaks do not matter. A text is contaminated if an item lies in it with
    at least four fifths of its words (an item of five to seven words: with all
    of them), or a long stretch of an item does. The
    benchmark's seeds are broadcast when they are few enough (counted first) and
    joined by their hash in a shuffle otherwise.

    Null and empty text, and texts or items of fewer than five words, match
    nothing. Null items are ignored, an item listed twice counts once. Repeated
    rows give repeated rows, a null id stays null, empty tables give no leak;
    other columns are not read.
    """
    prepare(docs.sparkSession)
    found = leaks(docs, items, id_column, text_column)
    known = found.select(
        F.col(id_column).alias("_id"), F.col("text_key").alias("_key"), "n_items", "item_id", "matched", "overlap"
    )
    rows = docs.select(docs[id_column].alias("id"), F.xxhash64(docs[text_column]).alias("text_key"))
    joined = rows.join(known, (F.col("text_key") == F.col("_key")) & F.col("id").eqNullSafe(F.col("_id")), "left")
    return joined.select(
        F.col("id").alias(id_column), F.col("n_items").isNotNull().alias("contaminated"),
        F.coalesce("n_items", F.lit(0).cast("bigint")).alias("n_items"), "item_id",
        F.coalesce("matched", F.lit(0)).cast("bigint").alias("matched"),
        F.coalesce("overlap", F.lit(0)).cast("bigint").alias("overlap"),
    )


def without_leaks(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` without the contaminated rows."""
    prepare(docs.sparkSession)
    key, text_key = free_names(docs, "_id", "_key")
    found = leaks(docs, items, id_column, text_column).select(F.col(id_column).alias(key), F.col("text_key").alias(text_key))
    same = (F.xxhash64(docs[text_column]) == F.col(text_key)) & docs[id_column].eqNullSafe(F.col(key))
    return docs.join(found, same, "left_anti")


def _masked(own: str, at: str) -> str:
    def one(number: int, mask: str) -> str:
        picked = ", ".join(f"{own}[{at} + {k + 1}]" for k, bit in enumerate(mask) if bit == "1")
        return f"CASE WHEN {at} + {len(mask)} <= len({own}) THEN concat_ws(' ', '{number}', {picked}) END"

    return f"[{', '.join(one(n, m) for n, m in enumerate(MASKS))}]"


def _words(text: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({text}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


ORACLE = f"""
WITH d AS (SELECT doc_id, {_words("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT item_id, {_words("text")} AS v FROM benchmark WHERE text IS NOT NULL),
dp AS (SELECT doc_id, w, unnest(range(0, len(w) - {len(MASKS[0]) - 1})) AS i FROM d),
ds AS (SELECT doc_id, i, unnest({_masked("w", "i")}) AS s FROM dp),
bp AS (SELECT item_id, v, unnest(range(0, len(v) - {len(MASKS[0]) - 1})) AS j FROM b),
bs AS (SELECT item_id, j, unnest({_masked("v", "j")}) AS s FROM bp),
diagonals AS (SELECT DISTINCT doc_id, item_id, i - j AS shift FROM ds JOIN bs USING (s) WHERE s IS NOT NULL),
cells AS (
  SELECT doc_id, item_id, shift, k, len(v) AS size, CASE WHEN w[k + shift + 1] = v[k + 1] THEN 1 ELSE -{PENALTY} END AS x
  FROM (SELECT *, unnest(range(greatest(0, -shift), least(len(v), len(w) - shift))) AS k
        FROM diagonals JOIN d USING (doc_id) JOIN b USING (item_id))
), sums AS (
  SELECT *, sum(x) OVER (PARTITION BY doc_id, item_id, shift ORDER BY k) AS s FROM cells
), lows AS (
  SELECT *, least(0, min(s) OVER (PARTITION BY doc_id, item_id, shift ORDER BY k)) AS low FROM sums
), per AS (
  SELECT doc_id, item_id, shift, count(*) AS overlap, count(*) FILTER (x = 1) AS matched, max(s - low) AS stretch
  FROM lows GROUP BY ALL
  HAVING (count(*) >= {LEAST_WORDS} AND count(*) FILTER (x = 1) >= {SHARE} * count(*)) OR max(s - low) >= {STRETCH}
      OR (max(size) < {LEAST_WORDS} AND count(*) FILTER (x = 1) = max(size))
), items AS (
  SELECT doc_id, item_id, arg_max((matched, overlap), (matched, -overlap, stretch)) AS b FROM per GROUP BY ALL
), best AS (
  SELECT doc_id, count(*) AS n_items, arg_max((item_id, b[1], b[2]), (b[1], -item_id)) AS t FROM items GROUP BY ALL
)
SELECT doc_id, n_items IS NOT NULL AS contaminated, coalesce(n_items, 0) AS n_items, t[1] AS item_id,
       coalesce(t[2], 0) AS matched, coalesce(t[3], 0) AS overlap
FROM d LEFT JOIN best USING (doc_id)
"""
