"""Which names contain which hints, by postings of short substrings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grams(text: Column, sizes: tuple[int, ...] = (1, 2, 3)) -> Column:
    """The distinct substrings of some lengths; linear in the text."""
    chars = F.split(text, "")

    def of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(chars) - (n - 1))
        cut = F.transform(starts, lambda i: F.array_join(F.slice(chars, i, n), ""))
        return F.when(F.length(text) >= n, cut).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*[of(n) for n in sizes]))


def contains_pairs(hints: DataFrame, hint: str, names: DataFrame, name: str, key: str) -> DataFrame:
    """``(hint, key)`` of every distinct hint and the names that contain it.

    A name is posted under its substrings of one to three letters. A hint of
    three letters or more looks at the rarest of its trigrams only and is
    compared with the names there; a shorter one is a substring itself and finds
    its names without a comparison. Nulls and empty hints match nothing.
    """
    wanted = hints.select(F.col(hint).alias("hint")).where("hint <> ''").distinct()
    asked = wanted.select(
        "hint", F.explode(F.when(F.length("hint") < 3, F.array("hint")).otherwise(grams(F.col("hint"), (3,)))).alias("gram")
    )
    posted = names.select(F.col(key), F.col(name).alias("_name")).where("_name <> ''")
    postings = posted.select(key, F.explode(grams(F.col("_name"))).alias("gram")).join(
        asked.select("gram").distinct(), "gram", "left_semi"
    )
    frequency = postings.groupBy("gram").agg(F.count("*").alias("_n"))
    # a hint with a trigram that no name has matches nothing
    rarest = asked.join(frequency, "gram", "left").groupBy("hint").agg(
        F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "gram")).alias("r")
    ).where("r.n > 0").select("hint", F.col("r.gram").alias("gram"))
    near = rarest.join(postings, "gram").select("hint", key)
    checked = near.join(posted, key).where((F.length("hint") < 3) | F.contains("_name", F.col("hint")))
    return checked.select("hint", key).distinct()
