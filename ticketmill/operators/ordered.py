"""Running totals, ranks, lags and range aggregates that survive a hot key.

A plain window over ``key`` sorts a whole key in one task, and one key may hold
a third of all rows. Here each key is cut into time buckets: the bucket totals
(combined map-side, one small row per key and bucket) give the carry-in of each
bucket, and the sort happens per (key, bucket). Keys and times must not be null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SECOND = 1_000_000
MINUTE = 60 * SECOND


def bucket_of(micros: Column, width: int) -> Column:
    return F.floor(micros / F.lit(width)).cast("long")


def running_sum(
    df: DataFrame, keys: Sequence[str], micros: str, order: Sequence[Column], weight: Column,
    out: str, width: int = MINUTE, peers: bool = True,
) -> DataFrame:
    """Sum of ``weight`` over the key's rows up to the current one.

    Rows are ordered by ``micros`` and then ``order``. With ``peers`` rows equal
    in all of them share one total; without, each row counts in turn.
    """
    keys = list(keys)
    df = df.withColumn("_b", bucket_of(F.col(micros), width)).withColumn("_w", weight.cast("long"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        df.groupBy(*keys, "_b").agg(F.sum("_w").alias("_t"))
        .select(*keys, "_b", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_carry"))
    )
    inner = Window.partitionBy(*keys, "_b").orderBy(F.col(micros), *order)
    inner = (
        inner.rangeBetween(Window.unboundedPreceding, Window.currentRow) if peers
        else inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    # the window has partitioned the rows by (key, bucket) already; the join adds
    # no shuffle of them
    summed = df.withColumn("_in", F.sum("_w").over(inner))
    return (
        summed.join(carry, [*keys, "_b"])
        .withColumn(out, F.col("_carry") + F.col("_in"))
        .drop("_b", "_w", "_in", "_carry")
    )


def rank_in_key(
    df: DataFrame, keys: Sequence[str], micros: str, tie: Sequence[Column], out: str = "rank",
    width: int = MINUTE,
) -> DataFrame:
    """Exact ``row_number`` per key, sorted bucket by bucket."""
    return running_sum(df, keys, micros, tie, F.lit(1), out, width, peers=False)


def previous_value(
    df: DataFrame, keys: Sequence[str], micros: str, tie: Sequence[str], value: str, out: str,
    width: int = MINUTE,
) -> DataFrame:
    """``lag(value)`` per key; a bucket's first row takes the last value before it."""
    keys = list(keys)
    df = df.withColumn("_b", bucket_of(F.col(micros), width))
    last = df.groupBy(*keys, "_b").agg(
        F.max(F.struct(micros, *tie, F.struct(F.col(value).alias("v")).alias("s"))).alias("_last")
    )
    carry = last.select(
        *keys, "_b", F.lag("_last.s").over(Window.partitionBy(*keys).orderBy("_b")).alias("_before")
    )
    inner = Window.partitionBy(*keys, "_b").orderBy(micros, *tie)
    lagged = df.withColumn("_in", F.lag(F.struct(F.col(value).alias("v"))).over(inner))
    return (
        lagged.join(carry, [*keys, "_b"])
        .withColumn(out, F.coalesce("_in", "_before")["v"])
        .drop("_b", "_in", "_before")
    )


def range_counts(
    events: DataFrame, probes: DataFrame, keys: Sequence[str], micros: str, probe_id: str,
    ranges: dict[str, tuple[Column, Column]], width: int = MINUTE,
) -> DataFrame:
    """Events of the probe's key in each named half-open range ``[lo, hi)`` in micros.

    Counts come from prefix totals, so a range of any length costs two look-ups
    and no event is paired with a probe. Only the buckets that hold a range edge
    are sorted row by row. Probes without a matching event get 0.
    """
    keys = list(keys)
    names = list(ranges)
    edge_list = F.array(
        *[
            F.struct(F.lit(n).alias("name"), F.lit(sign).alias("sign"), at.cast("long").alias("at"))
            for n, (lo, hi) in ranges.items()
            for sign, at in ((-1, lo), (1, hi))
        ]
    )
    edges = probes.select(probe_id, *keys, F.explode(edge_list).alias("e")).select(
        probe_id, *keys, "e.name", "e.sign", "e.at", bucket_of(F.col("e.at"), width).alias("_b")
    )
    points = events.select(*keys, F.col(micros).alias("at"), bucket_of(F.col(micros), width).alias("_b"))

    # carry-in of every bucket that has an edge: totals of the buckets before it
    totals = points.groupBy(*keys, "_b").agg(F.count("*").alias("_t"))
    marks = edges.select(*keys, "_b").distinct()
    before = Window.partitionBy(*keys).orderBy("_b").rangeBetween(Window.unboundedPreceding, -1)
    carry = (
        totals.withColumn("_mark", F.lit(False))
        .unionByName(marks.withColumns({"_t": F.lit(0).cast("long"), "_mark": F.lit(True)}))
        .groupBy(*keys, "_b").agg(F.sum("_t").alias("_t"), F.bool_or("_mark").alias("_mark"))
        .withColumn("_carry", F.coalesce(F.sum("_t").over(before), F.lit(0)))
        .filter("_mark").drop("_t", "_mark")
    )
    # position of each edge inside its bucket: events strictly before it
    inner = (
        Window.partitionBy(*keys, "_b").orderBy("at", "_ev")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    edge_points = edges.select(*keys, "_b", "at").distinct()
    local = (
        points.join(marks, [*keys, "_b"], "left_semi").select(*keys, "_b", "at", F.lit(1).alias("_ev"))
        .unionByName(edge_points.withColumn("_ev", F.lit(0)))
        .withColumn("_in", F.sum("_ev").over(inner))
        .filter("_ev = 0").drop("_ev")
    )
    at_edge = local.join(carry, [*keys, "_b"]).select(
        *keys, "_b", "at", (F.col("_carry") + F.col("_in")).alias("_n")
    )
    return (
        edges.join(at_edge, [*keys, "_b", "at"])
        .groupBy(probe_id, *keys)
        .agg(
            *[
                F.sum(F.when(F.col("name") == n, F.col("sign") * F.col("_n"))).cast("long").alias(n)
                for n in names
            ]
        )
    )


def range_max(
    points: DataFrame, probes: DataFrame, keys: Sequence[str], micros: str, value: str,
    probe_id: str, ranges: dict[str, tuple[Column, Column]], width: int = MINUTE,
) -> DataFrame:
    """Largest ``value`` of the probe's key in each named range ``[lo, hi)``; else null.

    Whole buckets inside a range are read from a pre-aggregated table; only the
    two edge buckets are compared row by row, once per distinct range.
    """
    keys = list(keys)
    listed = F.array(
        *[
            F.struct(F.lit(n).alias("_name"), lo.cast("long").alias("_lo"), hi.cast("long").alias("_hi"))
            for n, (lo, hi) in ranges.items()
        ]
    )
    ranged = probes.select(probe_id, *keys, F.inline(listed))
    distinct = (
        ranged.select(*keys, "_lo", "_hi").distinct()
        .withColumn("_first", bucket_of(F.col("_lo"), width))
        .withColumn("_last", bucket_of(F.col("_hi") - 1, width))
        .filter("_hi > _lo")
    )
    points = points.select(*keys, F.col(micros).alias("_at"), F.col(value).alias("_v")).withColumn(
        "_b", bucket_of(F.col("_at"), width)
    )
    whole = points.groupBy(*keys, "_b").agg(F.max("_v").alias("_v"))
    middle = (
        distinct.filter("_last - _first > 1")
        .withColumn("_b", F.explode(F.sequence(F.col("_first") + 1, F.col("_last") - 1)))
        .join(whole, [*keys, "_b"])
        .select(*keys, "_lo", "_hi", "_v")
    )
    rims = distinct.withColumn("_b", F.explode(F.array_distinct(F.array("_first", "_last"))))
    rim = (
        rims.join(points, [*keys, "_b"]).filter("_at >= _lo AND _at < _hi")
        .select(*keys, "_lo", "_hi", "_v")
    )
    best = middle.unionByName(rim).groupBy(*keys, "_lo", "_hi").agg(F.max("_v").alias("_v"))
    return (
        ranged.join(best, [*keys, "_lo", "_hi"], "left").groupBy(probe_id, *keys)
        .agg(*[F.max(F.when(F.col("_name") == n, F.col("_v"))).alias(n) for n in ranges])
    )
