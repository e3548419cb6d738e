"""Robust seasonal baseline of ticket creation per weekday and hour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketmill import defaults as D
from ticketmill.functions.times import local_time, slot


def _median(values: Column, n: int) -> Column:
    """Median of an array of known length."""
    ordered = F.array_sort(values)
    mid = n // 2
    if n % 2:
        return F.element_at(ordered, mid + 1).cast("double")
    return (F.element_at(ordered, mid) + F.element_at(ordered, mid + 1)) / 2.0


def compute_baseline(
    tickets: DataFrame, now: Column, weeks: int = D.BASELINE_WEEKS, tz: str = D.BASELINE_TZ,
    full_weeks_only: bool = False,
) -> DataFrame:
    """Median and MAD of the weekly counts per (system key, weekday, hour).

    ``tickets`` has ``created_at`` and ``system_key``. The series covers the
    ISO weeks that the trailing ``weeks*7+1`` local days touch, with zeros; a
    slot seen only outside them still gets a row. ``full_weeks_only`` leaves out
    the two partial weeks at the ends.

    One counter per week, one aggregation, one shuffle of (slot) rows: no slot
    by week product and no list of tickets is ever built.
    """
    local = local_time(F.col("created_at"), tz)
    this_week = F.date_trunc("week", local_time(now, tz))
    back = F.round(F.date_diff(this_week, F.date_trunc("week", local)) / 7).cast("int")
    dow, hour = slot(F.col("created_at"), tz)
    ages = range(1, weeks) if full_weeks_only else range(weeks + 1)
    counted = (
        tickets.filter("created_at IS NOT NULL")
        .select(F.col("system_key").alias("key"), dow.alias("dow"), hour.alias("hour"), back.alias("_w"))
        .groupBy("key", "dow", "hour")
        .agg(*[F.count_if(F.col("_w") == a).alias(f"_c{a}") for a in ages])
    )
    n = len(ages)
    series = counted.select("key", "dow", "hour", F.array(*[f"_c{a}" for a in ages]).alias("_s"))
    with_median = series.withColumn("median", _median(F.col("_s"), n))
    deviation = F.transform("_s", lambda v: F.abs(v - F.col("median")))
    return with_median.select(
        "key", "dow", "hour", F.lit(n).alias("n"), "median", _median(deviation, n).alias("mad")
    )


def threshold(median: Column, mad: Column, k_sigma: float = D.BASELINE_SIGMA) -> Column:
    """``max(3, median + k * 1.4826 * mad)``; missing values count as 0."""
    zero = F.lit(0.0)
    sigma = D.MAD_TO_SIGMA * F.coalesce(mad, zero)
    return F.greatest(F.lit(3.0), F.coalesce(median, zero) + k_sigma * sigma)


def baseline_gate(observed: Column, median: Column, mad: Column) -> Column:
    """Enough for an alert; without a baseline the plain minimum of 3 holds."""
    known = median.isNotNull() & mad.isNotNull()
    return F.when(known, observed >= threshold(median, mad)).otherwise(observed >= 3)


def baseline_lookup(
    cluster_keys: DataFrame, baseline: DataFrame, at: str = "tick", tz: str = D.BASELINE_TZ
) -> DataFrame:
    """Left join of (cluster, system key, time) rows to the slot's baseline."""
    dow, hour = slot(F.col(at), tz)
    rows = baseline.select(F.col("key").alias("system_key"), "dow", "hour", "median", "mad")
    return (
        cluster_keys.withColumns({"dow": dow, "hour": hour})
        .join(rows, ["system_key", "dow", "hour"], "left")
        .drop("dow", "hour")
    )


def baseline_threshold(
    cluster_keys: DataFrame, baseline: DataFrame, by: list[str], at: str = "tick",
    k_sigma: float = D.BASELINE_SIGMA, tz: str = D.BASELINE_TZ,
) -> DataFrame:
    """Largest slot threshold over a cluster's system keys; null without a match."""
    found = baseline_lookup(cluster_keys, baseline, at, tz)
    value = F.when(F.col("median").isNotNull(), threshold(F.col("median"), F.col("mad"), k_sigma))
    return found.groupBy(*by).agg(F.max(value).alias("threshold"))
