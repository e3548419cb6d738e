"""Batch monitor: candidate clusters per tick, baseline gate, cooldown, lifecycle."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketmill import defaults as D
from ticketmill.functions.times import slot
from ticketmill.operators.baseline import baseline_threshold
from ticketmill.operators.baseline import threshold as slot_threshold
from ticketmill.operators.clusters import cluster_counts, window_tickets
from ticketmill.sources.records import alert_id


def tick_panes(keyed: DataFrame, tick_minutes: int = D.TICK_MINUTES) -> DataFrame:
    """Tickets per key, system key and tick pane ``(tick - width, tick]``.

    Counts are combined map-side; from here on the data grows with keys and
    time, not with tickets. ``edge`` counts tickets created exactly on the tick:
    the closed window start of a later tick still includes them.
    """
    width = tick_minutes * 60_000_000
    micros = F.unix_micros("created_at")
    tick = F.ceil(micros / F.lit(width)).cast("long") * width
    on_edge = micros == tick
    rows = keyed.select(
        "key", "system_key", F.timestamp_micros(tick).alias("tick"),
        on_edge.alias("on_edge"), F.struct("created_at", "id").alias("t"),
    )
    return rows.groupBy("key", "system_key", "tick").agg(
        F.count("*").alias("n"), F.min("t").alias("first"),
        F.count_if("on_edge").alias("edge"), F.min(F.when(F.col("on_edge"), F.col("t"))).alias("edge_first"),
    )


def tick_parts(
    panes: DataFrame, window_minutes: int = D.WINDOW_MINUTES, tick_minutes: int = D.TICK_MINUTES
) -> DataFrame:
    """Each pane's share in every tick whose window ``[tick - window, tick]`` covers it."""
    steps = window_minutes // tick_minutes
    at = panes.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    last = F.col("_i") == steps
    moved = F.timestamp_micros(F.unix_micros("tick") + F.col("_i").cast("long") * (tick_minutes * 60_000_000))
    return at.select(
        "key", "system_key", moved.alias("tick"),
        F.when(last, F.col("edge")).otherwise(F.col("n")).alias("n"),
        F.when(last, F.col("edge_first")).otherwise(F.col("first")).alias("first"),
    ).filter("n > 0")


def candidates(
    keyed: DataFrame, baseline: DataFrame | None = None, window_minutes: int = D.WINDOW_MINUTES,
    tick_minutes: int = D.TICK_MINUTES, min_count: int = D.MIN_COUNT,
    k_sigma: float = D.BASELINE_SIGMA, tz: str = D.BASELINE_TZ,
) -> DataFrame:
    """Every (key, tick) with enough tickets in its window that passes the baseline."""
    parts = tick_parts(tick_panes(keyed, tick_minutes), window_minutes, tick_minutes)
    return gate(parts, baseline, min_count, k_sigma, tz)


def gate(
    parts: DataFrame, baseline: DataFrame | None = None, min_count: int = D.MIN_COUNT,
    k_sigma: float = D.BASELINE_SIGMA, tz: str = D.BASELINE_TZ,
) -> DataFrame:
    """Candidates from rows ``(key, system_key, tick, n, first)``.

    A cluster's threshold is the largest of its system keys' slots; the
    thresholds are rows that join on (system key, weekday, hour).
    """
    limit = F.lit(None).cast("double")
    if baseline is not None:
        dow, hour = slot(F.col("tick"), tz)
        rows = baseline.select(
            F.col("key").alias("system_key"), "dow", "hour",
            slot_threshold(F.col("median"), F.col("mad"), k_sigma).alias("limit"),
        )
        parts = parts.withColumns({"dow": dow, "hour": hour}).join(rows, ["system_key", "dow", "hour"], "left")
        limit = F.col("limit")
    return (
        parts.groupBy("key", "tick")
        .agg(F.sum("n").alias("count"), F.min("first").alias("first"), F.max(limit).alias("threshold"))
        .filter(F.col("count") >= min_count)
        .filter("threshold IS NULL OR count >= threshold")
        .select("key", "tick", "count", F.col("first.id").alias("first_ticket_id"), "threshold")
    )


def fire(ticks: Iterable, cooldown, last=None) -> Iterator[bool]:
    """The cooldown rule over ascending ticks of one key.

    A tick fires unless an alert before it is still cooling down; a suppressed
    tick does not start a cooldown. Batch and stream share this step.
    """
    for tick in ticks:
        fires = last is None or tick >= last + cooldown
        if fires:
            last = tick
        yield fires


def cooldown_filter(
    cands: DataFrame, cooldown_minutes: int = D.COOLDOWN_MINUTES, fired_before: DataFrame | None = None
) -> DataFrame:
    """Candidates that fire, greedily in time order per key.

    A gap of at least the cooldown between neighbours resets the rule, so each
    stretch between such gaps is a group of its own: groups stay small and a
    busy key is spread out. Only (key, tick) rows get here, at most one per
    tick, never tickets. ``fired_before`` are alerts (``key``, ``opened_at``)
    that may still be cooling down; they take part and are not returned.
    """
    cooldown = pd.Timedelta(minutes=cooldown_minutes)
    rows = cands.withColumn("_old", F.lit(False))
    if fired_before is not None:
        old = fired_before.join(cands.select("key").distinct(), "key", "left_semi")
        rows = rows.unionByName(
            old.select("key", F.col("opened_at").alias("tick"), F.lit(True).alias("_old")), allowMissingColumns=True
        )
    # at one tick an earlier alert goes first
    by_time = Window.partitionBy("key").orderBy("tick", F.col("_old").desc())
    gap = F.unix_micros("tick") - F.unix_micros(F.lag("tick").over(by_time))
    starts = F.when(gap.isNull() | (gap >= cooldown_minutes * 60_000_000), 1).otherwise(0)
    stretched = rows.withColumn("_s", starts).withColumn("_stretch", F.sum("_s").over(by_time)).drop("_s")

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tick", "_old"], ascending=[True, False])
        fired = pdf[list(fire(pdf["tick"], cooldown))]
        return fired[~fired["_old"].astype(bool)].drop(columns=["_stretch", "_old"])

    return stretched.groupBy("key", "_stretch").applyInPandas(step, cands.schema)


def to_alerts(fired: DataFrame, cooldown_minutes: int = D.COOLDOWN_MINUTES) -> DataFrame:
    """Alert rows; the id is a hash of key and opening time."""
    opened = F.col("tick")
    return fired.select(
        alert_id(F.col("key"), opened).alias("id"), "key", "first_ticket_id",
        opened.alias("opened_at"), "count", F.lit("open").alias("status"),
        (opened + F.make_dt_interval(mins=F.lit(cooldown_minutes))).alias("cooldown_until"),
    )


def suppress_in_cooldown(cands: DataFrame, alerts: DataFrame, now: Column) -> DataFrame:
    """Drop keys with an alert whose cooldown ends after ``now``."""
    cooling = alerts.filter(F.col("cooldown_until") > now).select("key").distinct()
    return cands.join(cooling, "key", "left_anti")


def replay(
    keyed: DataFrame, baseline: DataFrame | None = None, alerts: DataFrame | None = None,
    now: str | None = None, window_minutes: int = D.WINDOW_MINUTES, min_count: int = D.MIN_COUNT,
    k_sigma: float = D.BASELINE_SIGMA, tz: str = D.BASELINE_TZ,
) -> DataFrame:
    """One evaluation at ``now``, by default one minute after the newest ticket."""
    if now is not None:
        at = F.lit(now).cast("timestamp")
    else:
        newest = keyed.agg(F.max("created_at").alias("m")).scalar()
        at = newest + F.expr("interval 1 minute")
    counts = cluster_counts(keyed, at, window_minutes, min_count).withColumn("tick", at)
    if baseline is None:
        gated = counts.withColumn("threshold", F.lit(None).cast("double"))
    else:
        touched = (
            window_tickets(keyed, at, window_minutes).select("key", "system_key").distinct()
            .withColumn("tick", at)
        )
        limits = baseline_threshold(touched, baseline, ["key"], "tick", k_sigma, tz)
        gated = counts.join(limits, "key", "left").filter("threshold IS NULL OR count >= threshold")
    if alerts is not None:
        gated = suppress_in_cooldown(gated, alerts, at)
    return gated.select("key", "tick", "count", "first_ticket_id", "threshold")


def replay_ticks(
    keyed: DataFrame, baseline: DataFrame | None = None,
    cooldown_minutes: int = D.COOLDOWN_MINUTES, **settings,
) -> DataFrame:
    """Alerts of a whole history, evaluated at every tick."""
    return to_alerts(
        cooldown_filter(candidates(keyed, baseline, **settings), cooldown_minutes), cooldown_minutes
    )


def alert_lifecycle(alerts: DataFrame, now: Column) -> DataFrame:
    """Close open alerts whose cooldown ended before ``now``."""
    over = (F.col("status") == "open") & F.coalesce(F.col("cooldown_until") < now, F.lit(False))
    return alerts.withColumn("status", F.when(over, "closed").otherwise(F.col("status")))


def open_alerts(alerts: DataFrame) -> DataFrame:
    return alerts.filter("status = 'open'").orderBy(F.col("opened_at").desc(), "key")


def latest_alert(alerts: DataFrame) -> DataFrame:
    """The last opened alert per key."""
    rest = [c for c in alerts.columns if c not in ("key", "opened_at")]
    return (
        alerts.groupBy("key").agg(F.max(F.struct("opened_at", *rest)).alias("a"))
        .select("key", "a.*").select(*alerts.columns)
    )


def apply_verdicts(alerts: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Accept or reject with the close flag closes the alert; unsure does not.

    ``verdicts`` has ``alert_id, verdict, close``; any closing verdict counts,
    and the latest verdict by (at, seq) is shown.
    """
    closing = F.col("close") & F.col("verdict").isin("accept", "reject")
    per_alert = verdicts.groupBy("alert_id").agg(
        F.max(F.struct("at", "seq", "verdict")).alias("_l"), F.bool_or(closing).alias("_c")
    ).select(F.col("alert_id").alias("id"), F.col("_l.verdict").alias("verdict"), "_c")
    return (
        alerts.join(per_alert, "id", "left")
        .withColumn("status", F.when(F.col("_c"), "closed").otherwise(F.col("status")))
        .drop("_c")
    )
