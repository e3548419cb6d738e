"""The live monitor as Structured Streaming."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ticketmill import defaults as D
from ticketmill import schemas
from ticketmill.operators import digest, evidence as ev
from ticketmill.operators.baseline import compute_baseline
from ticketmill.operators.clusters import keyed_tickets, parse_live_tickets
from ticketmill.operators.monitor import cooldown_filter, gate, to_alerts
from ticketmill.sources import commits, records

LOG = logging.getLogger(__name__)


def ticket_stream(
    spark: SparkSession, path: str, since: str | None = None, max_files: int = D.MAX_PER_POLL,
    schema: str = schemas.LIVE_TICKETS, rules=D.CLUSTER_RULES,
) -> DataFrame:
    """Newly landed tickets, a bounded number of files per trigger.

    The checkpoint remembers what was read; ``since`` bounds the first run, e.g.
    to the last three hours.
    """
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).json(path)
    live = parse_live_tickets(raw, rules)
    return live if since is None else live.filter(F.col("created_at") >= F.lit(since).cast("timestamp"))


def late_data_policy(df: DataFrame, delay: str = f"{D.WINDOW_MINUTES} minutes") -> DataFrame:
    """Tickets older than the watermark are left out; state before it is dropped."""
    return df.withWatermark("created_at", delay)


def with_closing(tickets: DataFrame, path: str, at: str) -> DataFrame:
    """``tickets`` of a bounded replay, and a row without keys at time ``at`` that ends it.

    Windows are emitted once the watermark has passed them, so the last hour of
    a stream that stops would stay open. ``at`` must lie after the last ticket by
    more than the delay and a window. The row belongs to no cluster. ``path`` is
    a new folder that all executors reach.
    """
    empty = {"id": F.lit(-1), "created_at": F.lit(at), "cluster_keys": F.array()}
    row = tickets.sparkSession.range(1).select(
        *[empty.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in tickets.schema]
    )
    row.coalesce(1).write.parquet(path)
    return tickets.unionByName(tickets.sparkSession.readStream.schema(tickets.schema).parquet(path))


def dedupe_stream(df: DataFrame) -> DataFrame:
    """One row per ticket id within the watermark; the first copy wins."""
    return df.dropDuplicatesWithinWatermark(["id"])


def pane_stream(keyed: DataFrame, tick_minutes: int = D.TICK_MINUTES) -> DataFrame:
    """Tickets per (key, system key) and pane ``(tick - width, tick]``, once the pane has passed.

    Panes do not overlap, so a ticket is one row; counts are combined before the
    shuffle, so a hot key arrives as few rows.
    """
    pane = F.window("created_at", f"{tick_minutes} minutes", f"{tick_minutes} minutes", "1 microsecond")
    on_edge = F.unix_micros("created_at") % (tick_minutes * 60_000_000) == 0
    one = F.struct(F.unix_micros("created_at").alias("at"), F.col("id"))
    counted = keyed.withColumns({"_one": one, "_edge": on_edge}).groupBy(pane.alias("w"), "key", "system_key").agg(
        F.count("*").alias("n"), F.min("_one").alias("first"),
        F.count_if("_edge").alias("edge"), F.min(F.when(F.col("_edge"), F.col("_one"))).alias("edge_first"),
    )
    return counted.select(
        "key", "system_key", F.window_time("w").alias("tick"), "n", F.col("first.at").alias("first_at"),
        F.col("first.id").alias("first_id"), "edge", F.col("edge_first.at").alias("edge_at"),
        F.col("edge_first.id").alias("edge_id"),
    )


PARTS = "key string, system_key string, tick timestamp, n bigint, first_at timestamp, first_id bigint"


class PaneRing(StatefulProcessor):
    """Per (key, system key) the panes of one window; a timer emits the window's total at every tick.

    ``panes`` holds at most window / tick + 1 entries: the whole panes of the
    window and the one whose last instant is the window's first. ``next`` is the
    tick the timer waits for.
    """

    def __init__(self, window_minutes: int, tick_minutes: int):
        self.span, self.step = window_minutes * 60_000_000, tick_minutes * 60_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        pane = "n bigint, first_at bigint, first_id bigint, edge bigint, edge_at bigint, edge_id bigint"
        self.panes = handle.getMapState("panes", "tick bigint", pane)
        self.next = handle.getValueState("next", "tick bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            ticks = pdf["tick"].astype("datetime64[us]").astype("int64")
            values = pdf[["n", "first_at", "first_id", "edge", "edge_at", "edge_id"]].astype("Int64")
            for tick, value in zip(ticks, values.itertuples(index=False)):
                self.panes.updateValue((int(tick),), tuple(None if pd.isna(v) else int(v) for v in value))
                first = tick if first is None else min(first, tick)
        if first is not None and not self.next.exists():
            self._wait(int(first))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        panes = {k[0]: v for k, v in self.panes.iterator()}
        tick = self.next.get()[0]
        out = []
        while panes and tick < timerValues.getCurrentWatermarkInMs() * 1000:
            inside = [(n, at, i) for t, (n, at, i, *_) in panes.items() if tick - self.span < t <= tick]
            inside += [v[3:] for t, v in panes.items() if t == tick - self.span and v[3]]
            if inside:
                at, first = min(x[1:] for x in inside)
                out.append((*key, tick, sum(x[0] for x in inside), at, first))
            for t in [t for t in panes if t <= tick - self.span]:
                del panes[t]
                self.panes.removeKey((t,))
            tick += self.step
        if panes:
            self._wait(tick)
        else:
            self.next.clear()
        made = pd.DataFrame(out, columns=["key", "system_key", "tick", "n", "first_at", "first_id"])
        for column in ("tick", "first_at"):
            made[column] = pd.to_datetime(made[column], unit="us")
        yield made

    def _wait(self, tick: int) -> None:
        """Timers have milliseconds: the first one after the tick."""
        self.next.update((tick,))
        self.handle.registerTimer(tick // 1000 + 1)

    def close(self) -> None:
        pass


# state store the stateful operator needs
STATE_STORE = (
    "spark.sql.streaming.stateStore.providerClass",
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
)


def sliding_clusters(
    keyed: DataFrame, window_minutes: int = D.WINDOW_MINUTES, tick_minutes: int = D.TICK_MINUTES
) -> DataFrame:
    """Tickets per (key, system key) in the closed window ``[tick - window, tick]`` of every tick.

    Each ticket is counted in one pane; a window is the sum of the panes kept as
    state (:class:`PaneRing`). All rows of a tick come in the micro-batch in
    which the watermark passes it, so a tick can be judged within its batch.
    """
    keyed.sparkSession.conf.set(*STATE_STORE)
    return pane_stream(keyed, tick_minutes).groupBy("key", "system_key").transformWithStateInPandas(
        PaneRing(window_minutes, tick_minutes), outputStructType=PARTS, outputMode="append", timeMode="EventTime",
    )


def live_windows(tickets: DataFrame, delay: str | None = None) -> DataFrame:
    """Tickets to window counts: late tickets and repeated ids go, then :func:`sliding_clusters`."""
    live = late_data_policy(tickets, delay or f"{D.WINDOW_MINUTES} minutes")
    return sliding_clusters(keyed_tickets(dedupe_stream(live)))


Baseline = DataFrame | str | None


def newest_baseline(spark: SparkSession, baseline: Baseline) -> DataFrame | None:
    """A table as it is; of a folder of versions the newest complete one at this moment."""
    return records.read_baseline(spark, baseline) if isinstance(baseline, str) else baseline


def alert_batch(
    windows: DataFrame, baseline: DataFrame | None, fired_before: DataFrame, cooldown_minutes: int = D.COOLDOWN_MINUTES,
) -> DataFrame:
    """Alerts of one micro-batch of windows.

    Thresholds are rows that join on (system key, weekday, hour). The alerts
    fired before are the cooldown's state; only those that can still be cooling
    down are read.
    """
    cands = gate(windows.withColumn("first", F.struct(F.col("first_at").alias("created_at"), F.col("first_id").alias("id"))), baseline)
    since = windows.agg(F.min("tick")).scalar() - F.expr(f"interval {cooldown_minutes} minutes")
    recent = fired_before.filter(F.col("opened_at") > since)
    return to_alerts(cooldown_filter(cands, cooldown_minutes, recent), cooldown_minutes)


def live_proof(events: DataFrame | None = None, catalog: DataFrame | None = None, **sources) -> Callable:
    """Evidence for :func:`start_monitor`: all signals of a batch's windows, and the pools seen in them."""
    return lambda clusters: ev.corroborate(clusters, events, catalog, **sources)


def start_monitor(
    windows: DataFrame, out: str, checkpoint: str, tickets: DataFrame | None = None, baseline: Baseline = None,
    proof: Callable[[DataFrame], DataFrame] | None = None, report: Callable[[DataFrame], None] | None = None,
    trigger: dict | None = None, cooldown_minutes: int = D.COOLDOWN_MINUTES,
) -> StreamingQuery:
    """Judge windows and write alerts and their outbox per micro-batch.

    ``windows`` comes from :func:`live_windows`. ``baseline`` is a table, or the
    folder of its versions, of which every micro-batch reads the newest.
    ``tickets`` is the batch view of the landed tickets with cluster keys, for
    the digests; without it there is no outbox. ``proof`` maps cluster windows
    to ``(cluster_id, evidence, items)``, see :func:`live_proof`. ``report`` is
    called with the outbox rows, or else with the alerts; its failure is logged
    and never loses the alert.

    The tables of an epoch are committed together under the query's id, so a
    repeated epoch changes nothing and a fresh checkpoint overwrites nothing.
    Alerts of earlier queries in ``out`` count for the cooldown.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        query = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        attempt = commits.committed(spark, out, query, epoch)
        if attempt is None:
            windows = batch.persist()
            try:
                if windows.isEmpty():
                    return
                fired = alert_batch(
                    windows, newest_baseline(spark, baseline), records.read_alerts(spark, out), cooldown_minutes
                ).persist()
                attempt = _append(fired, out, query, epoch, tickets, proof)
                fired.unpersist()
            finally:
                windows.unpersist()
        if report is not None and attempt is not None:
            table = "alerts" if tickets is None else "outbox"
            try:
                report(spark.read.parquet(commits.folder(out, table, query, epoch, attempt)))
            except Exception:  # a report must not break the stream
                LOG.exception("report failed for epoch %s", epoch)

    writer = windows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": f"{D.TICK_MINUTES} minutes"})).start()


def _append(
    fired: DataFrame, out: str, query: str, epoch: int, tickets: DataFrame | None, proof: Callable | None
) -> str | None:
    """Commit the alerts of an epoch with evidence, notes and outbox; nothing when none fired."""
    if fired.isEmpty():
        return None
    found, full = None, fired.withColumn("evidence", F.lit(None).cast(schemas.EVIDENCE))
    if proof is not None:
        found = proof(fired.select(
            F.col("id").alias("cluster_id"), "key",
            (F.col("opened_at") - F.expr(f"interval {D.WINDOW_MINUTES} minutes")).alias("window_start"),
            F.col("opened_at").alias("window_end"),
        ))
        full = fired.join(found.select(F.col("cluster_id").alias("id"), "evidence"), "id", "left")
    more = {}
    if tickets is not None:
        listed = digest.alert_tickets(fired, keyed_tickets(tickets))
        notes = digest.compose_digest(fired, listed, found)
        more = {"outbox_tickets": digest.outbox_tickets(listed), "notes": notes, "outbox": digest.alert_outbox(fired, notes)}
    return records.append_alerts(full, out, query, epoch, **more)


def refresh_baseline(
    tickets: DataFrame, path: str, now: str, interval_hours: int = 24,
    weeks: int = D.BASELINE_WEEKS, tz: str = D.BASELINE_TZ,
) -> bool:
    """Recompute the baseline when it is missing or older than the interval.

    A failure leaves the last version in force and is reported, not raised.
    """
    spark = tickets.sparkSession
    at = F.lit(now).cast("timestamp")
    last = records.read_baseline(spark, path).agg(F.max("updated_at").alias("t"))
    due = last.select(
        F.col("t").isNull() | (at - F.expr(f"interval {interval_hours} hours") >= F.col("t"))
    ).first()[0]
    if not due:
        return False
    try:
        recent = tickets.filter(F.col("created_at") >= at - F.expr(f"interval {weeks * 7} days"))
        records.replace_baseline(compute_baseline(recent, at, weeks, tz), path, now)
    except Exception as error:
        print(f"baseline refresh failed: {error}")
        return False
    return True


class PollMetrics(StreamingQueryListener):
    """Last progress per query: time, rows fetched, keys in state."""

    def __init__(self) -> None:
        self.last: dict[str, dict] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.last[str(p.id)] = {
            "last_poll_at": p.timestamp,
            "fetched": p.numInputRows,
            "keys": sum(op.numRowsTotal for op in p.stateOperators),
            "watermark": p.eventTime.get("watermark"),
        }

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def poll_metrics(query: StreamingQuery) -> dict:
    """The same numbers from the query's own last progress."""
    p = query.lastProgress
    if p is None:
        return {"last_poll_at": None, "fetched": 0, "keys": 0, "watermark": None}
    return {
        "last_poll_at": p["timestamp"],
        "fetched": p["numInputRows"],
        "keys": sum(op["numRowsTotal"] for op in p["stateOperators"]),
        "watermark": p.get("eventTime", {}).get("watermark"),
    }


