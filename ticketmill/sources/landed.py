"""Reads of landed files: tickets, conversations, changes, logs, signal catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketmill import schemas
from ticketmill.functions.times import parse_ts


def _read(spark: SparkSession, path: str, schema: str, fmt: str) -> DataFrame:
    return spark.read.schema(schema).format(fmt).load(path)


def _order_and_limit(
    df: DataFrame, order_by: str | None, order_type: str | None, limit: int | None
) -> DataFrame:
    if order_by:
        col = F.col(order_by)
        df = df.orderBy(col.desc() if order_type == "desc" else col.asc(), "id")
    return df if limit is None else df.limit(limit)


def filter_tickets(
    tickets: DataFrame,
    updated_since: str | None = None,
    created_since: str | None = None,
    order_by: str | None = None,
    order_type: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Inclusive time filters; a creation time that cannot be read keeps its row.

    ``limit`` counts rows after the filters. There is no cap on a pull.
    """
    if updated_since:
        tickets = tickets.filter(parse_ts(F.col("updated_at")) >= F.lit(updated_since).cast("timestamp"))
    if created_since:
        created = parse_ts(F.col("created_at"))
        tickets = tickets.filter(created.isNull() | (created >= F.lit(created_since).cast("timestamp")))
    return _order_and_limit(tickets, order_by, order_type, limit)


def read_tickets(
    spark: SparkSession, path: str, fmt: str = "json", **filters
) -> DataFrame:
    """Ticket scan; the keyword filters are those of :func:`filter_tickets`."""
    return filter_tickets(_read(spark, path, schemas.TICKETS, fmt), **filters)


def explode_conversations(tickets: DataFrame) -> DataFrame:
    """Inline conversations as rows; ``seq`` keeps the list order."""
    return tickets.select(
        F.col("id").alias("ticket_id"), F.posexplode("conversations").alias("seq", "c")
    ).select("ticket_id", "seq", "c.*")


def read_conversations(
    spark: SparkSession, path: str, fmt: str = "json", inline: bool = False
) -> DataFrame:
    if inline:
        return explode_conversations(_read(spark, path, schemas.INLINE_CONVERSATIONS, fmt))
    return _read(spark, path, schemas.CONVERSATIONS, fmt)


def filter_changes(
    changes: DataFrame, updated_since: str | None = None, limit: int | None = None
) -> DataFrame:
    if updated_since:
        changes = changes.filter(parse_ts(F.col("updated_at")) >= F.lit(updated_since).cast("timestamp"))
    return changes if limit is None else changes.limit(limit)


def read_changes(
    spark: SparkSession, path: str, updated_since: str | None = None,
    limit: int | None = None, fmt: str = "json",
) -> DataFrame:
    return filter_changes(_read(spark, path, schemas.CHANGES, fmt), updated_since, limit)


def filter_log_events(logs: DataFrame, stream: str, start: str, end: str) -> DataFrame:
    """One stream between two times, both included.

    Files laid out by ``stream`` and ``date`` are pruned before any is opened.
    """
    lo, hi = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    logs = logs.filter(F.col("stream") == stream)
    if "date" in logs.columns:
        logs = logs.filter(F.col("date").between(lo.cast("date"), hi.cast("date")))
    return logs.filter(F.col("timestamp").between(lo, hi))


def read_log_events(
    spark: SparkSession, path: str, stream: str, start: str, end: str, fmt: str = "parquet"
) -> DataFrame:
    return filter_log_events(_read(spark, path, schemas.LOG_EVENTS, fmt), stream, start, end)


def flatten_log_properties(df: DataFrame) -> DataFrame:
    """Built-ins and named properties in one map column ``fields``; the last name wins.

    The names are made unique here, so no session setting decides the outcome.
    """
    built_in = F.array(
        *[
            F.struct(F.lit(name).alias("name"), F.col(col).cast("string").alias("value"))
            for name, col in (
                ("timestamp", "Timestamp"), ("level", "Level"), ("message", "RenderedMessage"),
                ("id", "Id"), ("event_type", "EventType"),
            )
        ]
    )
    named = F.filter(
        F.coalesce(F.col("Properties"), F.array().cast("array<struct<Name:string,Value:string>>")),
        lambda p: F.coalesce(p["Name"] != "", F.lit(False)),
    )
    named = F.transform(named, lambda p: F.struct(p["Name"].alias("name"), p["Value"].alias("value")))
    entries = F.reverse(F.concat(built_in, named))
    names = F.transform(entries, lambda e: e["name"])
    tagged = F.transform(entries, lambda e, i: F.struct(e["name"], e["value"], i.alias("i")))
    last = F.filter(tagged, lambda e: F.array_position(names, e["name"]) == e["i"] + 1)
    return df.withColumn(
        "fields", F.map_from_entries(F.transform(last, lambda e: F.struct(e["name"], e["value"])))
    )


def read_signal_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Signal definitions: one row per (signal, field predicate).

    The catalog is one small configuration document, so the multi-line read of
    a single file is the right one.
    """
    raw = spark.read.schema(schemas.CATALOG).json(path, multiLine=True)
    excluded = F.transform("excluded_high_volume", lambda e: e["event"])
    signals = raw.select(
        F.posexplode("signals").alias("ord", "s"), F.coalesce(excluded, F.array()).alias("excluded")
    )
    return (
        signals.select(
            "ord", "s.key", "s.role", "s.stream", "s.event_field", "s.display_fields", "s.note",
            "excluded", F.explode("s.any").alias("predicate"),
        )
        .select(
            "ord", "key", "role", "stream", "event_field", "display_fields", "note",
            F.substring_index("predicate", ":", 1).alias("field"),
            F.expr("substr(predicate, instr(predicate, ':') + 1)").alias("value"),
            "excluded",
        )
        .filter(~F.array_contains("excluded", F.col("value")))
        .drop("excluded")
    )
