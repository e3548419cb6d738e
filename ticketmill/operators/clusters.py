"""Cluster keys from ticket text, and counts of tickets per key and window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketmill import defaults as D
from ticketmill.functions.rules import system_key
from ticketmill.functions.text import blank_to_null
from ticketmill.functions.times import parse_ts
from ticketmill.operators import ordered


def cluster_rules(spark: SparkSession, rows: Sequence[D.Rule] = D.CLUSTER_RULES) -> DataFrame:
    """The rule table, one row per phrase."""
    flat = [
        (r.key, r.label, r.weight, i, p) for i, r in enumerate(rows) for p in r.phrases
    ]
    return spark.createDataFrame(flat, "key string, label string, weight int, ord int, phrase string")


def match_keys(text: Column, rules: Sequence[D.Rule] = D.CLUSTER_RULES) -> Column:
    """Keys of the rules that match, heaviest first, ties in table order.

    A rule matches when any phrase is in the normalized text (lower case, only
    ``a-z0-9``, single spaces): one-word phrases as whole words, longer ones as
    they stand. The rules are a short list, so they compile into one expression:
    no join, no shuffle, inside generated code. The text is not rewritten; a
    plain substring test decides for most texts and the pattern that allows any
    other characters between words only runs behind it.
    """
    low = F.lower(F.coalesce(text, F.lit("")))

    def hit(rule: D.Rule) -> Column:
        found = F.lit(False)
        for phrase in rule.phrases:
            words = _phrase_words(phrase)
            if not words:
                continue
            pattern = "[^a-z0-9]+".join(words)
            if len(words) == 1:
                pattern = f"(?<![a-z0-9]){pattern}(?![a-z0-9])"
            found |= F.contains(low, F.lit(max(words, key=len))) & low.rlike(pattern)
        return F.when(found, F.lit(rule.key))

    by_weight = sorted(rules, key=lambda r: -r.weight)
    return F.array_compact(F.array(*[hit(r) for r in by_weight]))


def _phrase_words(phrase: str) -> list[str]:
    return "".join(
        c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in phrase.lower()
    ).split()


def match_cluster_keys(df: DataFrame, text: Column, rules: Sequence[D.Rule] = D.CLUSTER_RULES) -> DataFrame:
    return df.withColumn("cluster_keys", match_keys(text, rules))


def primary_cluster_key(keys: Column) -> Column:
    return F.try_element_at(keys, F.lit(1))


def cluster_label(key: Column, rules: Sequence[D.Rule] = D.CLUSTER_RULES) -> Column:
    """The rule's label, or the key itself."""
    label = key
    for rule in rules:
        label = F.when(key == rule.key, F.lit(rule.label)).otherwise(label)
    return label


def parse_live_tickets(df: DataFrame, rules: Sequence[D.Rule] = D.CLUSTER_RULES) -> DataFrame:
    """Usable live tickets with their match text, system key and cluster keys."""
    created = F.col("created_at")
    if df.schema["created_at"].dataType.typeName() == "string":
        created = parse_ts(created)
    described = F.coalesce(blank_to_null(F.col("description_text")), F.col("description"), F.lit(""))
    subject = F.coalesce("subject", F.lit(""))
    usable = df.select(
        F.col("id").cast("long").alias("id"),
        created.alias("created_at"),
        subject.alias("subject"),
        described.alias("description_text"),
        F.concat_ws("\n", subject, described).alias("match_text"),
        "category", "sub_category", "status",
        system_key(F.col("category"), F.col("sub_category")).alias("system_key"),
    ).filter("id IS NOT NULL AND created_at IS NOT NULL")
    return match_cluster_keys(usable, F.col("match_text"), rules)


def latest_copy(tickets: DataFrame, version: str | None = None) -> DataFrame:
    """One row per ticket id; the copy with the largest ``version`` wins."""
    if version is None:
        return tickets.dropDuplicates(["id"])
    rest = [c for c in tickets.columns if c not in ("id", version)]
    return (
        tickets.groupBy("id").agg(F.max(F.struct(version, *rest)).alias("_t"))
        .select("id", "_t.*").select(*tickets.columns)
    )


def keyed_tickets(tickets: DataFrame) -> DataFrame:
    """One row per (ticket, cluster key)."""
    return tickets.withColumn("key", F.explode("cluster_keys")).drop("cluster_keys")


def window_tickets(keyed: DataFrame, now: Column, window_minutes: int = D.WINDOW_MINUTES) -> DataFrame:
    """Tickets created at or after ``now - window`` (a closed edge)."""
    since = now - F.make_dt_interval(mins=F.lit(window_minutes))
    return keyed.filter(F.col("created_at") >= since)


def cluster_counts(
    keyed: DataFrame, now: Column, window_minutes: int = D.WINDOW_MINUTES, min_count: int = D.MIN_COUNT
) -> DataFrame:
    """Keys with enough distinct tickets in the window, with the earliest ticket.

    The distinct count is taken over (key, id) first, so a hot key is counted in
    parallel. The tickets themselves are the rows of :func:`window_tickets`.
    """
    distinct = (
        window_tickets(keyed, now, window_minutes)
        .groupBy("key", "id").agg(F.min("created_at").alias("created_at"))
    )
    return (
        distinct.groupBy("key").agg(
            F.count("*").alias("count"),
            F.min(F.struct("created_at", "id")).alias("first"),
        )
        .filter(F.col("count") >= min_count)
        .select(
            "key", "count", F.col("first.id").alias("first_ticket_id"),
            F.col("first.created_at").alias("first_created_at"),
        )
    )


def first_ticket(keyed: DataFrame) -> DataFrame:
    """Earliest ticket per key by (created_at, id)."""
    return keyed.groupBy("key").agg(F.min(F.struct("created_at", "id")).alias("f")).select(
        "key", F.col("f.id").alias("first_ticket_id"), F.col("f.created_at").alias("first_created_at")
    )


def trailing_count(keyed: DataFrame, minutes: int = D.WINDOW_MINUTES) -> DataFrame:
    """Tickets of the same key in the closed trailing window, at each ticket.

    A sweep: each ticket adds one when created and takes it off just after the
    window. The running total is summed in time buckets, so a key holding most
    tickets is spread over many tasks.
    """
    at = F.unix_micros("created_at")
    marks = F.array(
        F.struct(at.alias("_at"), F.lit(0).alias("_gone"), F.lit(1).alias("_step")),
        F.struct((at + minutes * ordered.MINUTE).alias("_at"), F.lit(1).alias("_gone"), F.lit(-1).alias("_step")),
    )
    points = keyed.select(*keyed.columns, F.inline(marks))
    summed = ordered.running_sum(points, ["key"], "_at", [F.col("_gone")], F.col("_step"), "trailing")
    return summed.filter("_gone = 0").drop("_at", "_gone", "_step")


def ticket_ranks(keyed: DataFrame) -> DataFrame:
    """Position of each ticket in its key by (created_at, id)."""
    timed = keyed.withColumn("_at", F.unix_micros("created_at"))
    return ordered.rank_in_key(timed, ["key"], "_at", [F.col("id")]).drop("_at")
