"""Alert digests and the delivery outbox."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketmill import defaults as D
from ticketmill.functions.text import strip_space
from ticketmill.functions.times import iso
from ticketmill.operators import ordered
from ticketmill.operators.clusters import cluster_label

# What every note says about itself.
NOTICE = (
    "Found by words that the ticket texts share; categories played no part. This is a guess at a common cause, not a "
    "confirmed incident. The tickets stay separate. Check the systems before you act."
)
# Tickets listed in one note; a larger cluster continues in further notes.
NOTE_TICKETS = 500


def escape_html(text: Column) -> Column:
    # fixed values: the five characters escaped, ampersand first
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def alert_tickets(
    alerts: DataFrame, keyed: DataFrame, window_minutes: int = D.WINDOW_MINUTES, note_tickets: int = NOTE_TICKETS
) -> DataFrame:
    """The tickets of each alert's window with their position and note part.

    Alerts and tickets meet on (key, hour); an alert's window touches few hours.
    """
    hour = 3_600
    since = F.col("opened_at") - F.make_dt_interval(mins=F.lit(window_minutes))
    a = alerts.select(F.col("id").alias("alert_id"), "key", "opened_at", since.alias("since")).withColumn(
        "_h", F.explode(F.sequence(
            F.floor(F.unix_seconds("since") / hour), F.floor(F.unix_seconds("opened_at") / hour)
        ))
    )
    t = keyed.withColumn("_h", F.floor(F.unix_seconds("created_at") / hour))
    met = a.join(t, ["key", "_h"]).filter("created_at BETWEEN since AND opened_at").drop("_h", "since")
    timed = met.withColumn("_at", F.unix_micros("created_at"))
    ranked = ordered.rank_in_key(timed, ["alert_id"], "_at", [F.col("id")]).drop("_at")
    return ranked.withColumn("part", F.floor((F.col("rank") - 1) / note_tickets).cast("int"))


def compose_digest(
    alerts: DataFrame, tickets: DataFrame, evidence: DataFrame | None = None,
    window_minutes: int = D.WINDOW_MINUTES, subject_chars: int | None = None,
) -> DataFrame:
    """HTML notes: ``(alert_id, part, note)``.

    ``tickets`` comes from :func:`alert_tickets`, ``evidence`` from
    :func:`~ticketmill.operators.evidence.alert_evidence`. The header, system keys and
    evidence are in part 0, every part lists its own tickets, and no ticket is
    left out however large the cluster. ``subject_chars`` shortens the subjects.
    """
    subject = F.replace(strip_space(F.coalesce("subject", F.lit(""))), F.lit("\n"), F.lit(" "))
    if subject_chars is not None:
        subject = F.substring(subject, 1, subject_chars)
    line = F.concat(
        F.lit("<li><b>#"), F.col("id").cast("string"), F.lit("</b> &mdash; "), iso(F.col("created_at")),
        F.lit(" &mdash; "), escape_html(subject), F.lit("</li>"),
    )
    lists = (
        tickets.select("alert_id", "part", F.struct("rank", line.alias("li")).alias("e"))
        .groupBy("alert_id", "part").agg(F.array_sort(F.collect_list("e")).alias("l"))
        .select("alert_id", "part", F.array_join(F.transform("l", lambda e: e["li"]), "").alias("ticket_items"))
    )
    systems = (
        tickets.select("alert_id", "system_key").distinct()
        .groupBy("alert_id").agg(F.array_join(F.array_sort(F.collect_list("system_key")), ", ").alias("systems"))
    )
    base = (
        lists.join(alerts.select(F.col("id").alias("alert_id"), "key", "opened_at", "count"), "alert_id")
        .join(systems, "alert_id")
    )
    proof = F.lit("")
    if evidence is not None:
        base = base.join(evidence.withColumnRenamed("cluster_id", "alert_id"), "alert_id", "left")
        proof = F.coalesce(
            evidence_html(F.col("evidence.confidence"), F.col("items"), F.col("evidence.pools")), F.lit("")
        )
    key = F.col("key")
    head = F.concat(
        F.lit("<p><b>[correlated-ticket monitor] Possible incident cluster: "),
        escape_html(cluster_label(key)), F.lit(" ("), escape_html(key), F.lit(")</b></p><p>"),
        F.col("count").cast("string"), F.lit(f" ticket(s) created within {window_minutes} min as of "),
        iso(F.col("opened_at")), F.lit(" (UTC).</p><p>Tickets (oldest first):</p>"),
    )
    tail = F.concat(
        F.lit("<p><b>System key(s):</b> "), escape_html(F.col("systems")), F.lit("</p>"),
        F.lit(f"<p><i>{NOTICE}</i></p>"),
        proof,
    )
    first = F.col("part") == 0
    note = F.concat(
        F.when(first, head).otherwise(""), F.lit("<ul>"), F.col("ticket_items"), F.lit("</ul>"),
        F.when(first, tail).otherwise(""),
    )
    return base.select("alert_id", "part", note.alias("note"))


def evidence_html(confidence: Column, items: Column, pools: Column) -> Column:
    """The evidence section: tier, one line per signal, pools."""
    def item(s: Column) -> Column:
        effect = s["role"] == "effect"
        return F.concat(
            F.lit("<li>["), escape_html(s["role"]), F.lit("] <b>"), escape_html(s["key"]), F.lit("</b> @ "),
            escape_html(s["stream"]), F.lit(": "), s["count"].cast("string"),
            F.when(s["count"] == 1, " event").otherwise(" events"),
            F.when(effect, F.concat(F.lit(" (prior window "), s["prior"].cast("string"), F.lit(")"))).otherwise(""),
            F.when(effect & s["elevated"], " *").otherwise(""), F.lit("</li>"),
        )

    seen = F.array_join(pools, ", ")
    return F.concat(
        F.lit("<p><b>Corroborators</b> &mdash; "), escape_html(confidence), F.lit(":</p><ul>"),
        F.array_join(F.transform(items, item), ""), F.lit("</ul>"),
        F.when(seen != "", F.concat(F.lit("<p><b>Pools seen:</b> "), escape_html(seen), F.lit("</p>"))).otherwise(""),
    )


def alert_outbox(alerts: DataFrame, digests: DataFrame) -> DataFrame:
    """Exactly one delivery row per alert: the opening note and the number of notes.

    The tickets are the rows of :func:`outbox_tickets`; whoever delivers sends
    the further notes, if there are any, in order of ``part``.
    """
    notes = digests.groupBy("alert_id").agg(
        F.count("*").cast("int").alias("parts"), F.max(F.when(F.col("part") == 0, F.col("note"))).alias("note")
    )
    named = alerts.select(
        F.col("id").alias("alert_id"), F.col("key").alias("cluster_key"),
        cluster_label(F.col("key")).alias("label"), "count", "first_ticket_id",
    )
    return named.join(notes, "alert_id")


def outbox_tickets(tickets: DataFrame) -> DataFrame:
    """``(alert_id, rank, ticket_id, part)``: the tickets behind each delivery row."""
    return tickets.select("alert_id", "rank", F.col("id").alias("ticket_id"), "part")
