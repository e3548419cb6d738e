"""What agents did with suggestions: latest judgement, rates, boosts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_feedback(events: DataFrame) -> DataFrame:
    """Last retrieval event per (ticket, suggestion) in log order.

    An aggregate rather than a window: it combines map-side, so a pair that is
    judged over and over costs one row per task.
    """
    others = [c for c in events.columns if c not in ("ticket_id", "suggested_ticket_id")]
    return (
        events.filter("kind = 'retrieval'")
        .groupBy("ticket_id", "suggested_ticket_id")
        .agg(F.max(F.struct("at", "seq", *[c for c in others if c not in ("at", "seq")])).alias("_last"))
        .select("ticket_id", "suggested_ticket_id", "_last.*")
    )


def suggestion_stats(events: DataFrame) -> DataFrame:
    """Shown, accepted and resolved counts and rates per suggested ticket."""
    accepted = F.col("accepted")
    counts = (
        latest_feedback(events).groupBy("suggested_ticket_id").agg(
            F.count("*").alias("shown"),
            F.count_if(accepted).alias("accepted"),
            F.count_if(accepted & F.coalesce("resolved", F.lit(False))).alias("resolved_after_accept"),
        )
    )

    def rate(part: str, whole: str):
        return F.when(F.col(whole) > 0, F.round(F.col(part) / F.col(whole), 4)).otherwise(F.lit(0.0))

    return counts.withColumns(
        {"accept_rate": rate("accepted", "shown"), "success_rate": rate("resolved_after_accept", "accepted")}
    )


def boost_table(stats: DataFrame) -> DataFrame:
    """Multiplier per accepted suggestion, between 1.0 and 1.5."""
    volume = F.least(F.col("accepted") / 10, F.lit(0.1))
    return stats.filter("accepted > 0").select(
        F.col("suggested_ticket_id").alias("ticket_id"),
        F.round(1 + 0.4 * F.col("success_rate") + volume, 4).alias("boost"),
    )


def accept_rate_listing(stats: DataFrame, n: int = 10) -> DataFrame:
    """Accept rates of the first ``n`` suggestions in id order."""
    return stats.orderBy("suggested_ticket_id").limit(n).select("suggested_ticket_id", "accept_rate")
