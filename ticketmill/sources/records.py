"""JSON record files: documents, gold sets, feedback log, boost table, baseline, alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketmill import schemas
from ticketmill.sources import commits, snapshots


def write_records_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object per document, empty fields included."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


# --- gold set ---------------------------------------------------------------
def write_gold(gold: DataFrame, path: str) -> None:
    gold.write.mode("overwrite").json(path)


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    gold = spark.read.schema(schemas.GOLD).json(path)
    no_ids, no_store = F.array().cast("array<bigint>"), F.array().cast("array<string>")
    return gold.withColumns(
        {
            "query_text": F.coalesce("query_text", F.lit("")),
            "store": F.coalesce("store", no_store),
            "labeled": F.coalesce("labeled", F.lit(False)),
            # large fix groups are named by fix_key instead of listing their ids
            "expected_ticket_ids": F.when(F.col("fix_key").isNull(), F.coalesce("expected_ticket_ids", no_ids))
            .otherwise(F.col("expected_ticket_ids")),
        }
    )


# --- feedback log -----------------------------------------------------------
def feedback_rows(df: DataFrame) -> DataFrame:
    """Complete feedback rows: missing columns added, time and sequence filled."""
    have = set(df.columns)
    typed = [f.strip().rsplit(" ", 1) for f in schemas.FEEDBACK.replace("\n", " ").split(",")]
    cols = [
        (F.col(n) if n in have else F.lit(None)).cast(t.lower()).alias(n) for n, t in typed
    ]
    out = df.select(*cols)
    return out.withColumns(
        {
            "accepted": F.coalesce("accepted", F.lit(False)),
            "kind": F.coalesce("kind", F.lit("retrieval")),
            "at": F.coalesce("at", F.current_timestamp()),
            # order within one append; across appends the time decides first
            "seq": F.coalesce("seq", F.monotonically_increasing_id()),
        }
    )


def append_feedback(df: DataFrame, path: str) -> None:
    feedback_rows(df).write.mode("append").json(path)


def cluster_verdicts(df: DataFrame) -> DataFrame:
    """Verdicts on alerts as feedback rows of kind ``cluster``."""
    return feedback_rows(df.withColumn("kind", F.lit("cluster")))


def read_feedback(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    return reader.schema(schemas.FEEDBACK).json(path).withColumns(
        {
            "accepted": F.coalesce("accepted", F.lit(False)),
            "kind": F.coalesce("kind", F.lit("retrieval")),
        }
    )


# --- whole-table swaps ------------------------------------------------------
def write_boost_table(boosts: DataFrame, path: str) -> int:
    return snapshots.write_version(boosts.select("ticket_id", "boost"), path, "json")


def read_boost_table(spark: SparkSession, path: str) -> DataFrame:
    return snapshots.read_latest(spark, path, "ticket_id BIGINT, boost DOUBLE", "json")


def replace_baseline(rows: DataFrame, path: str, updated_at: str) -> int:
    stamped = rows.withColumn("updated_at", F.lit(updated_at).cast("timestamp"))
    return snapshots.write_version(stamped, path)


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    return snapshots.read_latest(spark, path, schemas.BASELINE)


# --- alerts -----------------------------------------------------------------
def alert_id(key, opened_at):
    """Stable id: a retried batch writes the same alert again under the same id."""
    return F.xxhash64(key, opened_at)


def append_alerts(alerts: DataFrame, root: str, query: str, epoch: int, **more: DataFrame) -> str:
    """One row per fired alert, committed with the epoch's other tables; see :mod:`~ticketmill.sources.commits`."""
    return commits.write_epoch({"alerts": alerts, **more}, root, query, epoch)


def read_alerts(spark: SparkSession, root: str) -> DataFrame:
    return commits.read_table(spark, root, "alerts", schemas.ALERTS)


def read_outbox(spark: SparkSession, root: str, table: str = "outbox") -> DataFrame:
    """Committed rows of ``outbox``, ``outbox_tickets`` or ``notes``."""
    return commits.read_table(spark, root, table, schemas.OUTBOX[table])
