"""Incremental build of the document table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ticketmill import defaults as D
from ticketmill import schemas
from ticketmill.functions.times import parse_ts
from ticketmill.operators import corpus, kb
from ticketmill.operators.vectors import embed_documents, hashing_vector
from ticketmill.sources import buckets as B
from ticketmill.sources import snapshots


def latest_tickets(tickets: DataFrame) -> DataFrame:
    """The most recently updated copy of each ticket."""
    rest = [c for c in tickets.columns if c not in ("id", "custom_fields")]
    # a map cannot be ordered, so it rides along with max_by
    newest = F.max_by(F.struct(*rest, "custom_fields"), F.coalesce(parse_ts(F.col("updated_at")), F.lit(0).cast("timestamp")))
    return tickets.groupBy("id").agg(newest.alias("t")).select("id", "t.*").select(*tickets.columns)


def ingest_conversations(spark: SparkSession, landed: str, store: str, buckets: int = B.BUCKETS) -> int | None:
    """Append conversation files that landed since the last call to the store, in buckets by ticket.

    Every file is parsed once, whenever it lands. A repeated batch finds its
    delta in the manifest and adds nothing.
    """
    query_id = uuid.uuid5(uuid.NAMESPACE_URL, store).hex

    def write(batch: DataFrame, epoch: int) -> None:
        B.append(batch, store, "ticket_id", buckets, part=f"{query_id}-{epoch}")

    (
        spark.readStream.schema(schemas.CONVERSATIONS).json(landed).writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{store}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    )
    B.compact(spark, store, schemas.CONVERSATIONS, "ticket_id", buckets)
    return snapshots.latest_version(spark, f"{store}/manifest")


def batch_conversations(tickets: DataFrame, store: str, buckets: int = B.BUCKETS) -> DataFrame:
    """The conversations of a batch of tickets: only the buckets of its ids are opened."""
    spark = tickets.sparkSession
    ids = tickets.select(F.col("id").alias("ticket_id")).where("ticket_id IS NOT NULL")
    found = B.read(spark, store, schemas.CONVERSATIONS, B.touched_buckets(ids, "ticket_id", buckets))
    return found.join(ids.distinct(), "ticket_id", "left_semi")


def read_documents(spark: SparkSession, documents_path: str, dimensions: int = 64) -> DataFrame:
    return B.read(spark, documents_path, schemas.kb_schema(dimensions))


def index_batch(
    tickets: DataFrame, convs: DataFrame, documents_path: str, dimensions: int,
    embed_fn: Callable = hashing_vector, links: DataFrame | None = None,
    min_symptom_chars: int = D.MIN_SYMPTOM_CHARS, buckets: int = B.BUCKETS,
) -> int:
    """Build, embed and upsert one batch of tickets; returns the new version.

    Documents whose vector has the wrong width are left out of the upsert. Only
    the buckets of the batch's documents are read and rewritten.
    """
    spark = tickets.sparkSession
    built = kb.build_documents(latest_tickets(tickets), convs, links, min_symptom_chars)
    embedded = embed_documents(built, embed_fn)
    accepted, _ = schemas.split_by_dimensions(embedded, dimensions)
    # the batch is read several times by the merge: keep it as a table
    staged = f"{documents_path}_staged"
    version = snapshots.write_version(accepted, staged)
    updates = spark.read.schema(accepted.schema).parquet(f"{staged}/v={version}")
    return B.upsert(spark, documents_path, schemas.kb_schema(dimensions), updates, "id", buckets)


def incremental_index(
    spark: SparkSession, tickets_path: str, conversations_path: str, documents_path: str,
    control_path: str, dimensions: int = 64, updated_since: str | None = None,
    no_watermark: bool = False, limit: int | None = None, order_by: str | None = None,
    order_type: str | None = None, embed_fn: Callable = hashing_vector, buckets: int = B.BUCKETS,
) -> int:
    """The scheduled batch run: watermark, build, upsert, then move the watermark.

    The control row is written only after the documents are, so a failed run
    repeats its window. Conversations are kept in ``<documents_path>_conversations``.
    """
    store = f"{documents_path}_conversations"
    ingest_conversations(spark, conversations_path, store, buckets)
    control = snapshots.read_control(spark, control_path)
    tickets = spark.read.schema(schemas.TICKETS).json(tickets_path).withColumn(
        "_updated", parse_ts(F.col("updated_at"))
    )
    tickets = snapshots.incremental_scan(tickets, control, updated_since, no_watermark, "_updated")
    if order_by:
        col = F.col(order_by)
        tickets = tickets.orderBy(col.desc() if order_type == "desc" else col.asc(), "id")
    if limit is not None:
        tickets = tickets.limit(limit)
    batch = tickets.drop("_updated")
    convs = batch_conversations(batch, store, buckets)
    version = index_batch(batch, convs, documents_path, dimensions, embed_fn, buckets=buckets)
    built = spark.read.schema(schemas.kb_schema(dimensions)).parquet(
        f"{documents_path}_staged/v={snapshots.latest_version(spark, documents_path + '_staged')}"
    )
    moved = snapshots.advance_watermark(control, built, limit, no_watermark, updated_since)
    snapshots.write_version(moved, control_path, "json")
    return version


def backfill(spark: SparkSession, *paths: str, limit: int | None = None, **settings) -> int:
    """The newest ``limit`` tickets, without reading or moving the watermark."""
    return incremental_index(
        spark, *paths, limit=limit, order_by="created_at", order_type="desc", no_watermark=True, **settings
    )


def incremental_index_stream(
    spark: SparkSession, tickets_path: str, conversations_path: str, documents_path: str,
    checkpoint: str, dimensions: int = 64, embed_fn: Callable = hashing_vector, buckets: int = B.BUCKETS,
) -> StreamingQuery:
    """The same as a stream: every landed file once, then stop (cron owns the cadence)."""
    store = f"{documents_path}_conversations"
    ingest_conversations(spark, conversations_path, store, buckets)

    def write(batch: DataFrame, batch_id: int) -> None:
        convs = batch_conversations(batch, store, buckets)
        index_batch(batch, convs, documents_path, dimensions, embed_fn, buckets=buckets)

    return (
        spark.readStream.schema(schemas.TICKETS).json(tickets_path)
        .writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def reconcile_documents(
    spark: SparkSession, tickets: DataFrame, documents_path: str, dimensions: int = 64, buckets: int = B.BUCKETS
) -> int:
    """Delete documents whose ticket is no longer live; returns the new version."""
    stale = corpus.reconcile(corpus.scan_ids(read_documents(spark, documents_path, dimensions)), tickets)
    return B.delete(spark, documents_path, schemas.kb_schema(dimensions), stale, "id", buckets)
