"""The indexed corpus: upsert, delete, scan, count, facets, reconcile, backfill."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketmill.functions.rules import is_terminal_status


def upsert_documents(target: DataFrame, updates: DataFrame, key: str = "id") -> DataFrame:
    """Merge-or-upload by key; ``updates`` holds each key once.

    A column that ``updates`` lacks keeps the target's value, one it has
    overwrites even with null, and an empty vector never replaces a vector.

    The target is only ever the streamed side of a join to the updates: with a
    small batch Spark broadcasts the batch and the corpus is not shuffled; a
    large batch falls back to a sort-merge join by itself.
    """
    fresh = updates.select(
        F.col(key).alias("_key"), F.struct(*[F.col(c) for c in updates.columns]).alias("_u")
    )

    def merged(name: str):
        if name not in updates.columns or name == key:
            return F.col(name)
        new, old = F.col("_u")[name], F.col(name)
        if name.endswith("_vector"):
            return F.when(F.size(new) > 0, new).otherwise(old).alias(name)
        return F.when(F.col("_u").isNotNull(), new).otherwise(old).alias(name)

    kept = target.join(fresh, target[key] == F.col("_key"), "left").select(
        *[merged(c) for c in target.columns]
    )
    # keys already indexed, found by probing the corpus's key column only
    known = target.select(key).join(updates.select(key), key, "left_semi")
    new = updates.join(known, key, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True).select(*target.columns)


def delete_documents(target: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return target.join(ids.select(key), key, "left_anti")


def scan_ids(df: DataFrame, key: str = "id") -> DataFrame:
    return df.select(key)


# fixed values: the columns a gold-set build reads
GOLD_SCAN = (
    "ticket_id", "symptom_text", "resolution_text", "category", "sub_category", "store", "age_days",
)


def scan_documents(df: DataFrame, select: tuple[str, ...] = GOLD_SCAN, max_docs: int | None = None) -> DataFrame:
    df = df.select(*select)
    return df if max_docs is None else df.limit(max_docs)


def document_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("documents"))


def facet_counts(docs: DataFrame, field: str) -> DataFrame:
    """Documents per value of a facetable field; list values count once each."""
    value = F.col(field)
    if docs.schema[field].dataType.typeName() == "array":
        value = F.explode(F.array_distinct(field))
    return docs.select(value.alias("value")).groupBy("value").agg(F.count("*").alias("documents"))


def reconcile(indexed: DataFrame, tickets: DataFrame) -> DataFrame:
    """Indexed ids without a live terminal ticket; pass them to ``delete_documents``."""
    live = tickets.filter(is_terminal_status(F.col("status"))).select(F.col("id").cast("string").alias("id"))
    return indexed.select(F.col("id").cast("string").alias("id")).join(live, "id", "left_anti")


def latest_n(tickets: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` tickets by creation time."""
    return tickets.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(n)
