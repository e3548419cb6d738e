"""Lexical, vector and fused retrieval for a batch of queries.

Queries are a DataFrame ``(query_id, text[, vector][, exclude_id])`` and every
operator returns ``(query_id, ticket_id, score, rank)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketmill import defaults as D
from ticketmill.functions.rules import recency_boost
from ticketmill.operators.lexical import LexicalIndex, bm25_scores, top_per_query
from ticketmill.operators.vectors import knn


def rrf_fuse(*rankings: DataFrame, k: int = D.RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists."""
    parts = [r.select("query_id", "ticket_id", (1.0 / (k + F.col("rank"))).alias("part")) for r in rankings]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union.groupBy("query_id", "ticket_id").agg(F.sum("part").alias("score"))


def hybrid_search(
    docs: DataFrame, queries: DataFrame, keep: Column | None = None, top: int = 5,
    exclude_self: bool = False, vector: str = "symptom_vector", index: LexicalIndex | None = None,
) -> DataFrame:
    """Filter, then BM25 and k-NN side by side, fused by rank.

    ``keep`` is a :func:`~ticketmill.functions.rules.metadata_filter`. A query
    without a vector keeps its BM25 score. ``exclude_self`` withholds each
    query's ``exclude_id``. ``index`` is a stored lexical index of the documents
    that pass the filter; without it, one of the query words is made.
    """
    if keep is not None:
        docs = docs.filter(keep)
    if not exclude_self and "exclude_id" in queries.columns:
        queries = queries.drop("exclude_id")
    depth = max(4 * top, 20)
    lexical = bm25_scores(docs, queries, depth, index=index)
    if "vector" not in queries.columns:
        return top_per_query(lexical.drop("rank"), top).withColumn("mode", F.lit("bm25-only"))
    near = knn(docs, queries.filter("size(vector) > 0"), depth, vector)
    has_vector = queries.select("query_id", F.coalesce(F.size("vector") > 0, F.lit(False)).alias("_v"))
    share = 1.0 / (D.RRF_K + F.col("rank"))
    # both rankings are read once: a query without a vector carries its plain score
    parts = lexical.join(has_vector, "query_id").select(
        "query_id", "ticket_id", "_v", F.when(F.col("_v"), share).otherwise(F.col("score")).alias("part")
    ).unionByName(near.select("query_id", "ticket_id", F.lit(True).alias("_v"), share.alias("part")))
    both = parts.groupBy("query_id", "ticket_id").agg(
        F.sum("part").alias("score"), F.bool_or("_v").alias("_v")
    )
    mode = F.when(F.col("_v"), "hybrid").otherwise("bm25-only")
    return top_per_query(both.select("query_id", "ticket_id", "score", mode.alias("mode")), top)


def join_boosts(hits: DataFrame, boosts: DataFrame | None) -> DataFrame:
    """Factor per ticket, 1.0 when there is none."""
    if boosts is None:
        return hits.withColumn("boost", F.lit(1.0))
    return hits.join(boosts.select("ticket_id", "boost"), "ticket_id", "left").fillna({"boost": 1.0})


def rerank_topk(hits: DataFrame, top: int, age: str = "age_days") -> DataFrame:
    """Order by base score times recency times boost, keep ``top`` per query.

    The base is ``reranker_score`` where there is one, else ``score``, else 0.
    """
    base = F.coalesce("score", F.lit(0.0))
    if "reranker_score" in hits.columns:
        base = F.coalesce(F.when(F.col("reranker_score") != 0, F.col("reranker_score")), base)
    weighted = hits.withColumn("score", base * recency_boost(F.col(age)) * F.col("boost"))
    return top_per_query(weighted.drop("rank"), top)


def result_projection(hits: DataFrame, symptom_chars: int | None = None, resolution_chars: int | None = None) -> DataFrame:
    """Output columns with rounded score; texts are whole unless a length is given."""
    def shown(name: str, chars: int | None) -> Column:
        text = F.coalesce(name, F.lit(""))
        return text if chars is None else F.substring(text, 1, chars)

    return hits.select(
        "query_id", "rank", "ticket_id", "display_id", "subject",
        shown("symptom_text", symptom_chars).alias("symptom"), shown("resolution_text", resolution_chars).alias("resolution"),
        "resolution_source", "category", "sub_category", "store", "apps", "error_codes", "age_days",
        F.round("score", 4).alias("score"),
        F.coalesce("linked_itglue_urls", F.array().cast("array<string>")).alias("itglue_urls"),
        "mode",
    )


def search_kb(
    docs: DataFrame, queries: DataFrame, top: int = 3, keep: Column | None = None,
    boosts: DataFrame | None = None, recency: str = "age_days", now: Column | None = None,
    symptom_chars: int | None = None, resolution_chars: int | None = None,
) -> DataFrame:
    """Prior fixes for a batch of symptom queries.

    ``recency='age_days'`` weighs by resolution time as stored;
    ``'since_closed'`` by the days from closing to ``now``.
    """
    hits = hybrid_search(docs, queries, keep, max(3 * top, 10))
    age = "age_days"
    found = hits.drop("rank").join(docs.drop("score", "mode"), "ticket_id")
    if recency == "since_closed":
        age = "_since"
        found = found.withColumn(age, F.date_diff(now if now is not None else F.current_timestamp(), "closed_at"))
    return result_projection(rerank_topk(join_boosts(found, boosts), top, age), symptom_chars, resolution_chars)
