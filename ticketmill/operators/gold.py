"""Gold sets and retrieval quality.

A fix group (documents with the same resolution signature) may hold a large
part of the corpus, so mates are never paired up: a document carries the key of
its group, and "is a mate" is equality of keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketmill.functions.once import compute_once
from ticketmill.functions.text import resolution_signature


def fix_members(docs: DataFrame, min_chars: int = 20) -> DataFrame:
    """``(fix_key, ticket_id)`` for every document with a long enough signature."""
    ids = docs.select(F.col("ticket_id").cast("long").alias("ticket_id"), "resolution_text")
    sig = compute_once(ids, ["ticket_id"], {"_sig": resolution_signature(F.col("resolution_text"))})
    return sig.filter(F.length("_sig") >= min_chars).select(
        F.sha2("_sig", 256).alias("fix_key"), "ticket_id"
    )


def cluster_by_resolution(docs: DataFrame, min_chars: int = 20) -> DataFrame:
    """One row per fix group: its size and smallest ticket id.

    The members are the rows of :func:`fix_members`.
    """
    return fix_members(docs, min_chars).groupBy("fix_key").agg(
        F.count("*").alias("size"), F.min("ticket_id").alias("first_ticket_id")
    )


def cluster_mates(docs: DataFrame, min_chars: int = 20) -> DataFrame:
    """Each grouped document with its group key and number of other members."""
    members = fix_members(docs, min_chars)
    sizes = members.groupBy("fix_key").agg((F.count("*") - 1).alias("mates"))
    return members.join(sizes, "fix_key").select("ticket_id", "fix_key", "mates")


def sample_gold_queries(docs: DataFrame, n: int = 50, seed: int = 42) -> DataFrame:
    """``n`` documents with both texts, drawn by a seeded hash; all when n is 0."""
    both = docs.filter("symptom_text <> '' AND resolution_text <> ''")
    if not n:
        return both
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("ticket_id").cast("string")))
    return both.orderBy(draw, "ticket_id").limit(n)


def gold_members(docs: DataFrame, min_chars: int = 20) -> DataFrame:
    """``(fix_key, ticket_id)`` of every document; one with a short signature is a group of its own."""
    ids = docs.select(F.col("ticket_id").cast("long").alias("ticket_id"), "resolution_text")
    sig = compute_once(ids, ["ticket_id"], {"_sig": resolution_signature(F.col("resolution_text"))})
    return sig.select(_fix_key(min_chars).alias("fix_key"), "ticket_id")


def _fix_key(min_chars: int) -> Column:
    own = F.concat(F.lit("ticket:"), F.col("ticket_id").cast("string"))
    return F.when(F.length("_sig") >= min_chars, F.sha2("_sig", 256)).otherwise(own)


def build_gold(docs: DataFrame, n: int = 50, seed: int = 42, include_mates: bool = True) -> DataFrame:
    """Review-ready gold items; groups are formed over all documents.

    Every item names its group by ``fix_key`` and gives its size, itself
    included; the members are the rows of :func:`gold_members`, so a group may
    have any size. ``expected_ticket_ids`` is for hand-labelled items and null
    here. Without mates an item expects itself alone.
    """
    sampled = compute_once(
        sample_gold_queries(docs, n, seed).withColumn("ticket_id", F.col("ticket_id").cast("long")),
        ["ticket_id", "symptom_text", "category", "sub_category", "store"],
        {"_sig": resolution_signature(F.col("resolution_text"))},
    )
    alone = F.concat(F.lit("ticket:"), F.col("ticket_id").cast("string"))
    items = sampled.select(
        F.col("ticket_id").alias("query_ticket_id"), F.col("symptom_text").alias("query_text"),
        F.lit(None).cast("array<bigint>").alias("expected_ticket_ids"),
        "category", "sub_category", F.coalesce("store", F.array().cast("array<string>")).alias("store"),
        F.lit(False).alias("labeled"), (_fix_key(20) if include_mates else alone).alias("fix_key"),
    )
    if not include_mates:
        return items.withColumn("expected_count", F.lit(1).cast("long"))
    sizes = fix_members(docs).groupBy("fix_key").agg(F.count("*").alias("_size"))
    return items.join(sizes, "fix_key", "left").select(
        *items.columns, F.coalesce("_size", F.lit(1)).cast("long").alias("expected_count")
    )


def expected_rows(gold: DataFrame, members: DataFrame) -> DataFrame:
    """``(query_ticket_id, ticket_id)``: what each item expects, one row each."""
    listed = gold.select("query_ticket_id", F.explode("expected_ticket_ids").alias("ticket_id"))
    named = gold.where("expected_ticket_ids IS NULL").select("query_ticket_id", "fix_key").join(members, "fix_key")
    return listed.unionByName(named.select("query_ticket_id", "ticket_id")).distinct()


def gold_summary(gold: DataFrame) -> DataFrame:
    single = F.col("expected_count") == 1
    return gold.agg(
        F.count("*").alias("items"), F.count_if(single).alias("single_fix"),
        F.count_if(~single).alias("with_mates"),
    )


def _graded(gold: DataFrame, hits: DataFrame, k: int, exclude_self: bool, members: DataFrame | None) -> DataFrame:
    """Gold items with the number still expected and the relevant hits' ranks.

    The hits (at most k per query) drive every join; the expected ids and the
    member table are only probed.
    """
    self_id = F.col("query_ticket_id")
    listed = F.col("expected_ticket_ids")
    n_listed = F.size(F.array_distinct(F.array_remove(listed, self_id) if exclude_self else listed))
    n_group = F.col("expected_count") - (1 if exclude_self else 0)
    items = gold.withColumn("n_expected", F.when(listed.isNotNull(), n_listed).otherwise(n_group).cast("long"))
    top = hits.filter(F.col("rank") <= k).select(
        "query_ticket_id", F.col("ticket_id").alias("hit_id"), F.col("rank").alias("hit_rank")
    )
    if exclude_self:
        top = top.filter(F.col("hit_id") != self_id)
    if members is None:
        judged = top.withColumn("hit_fix", F.lit(None).cast("string"))
    else:
        groups = members.select(F.col("ticket_id").alias("hit_id"), F.col("fix_key").alias("hit_fix"))
        judged = top.join(groups, "hit_id", "left")
    joined = items.join(judged, "query_ticket_id", "left")
    relevant: Column = F.coalesce(
        F.when(listed.isNotNull(), F.array_contains(listed, F.col("hit_id")))
        .otherwise(F.col("hit_fix") == F.col("fix_key")),
        F.lit(False),
    )
    return joined.withColumn("relevant", relevant)


def _per_item(graded: DataFrame) -> DataFrame:
    rank = F.when(F.col("relevant"), F.col("hit_rank"))
    return graded.groupBy("query_ticket_id").agg(
        F.first("n_expected").alias("n_expected"),
        F.min(rank).alias("first_rank"),
        F.countDistinct(F.when(F.col("relevant"), F.col("hit_id"))).alias("n_found"),
    )


def evaluate_retrieval(
    gold: DataFrame, hits: DataFrame, k: int = 3, exclude_self: bool = True,
    members: DataFrame | None = None,
) -> DataFrame:
    """One report row: items, evaluated, hit@1, hit@k, recall@k, MRR, misses.

    ``hits`` has ``query_ticket_id, rank, ticket_id``. ``members`` (:func:`gold_members`)
    is needed for items that name their group by ``fix_key``.
    """
    per_item = _per_item(_graded(gold, hits, k, exclude_self, members))
    graded = F.col("n_expected") > 0
    found = graded & F.col("first_rank").isNotNull()

    def mean(x: Column) -> Column:
        return F.round(F.coalesce(F.sum(x), F.lit(0.0)) / F.greatest(F.count_if(graded), F.lit(1)), 4)

    missed = graded & F.col("first_rank").isNull()
    if not exclude_self:
        missed = missed | ~graded
    return per_item.agg(
        F.count("*").alias("items"),
        F.count_if(graded).alias("evaluated"),
        mean(F.when(found & (F.col("first_rank") == 1), 1.0)).alias("hit_at_1"),
        mean(F.when(found, 1.0)).alias("hit_at_k"),
        mean(F.when(found, F.col("n_found") / F.col("n_expected"))).alias("recall_at_k"),
        mean(F.when(found, 1.0 / F.col("first_rank"))).alias("mrr"),
        F.lit(k).alias("k"),
        F.lit(exclude_self).alias("exclude_self"),
        F.count_if(missed).alias("miss_count"),
    )


def eval_misses(
    gold: DataFrame, hits: DataFrame, k: int = 3, exclude_self: bool = True,
    members: DataFrame | None = None, query_chars: int | None = None,
) -> DataFrame:
    """Items whose top k holds no expected ticket, and ungradeable integrity items.

    ``expected`` lists what a hand-labelled item expects; other items name their
    group by ``fix_key``. ``query_chars`` shortens the shown query.
    """
    graded = _graded(gold, hits, k, exclude_self, members)
    per_item = _per_item(graded).filter("first_rank IS NULL AND n_expected > 0")
    got = (
        graded.filter("hit_id IS NOT NULL").groupBy("query_ticket_id")
        .agg(F.array_sort(F.collect_list(F.struct("hit_rank", "hit_id"))).alias("_got"))
    )
    listed = F.col("expected_ticket_ids")
    if exclude_self:
        listed = F.array_remove(listed, F.col("query_ticket_id"))
    missed = (
        gold.join(per_item.select("query_ticket_id"), "query_ticket_id")
        .join(got, "query_ticket_id", "left")
        .select(
            F.col("query_ticket_id").alias("ticket_id"),
            (F.col("query_text") if query_chars is None else F.substring("query_text", 1, query_chars)).alias("query"),
            F.array_sort(F.array_distinct(listed)).alias("expected"), "fix_key",
            F.coalesce(F.transform("_got", lambda g: g["hit_id"]), F.array().cast("array<bigint>")).alias("got"),
            F.lit(None).cast("string").alias("reason"),
        )
    )
    if exclude_self:
        return missed
    empty = gold.filter("size(expected_ticket_ids) = 0").select(
        F.col("query_ticket_id").alias("ticket_id"),
        F.lit(None).cast("string").alias("query"),
        F.lit(None).cast("array<bigint>").alias("expected"), "fix_key",
        F.lit(None).cast("array<bigint>").alias("got"),
        F.lit("no_expected_ids").alias("reason"),
    )
    return missed.unionByName(empty)


def quality_gate(report: DataFrame, min_hit: float = 0.8) -> DataFrame:
    """Adds ``passed``; an integrity report is a smoke test and always passes."""
    ok = ~F.col("exclude_self") | (F.col("hit_at_k") >= min_hit)
    return report.withColumn("passed", ok)


def relevant_found(found: Column, expected: Column) -> Column:
    return F.size(F.array_intersect(found, expected))


def score_search(gold: DataFrame, search_fn, k: int = 3, exclude_self: bool = True, members=None) -> DataFrame:
    """Evaluate any search: ``search_fn(queries, exclude_self, top) -> hits``."""
    queries = gold.select(
        F.col("query_ticket_id").alias("query_id"), F.col("query_text").alias("text"),
        F.col("query_ticket_id").alias("exclude_id"),
    )
    hits = search_fn(queries, exclude_self, k).withColumnRenamed("query_id", "query_ticket_id")
    return evaluate_retrieval(gold, hits, k, exclude_self, members)
