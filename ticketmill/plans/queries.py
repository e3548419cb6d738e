"""Registered queries: every operator over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketmill import defaults as D
from ticketmill import schemas
from ticketmill.functions import entities, rules, status, text, times
from ticketmill.operators import (
    baseline, clusters, corpus, digest, evidence, feedback, gold, kb, lexical, monitor, ordered, search, vector_index, vectors,
)
from ticketmill.plans import inputs as I
from ticketmill.sources import buckets, landed, records, snapshots
from ticketmill.streaming import monitor as live

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
# Turns of a conversation that one inline array holds, and that are ranked together.
TURNS = 64


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def joined(values: Column) -> Column:
    return F.coalesce(F.array_join(values, "|"), F.lit(""))


def at(value: str) -> Column:
    return F.lit(value).cast("timestamp")


# --- inline conversations ---
@query
def explode_conversations(spark, sf):
    # a conversation may hold any part of the rows: its turns are ranked bucket by
    # bucket and come to arrays of TURNS, never all to one
    rows = I.table(spark, sf, "conversations").select(
        F.struct("conv_id").alias("key"), F.coalesce("turn", F.lit(2**63 - 1)).alias("at"),
        (F.col("role") == "system").alias("private"), (F.col("role") == "user").alias("incoming"),
        F.col("text").alias("body_text"), F.lit(None).cast("string").alias("body"), F.lit(None).cast("string").alias("created_at"),
    )
    ties = [F.col(c) for c in ("private", "incoming", "body_text")]
    ranked = ordered.rank_in_key(rows, ["key"], "at", ties, width=TURNS).withColumn("rank", F.col("rank") - 1)
    turn = F.struct("rank", "private", "incoming", "body_text", "body", "created_at")
    block = F.struct("key.conv_id", (F.col("rank") - F.col("rank") % TURNS).cast("int").alias("first"))
    inline = ranked.groupBy(block.alias("id")).agg(F.array_sort(F.collect_list(turn)).alias("conversations"))
    return landed.explode_conversations(inline).select(
        "ticket_id.conv_id", (F.col("ticket_id.first") + F.col("seq")).alias("seq"), "private", "incoming", "body_text"
    ).withColumnRenamed("conv_id", "ticket_id")


# --- text functions ---------------------------------------------------------
@query
def strip_html(spark, sf):
    return I.table(spark, sf, "pages").select("page_id", text.strip_html(F.col("html")).alias("plain"))


@query
def clean_text(spark, sf):
    docs = I.table(spark, sf, "documents").select(F.lit("d").alias("src"), F.col("doc_id").alias("id"), "text")
    pages = I.table(spark, sf, "pages").select(F.lit("p").alias("src"), F.col("page_id").alias("id"), F.col("html").alias("text"))
    return docs.unionAll(pages).select("src", "id", text.clean_text(F.col("text")).alias("cleaned"))


@query
def redact(spark, sf):
    return I.table(spark, sf, "documents").select("doc_id", text.redact(F.col("text")).alias("redacted"))


@query
def redact_keys_only(spark, sf):
    return I.table(spark, sf, "documents").select("doc_id", text.redact(F.col("text"), contacts=False).alias("redacted"))


@query
def sanitize(spark, sf):
    return I.table(spark, sf, "conversations").select("conv_id", "turn", text.sanitize(F.col("text")).alias("safe"))


@query
def secret_flags(spark, sf):
    t = F.col("text")
    return I.table(spark, sf, "documents").select(
        "doc_id", text.contains_secret(t).alias("has_secret"), text.is_secret_only(t).alias("secret_only")
    )


@query
def normalize(spark, sf):
    return I.table(spark, sf, "documents").select("doc_id", text.normalize(F.col("text")).alias("normal"))


@query
def error_codes(spark, sf):
    return I.table(spark, sf, "documents").select(
        "doc_id", joined(entities.extract_error_codes(F.col("text"), patterns=I.CODE_PATTERNS)).alias("codes")
    )


@query
def hostnames(spark, sf):
    return I.table(spark, sf, "documents").select(
        "doc_id", joined(entities.extract_hostnames(F.col("text"), patterns=I.HOST_PATTERNS)).alias("hosts")
    )


@query
def apps(spark, sf):
    return I.table(spark, sf, "documents").select(
        "doc_id", joined(entities.extract_apps(F.col("text"), dictionary=I.WORDS)).alias("apps")
    )


@query
def dedupe_ci(spark, sf):
    return I.table(spark, sf, "conversations").select(
        "conv_id", "turn", joined(entities.dedupe_ci(F.split("text", " "))).alias("words")
    )


@query
def normalize_store(spark, sf):
    key = F.col("c_custkey").cast("string")
    raw = (
        F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit('["a'), key, F.lit(' ", "", "b"]')))
        .when(F.col("c_custkey") % 3 == 1, F.concat(F.lit(" x"), key, F.lit(" ,, y ")))
    )
    fields = F.create_map(F.lit("msf_store"), F.lit(""), F.lit("store"), raw, F.lit("location"), F.col("c_mktsegment"))
    return I.table(spark, sf, "customer").select("c_custkey", joined(entities.normalize_store(fields)).alias("stores"))


@query
def parse_ts(spark, sf):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    n = F.col("o_orderkey") % 6
    raw = (
        F.when(n == 0, F.concat(day, F.lit("T10:11:12Z")))
        .when(n == 1, F.concat(day, F.lit("T10:11:12.500+02:00")))
        .when(n == 2, day)
        .when(n == 3, F.concat(day, F.lit(" 23:59")))
        .when(n == 4, F.concat(day, F.lit("T25:00:00")))
        .otherwise(F.date_format("o_orderdate", "yyyy"))
    )
    return I.table(spark, sf, "orders").select(
        "o_orderkey", F.coalesce(I.text_time(times.parse_ts(raw)), F.lit("none")).alias("parsed")
    )


@query
def http_date_age(spark, sf):
    raw = F.concat(F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    return I.events(spark, sf).select(
        "event_id", F.round(times.http_date_age_hours(raw, at(I.NOW)), 6).alias("hours")
    )


@query
def manifest_version(spark, sf):
    key = F.col("p_partkey").cast("string")
    body = F.when(
        F.col("p_partkey") % 2 == 0,
        F.concat(F.lit('<assemblyIdentity name="a" version="1.2.3.'), key, F.lit('"/>')),
    ).when(F.col("p_partkey") % 3 == 0, F.concat(F.lit('<x version="4.5.6.'), key, F.lit('"/>'))).otherwise(key)
    return I.table(spark, sf, "part").select(
        "p_partkey", F.coalesce(status.manifest_version(body), F.lit("none")).alias("version")
    )


@query
def vendor_status(spark, sf):
    pages = I.table(spark, sf, "pages").select(F.col("url").alias("vendor"), "html", "page_id")
    return evidence.vendor_statuses(pages).groupBy("vendor", "status").agg(
        F.count("*").alias("pages"), F.count("checked").alias("with_time")
    )


@query
def pool_hint(spark, sf):
    key = F.col("c_custkey")
    machine = F.concat(F.lit("Computer MAN"), (key % 90).cast("string"), F.lit("-VDI-128 slow"))
    raw = F.when(key % 3 == 0, machine).otherwise(F.col("c_name"))
    return I.table(spark, sf, "customer").select("c_custkey", F.coalesce(rules.pool_hint(raw), F.lit("none")).alias("hint"))


@query
def system_key(spark, sf):
    return I.event_tickets(spark, sf).select(F.col("id").alias("event_id"), "system_key")


@query
def feedback_outcome(spark, sf):
    return I.feedback(spark, sf).select("seq", rules.feedback_outcome(F.col("resolved")).alias("outcome"))


@query
def recency_boost(spark, sf):
    return I.kb_docs(spark, sf).select("ticket_id", rules.recency_boost(F.col("age_days")).alias("factor"))


@query
def terminal_status(spark, sf):
    raw = F.when(F.col("o_orderkey") % 4 == 0, "4").when(F.col("o_orderkey") % 4 == 1, " 5 ").when(
        F.col("o_orderkey") % 4 == 2, F.col("o_orderstatus"))
    return I.table(spark, sf, "orders").select("o_orderkey", rules.is_terminal_status(raw).alias("terminal"))


@query
def age_days(spark, sf):
    hours = F.make_dt_interval(hours=(F.col("event_id") % 100 - 10).cast("int"))
    return I.events(spark, sf).select("event_id", times.age_days(F.col("ts"), F.col("ts") + hours).alias("days"))


@query
def log_properties(spark, sf):
    props = F.array(
        F.struct(F.lit("k").alias("Name"), F.get_json_object("props", "$.k").alias("Value")),
        F.struct(F.lit("").alias("Name"), F.lit("lost").alias("Value")),
        F.struct(F.lit("level").alias("Name"), F.concat(F.lit("L"), F.col("user_id").cast("string")).alias("Value")),
    )
    raw = I.events(spark, sf).select(
        "event_id", F.col("ts").alias("Timestamp"), F.lit("Error").alias("Level"), F.lit("m").alias("RenderedMessage"),
        F.col("event_id").cast("string").alias("Id"), F.col("event_type").alias("EventType"), props.alias("Properties"),
    )
    flat = landed.flatten_log_properties(raw)
    return flat.select(
        "event_id", F.col("fields")["level"].alias("level"), F.col("fields")["k"].alias("k"),
        F.col("fields")["event_type"].alias("event_type"), F.size("fields").alias("n_fields"),
    )


# --- cluster keys -----------------------------------------------------------
@query
def match_keys(spark, sf):
    matched = clusters.match_cluster_keys(I.table(spark, sf, "documents"), F.col("text"), I.RULES)
    primary = clusters.primary_cluster_key(F.col("cluster_keys"))
    return matched.select(
        "doc_id", joined(F.col("cluster_keys")).alias("keys"), F.coalesce(primary, F.lit("none")).alias("primary_key"),
        F.coalesce(clusters.cluster_label(primary, I.RULES), F.lit("none")).alias("label"),
    )


@query
def live_tickets(spark, sf):
    raw = I.table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"),
        F.when(F.col("doc_id") % 11 != 0, I.iso_text(I.conv_start(F.col("doc_id") % 700))).otherwise("soon").alias("created_at"),
        F.col("lang").alias("subject"), F.lit("").alias("description_text"), F.col("text").alias("description"),
        F.col("lang").alias("category"), F.lit(None).cast("string").alias("sub_category"), F.lit("2").alias("status"),
    )
    parsed = clusters.parse_live_tickets(raw, I.RULES)
    return parsed.select(
        "id", I.text_time(F.col("created_at")).alias("created"), F.length("match_text").alias("chars"),
        "system_key", F.size("cluster_keys").alias("n_keys"),
    )


# --- knowledge base ---------------------------------------------------------
@query
def symptom(spark, sf):
    return kb.build_symptom(I.tickets(spark, sf), I.conversations(spark, sf)).select(
        F.col("id").alias("conv_id"), "symptom"
    )


@query
def resolution(spark, sf):
    return kb.build_resolution(I.tickets(spark, sf), I.conversations(spark, sf)).select(
        F.col("id").alias("conv_id"), "resolution", "source"
    )


def _links(spark, sf):
    return I.table(spark, sf, "conversations").filter("turn = 1").select(
        F.col("conv_id").cast("string").alias("ticket_id"),
        F.array(F.concat(F.lit("doc-"), F.col("conv_id").cast("string"))).alias("ids"),
        F.array(F.concat(F.lit("https://kb/"), F.col("conv_id").cast("string"))).alias("urls"),
    )


@query
def documents(spark, sf):
    docs = kb.build_documents(
        I.tickets(spark, sf), I.conversations(spark, sf), _links(spark, sf), dictionary=I.WORDS,
        error_patterns=I.CODE_PATTERNS, host_patterns=I.HOST_PATTERNS,
    )
    return docs.select(
        "id", "ticket_id", "display_id", "subject", "symptom_text", "resolution_text", "resolution_source",
        "has_resolution", "category", F.coalesce("sub_category", F.lit("")).alias("sub_category"), "department",
        joined(F.col("store")).alias("store"), "group", "ticket_type", joined(F.col("tags")).alias("tags"),
        joined(F.col("error_codes")).alias("error_codes"), joined(F.col("hostnames")).alias("hostnames"),
        joined(F.col("apps")).alias("apps"), I.text_time(F.col("created_at")).alias("created"),
        I.text_time(F.col("closed_at")).alias("closed"), "age_days",
        joined(F.col("linked_itglue_doc_ids")).alias("linked_ids"),
        joined(F.col("linked_itglue_urls")).alias("linked_urls"),
    )


@query
def build_metrics(spark, sf):
    made = kb.build_candidates(I.tickets(spark, sf), I.conversations(spark, sf))
    return kb.build_metrics(made).withColumn("newest_updated_at", I.text_time(F.col("newest_updated_at")))


@query
def upload_metrics(spark, sf):
    docs = I.table(spark, sf, "embeddings").select(
        "vec_id", F.when(F.col("vec_id") % 9 == 0, F.slice("embedding", 1, 32)).otherwise(F.col("embedding")).alias("symptom_vector")
    )
    return kb.upload_metrics(*schemas.split_by_dimensions(docs, 64, ("symptom_vector",)))


@query
def metadata_filter(spark, sf):
    keep = rules.metadata_filter(category="en", store="src3", app="outlook", exclude_ticket_id=17)
    return I.kb_docs(spark, sf).filter(keep).select("ticket_id")


# --- corpus -----------------------------------------------------------------
def _upsert_sides(spark, sf):
    customer = I.table(spark, sf, "customer")
    target = customer.filter("c_custkey % 4 <> 3").select(
        "c_custkey", "c_name", "c_acctbal", "c_mktsegment", F.array(F.col("c_acctbal").cast("float")).alias("x_vector")
    )
    empty = F.array().cast("array<float>")
    updates = customer.filter("c_custkey % 2 = 1").select(
        "c_custkey", F.concat(F.lit("new "), "c_name").alias("c_name"),
        F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal") + 1).alias("c_acctbal"),
        F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit(1.0).cast("float"))).otherwise(empty).alias("x_vector"),
    )
    return target, updates


def _upserted(merged):
    return merged.select(
        "c_custkey", "c_name", F.coalesce("c_acctbal", F.lit(-1.0)).alias("c_acctbal"),
        F.coalesce("c_mktsegment", F.lit("none")).alias("c_mktsegment"),
        F.coalesce(F.try_element_at("x_vector", F.lit(1)).cast("double"), F.lit(-1.0)).alias("x0"),
    )


@query
def upsert(spark, sf):
    return _upserted(corpus.upsert_documents(*_upsert_sides(spark, sf), "c_custkey"))


@query
def upsert_buckets(spark, sf):
    """The same in a stored table of which only the touched buckets are rewritten."""
    target, updates = _upsert_sides(spark, sf)
    path = f"{I.scratch(spark)}/customers"
    for rows in (target, updates):
        buckets.upsert(spark, path, target.schema, rows, "c_custkey", 16)
    return _upserted(buckets.read(spark, path, target.schema))


@query
def delete(spark, sf):
    ids = I.table(spark, sf, "labels").filter("toxic = 1").select("doc_id")
    return corpus.scan_ids(corpus.delete_documents(I.table(spark, sf, "documents"), ids, "doc_id"), "doc_id")


@query
def delete_buckets(spark, sf):
    ids = I.table(spark, sf, "labels").filter("toxic = 1").select("doc_id")
    docs = I.table(spark, sf, "documents").select("doc_id", "lang")
    path = f"{I.scratch(spark)}/documents"
    buckets.upsert(spark, path, docs.schema, docs, "doc_id", 16)
    buckets.delete(spark, path, docs.schema, ids, "doc_id", 16)
    return buckets.read(spark, path, docs.schema).select("doc_id")


@query
def document_count(spark, sf):
    return corpus.document_count(I.table(spark, sf, "documents"))


@query
def scan_documents(spark, sf):
    return corpus.scan_documents(I.kb_docs(spark, sf)).select("ticket_id", "category", joined(F.col("store")).alias("store"), "age_days")


@query
def facets_category(spark, sf):
    return corpus.facet_counts(I.kb_docs(spark, sf), "category")


@query
def facets_store(spark, sf):
    return corpus.facet_counts(I.kb_docs(spark, sf), "store")


@query
def reconcile(spark, sf):
    indexed = I.table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    live_rows = I.table(spark, sf, "labels").select(
        F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "4").otherwise("2").alias("status")
    )
    return corpus.reconcile(indexed, live_rows)


@query
def latest_n(spark, sf):
    orders = I.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"))
    return corpus.latest_n(orders, 500).select("id")


# --- incremental reads ------------------------------------------------------
def _control(spark, sf):
    old = I.table(spark, sf, "orders").filter("o_orderstatus = 'F'")
    return old.agg(
        F.min("o_orderdate").cast("timestamp").alias("_lo"), F.max("o_orderdate").cast("timestamp").alias("_hi")
    ).select(
        F.timestamp_seconds((F.unix_seconds("_lo") + F.unix_seconds("_hi")) / 2).alias("last_updated_at"),
        F.lit(None).cast("timestamp").alias("last_run_at"), F.lit(0).cast("bigint").alias("last_indexed_count"),
    )


def _orders(spark, sf):
    return I.table(spark, sf, "orders").withColumn("updated_at", F.col("o_orderdate").cast("timestamp"))


@query
def incremental(spark, sf):
    return snapshots.incremental_scan(_orders(spark, sf), _control(spark, sf)).select("o_orderkey")


@query
def watermark(spark, sf):
    control = _control(spark, sf)
    built = snapshots.incremental_scan(_orders(spark, sf), control).filter("o_orderstatus <> 'P'")
    moved = snapshots.advance_watermark(control, built)
    held = snapshots.advance_watermark(control, built, limit=10)
    both = moved.withColumn("run", F.lit("full")).unionAll(held.withColumn("run", F.lit("capped")))
    return both.select("run", I.text_time(F.col("last_updated_at")).alias("mark"), "last_indexed_count")


@query
def filter_tickets(spark, sf):
    raw = I.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderkey") % 50 == 0, "later").otherwise(I.iso_text(F.col("o_orderdate"))).alias("created_at"),
        I.iso_text(F.col("o_orderdate")).alias("updated_at"),
    )
    return landed.filter_tickets(raw, created_since="1999-06-01T00:00:00Z").select("id")


# --- feedback ---------------------------------------------------------------
@query
def latest_feedback(spark, sf):
    return feedback.latest_feedback(I.feedback(spark, sf)).select("ticket_id", "suggested_ticket_id", "seq", "accepted")


@query
def suggestion_stats(spark, sf):
    return feedback.suggestion_stats(I.feedback(spark, sf))


@query
def boost_table(spark, sf):
    return I.boosts(spark, sf)


@query
def feedback_rows(spark, sf):
    kind = F.when(F.col("event_type") == "error", "cluster").when(F.col("event_type") == "click", "retrieval")
    partial = I.events(spark, sf).select(
        (F.col("event_id") % 500).alias("ticket_id"), F.col("user_id").alias("suggested_ticket_id"),
        F.when(F.col("value") > 5, F.col("value") > 10).alias("accepted"), kind.alias("kind"),
        F.col("ts").alias("at"), F.col("event_id").alias("seq"),
    )
    return records.feedback_rows(partial).select(
        "seq", "ticket_id", "suggested_ticket_id", "accepted", "kind", F.col("rank").isNull().alias("no_rank"), I.text_time(F.col("at")).alias("at")
    )


@query
def accept_rate_listing(spark, sf):
    return feedback.accept_rate_listing(feedback.suggestion_stats(I.feedback(spark, sf)))


# --- gold and evaluation ----------------------------------------------------
@query
def signature_groups(spark, sf):
    return gold.cluster_by_resolution(I.kb_docs(spark, sf))


@query
def cluster_mates(spark, sf):
    return gold.cluster_mates(I.kb_docs(spark, sf))


@query
def gold_set(spark, sf):
    return gold.build_gold(I.kb_docs(spark, sf), n=0).select(
        "query_ticket_id", "expected_count", "fix_key", "category", "labeled"
    )


@query
def gold_members(spark, sf):
    return gold.gold_members(I.kb_docs(spark, sf))


@query
def gold_sample(spark, sf):
    return gold.sample_gold_queries(I.kb_docs(spark, sf), 50, 42).select("ticket_id")


@query
def gold_summary(spark, sf):
    return gold.gold_summary(gold.build_gold(I.kb_docs(spark, sf), n=0))


def _vector_hits(spark, sf, exclude: bool):
    docs = I.vector_docs(spark, sf)
    q = docs.select(F.col("ticket_id").alias("query_id"), F.col("symptom_vector").alias("vector"))
    if exclude:
        q = q.withColumn("exclude_id", F.col("query_id"))
    return vectors.knn(docs, q, 3).withColumnRenamed("query_id", "query_ticket_id")


@query
def eval_loo(spark, sf):
    items, members = I.vector_gold(spark, sf)
    report = gold.evaluate_retrieval(items, _vector_hits(spark, sf, True), 3, True, members)
    return gold.quality_gate(report, 0.8)


@query
def score_search(spark, sf):
    docs = I.vector_docs(spark, sf)
    items, members = I.vector_gold(spark, sf)
    vecs = docs.select(F.col("ticket_id").alias("query_id"), F.col("symptom_vector").alias("vector"))

    def search_fn(queries, exclude_self, k):
        asked = queries.join(vecs, "query_id")
        return vectors.knn(docs, asked if exclude_self else asked.drop("exclude_id"), k)

    return gold.score_search(items, search_fn, 3, True, members)


@query
def eval_integrity(spark, sf):
    items, members = I.vector_gold(spark, sf)
    return gold.evaluate_retrieval(items, _vector_hits(spark, sf, False), 3, False, members)


@query
def eval_misses(spark, sf):
    items, members = I.vector_gold(spark, sf)
    missed = gold.eval_misses(items, _vector_hits(spark, sf, True), 3, True, members)
    return missed.select("ticket_id", "query", "fix_key", joined(F.col("got").cast("array<string>")).alias("got"))


@query
def relevant_found(spark, sf):
    items, _ = I.vector_gold(spark, sf)
    hits = _vector_hits(spark, sf, True).groupBy("query_ticket_id").agg(F.collect_list("ticket_id").alias("found"))
    expected = F.sequence(F.col("query_ticket_id") - 100, F.col("query_ticket_id") + 100)
    return items.join(hits, "query_ticket_id").select(
        "query_ticket_id", gold.relevant_found(F.col("found"), expected).alias("n_found")
    )


# --- retrieval --------------------------------------------------------------
@query
def embed(spark, sf):
    embedded = vectors.embed_documents(I.kb_docs(spark, sf))
    norm = F.aggregate("symptom_vector", F.lit(0.0), lambda a, v: a + v * v)
    placed = F.transform("resolution_vector", lambda v, i: v.cast("double") * (i + 1))
    probe = F.aggregate(placed, F.lit(0.0), lambda a, v: a + v)
    return embedded.select(
        "ticket_id", F.size("symptom_vector").alias("dims"), F.round(norm, 3).alias("norm"), F.round(probe, 6).alias("probe")
    )


@query
def knn_topk(spark, sf):
    docs = I.vector_docs(spark, sf)
    q = docs.select(F.col("ticket_id").alias("query_id"), F.col("symptom_vector").alias("vector"),
                    F.col("ticket_id").alias("exclude_id"))
    return vectors.knn(docs, q, 20).select("query_id", "ticket_id", "rank", F.round("score", 6).alias("score"))


@query
def bm25(spark, sf):
    hits = lexical.bm25_scores(I.kb_docs(spark, sf), I.queries(spark, sf), 20, ("symptom_text",))
    return hits.select("query_id", "ticket_id", "rank", F.round("score", 6).alias("score"))


@query
def bm25_stored(spark, sf):
    """The same through an index that is written once and opened again."""
    path = f"{I.scratch(spark)}/lexical"
    lexical.write_index(I.kb_docs(spark, sf), path, ("symptom_text",))
    hits = lexical.bm25_search(lexical.open_index(spark, path), I.queries(spark, sf), 20)
    return hits.select("query_id", "ticket_id", "rank", F.round("score", 6).alias("score"))


@query
def knn_indexed(spark, sf):
    """The same as knn_topk through a stored inverted file, lists pruned by the triangle inequality."""
    path = f"{I.scratch(spark)}/vectors"
    docs = I.vector_docs(spark, sf)
    vector_index.write_index(docs, path, lists=64)
    q = docs.select(F.col("ticket_id").alias("query_id"), F.col("symptom_vector").alias("vector"),
                    F.col("ticket_id").alias("exclude_id"))
    hits = vector_index.knn(vector_index.open_index(spark, path), q, 20)
    return hits.select("query_id", "ticket_id", "rank", F.round("score", 6).alias("score"))


def _hybrid(spark, sf, top):
    keep = rules.metadata_filter(category="en")
    return search.hybrid_search(
        I.kb_docs(spark, sf, vectors=True), I.queries(spark, sf, vectors=True), keep, top
    )


@query
def rrf(spark, sf):
    docs, q = I.kb_docs(spark, sf, vectors=True), I.queries(spark, sf, vectors=True)
    words = lexical.bm25_scores(docs, q, 20, ("symptom_text",))
    near = vectors.knn(docs, q.filter("size(vector) > 0"), 20)
    return search.rrf_fuse(words, near).select("query_id", "ticket_id", F.round("score", 9).alias("score"))


@query
def hybrid_filtered(spark, sf):
    return _hybrid(spark, sf, 5).select("query_id", "ticket_id", "rank", F.round("score", 9).alias("score"), "mode")


@query
def search_kb(spark, sf):
    found = search.search_kb(
        I.kb_docs(spark, sf), I.queries(spark, sf), 3, rules.metadata_filter(category="en"), I.boosts(spark, sf)
    )
    return found.select(
        "query_id", "rank", "ticket_id", "symptom", F.length("resolution").alias("resolution_chars"), "age_days",
        "score", "mode",
    )


@query
def search_kb_hybrid(spark, sf):
    found = search.search_kb(
        I.kb_docs(spark, sf, vectors=True), I.queries(spark, sf, vectors=True), 3, rules.metadata_filter(category="en"),
        I.boosts(spark, sf),
    )
    return found.select("query_id", "rank", "ticket_id", "age_days", "mode")


# --- monitor ----------------------------------------------------------------
@query
def trailing_count(spark, sf):
    return clusters.trailing_count(I.event_tickets(spark, sf)).select(F.col("id").alias("event_id"), "trailing")


@query
def ticket_ranks(spark, sf):
    return clusters.ticket_ranks(I.event_tickets(spark, sf)).select(F.col("id").alias("event_id"), "rank")


@query
def clusters_at(spark, sf):
    return clusters.cluster_counts(I.event_tickets(spark, sf), at(I.NOW)).withColumn(
        "first_created_at", I.text_time(F.col("first_created_at"))
    )


@query
def first_ticket(spark, sf):
    return clusters.first_ticket(I.event_tickets(spark, sf)).select("key", "first_ticket_id")


def _baseline(spark, sf):
    return baseline.compute_baseline(I.event_tickets(spark, sf), at("2024-01-31 00:00:00"), 3)


@query
def baseline_rows(spark, sf):
    return _baseline(spark, sf)


@query
def baseline_full_weeks(spark, sf):
    return baseline.compute_baseline(I.event_tickets(spark, sf), at("2024-01-31 00:00:00"), 3, full_weeks_only=True)


@query
def week_starts(spark, sf):
    newest = I.events(spark, sf).agg(F.max("ts").alias("now"))
    return newest.select(F.explode(times.week_starts(F.col("now"), 3, D.BASELINE_TZ)).alias("d")).select(
        F.date_format("d", "yyyy-MM-dd").alias("week_start")
    )


@query
def baseline_threshold(spark, sf):
    touched = clusters.window_tickets(I.event_tickets(spark, sf), at(I.NOW)).select("key", "system_key").distinct()
    return baseline.baseline_threshold(
        touched.withColumn("tick", at(I.NOW)), _baseline(spark, sf), ["key"]
    ).withColumn("threshold", F.round("threshold", 6))


@query
def candidate_ticks(spark, sf):
    found = monitor.candidates(I.event_tickets(spark, sf), _baseline(spark, sf))
    return found.select(
        "key", I.text_time(F.col("tick")).alias("tick"), "count", "first_ticket_id",
        F.round("threshold", 6).alias("threshold"),
    )


@query
def cooldown_alerts(spark, sf):
    fired = monitor.replay_ticks(I.event_tickets(spark, sf), _baseline(spark, sf))
    return fired.select(
        "key", I.text_time(F.col("opened_at")).alias("opened"), "count", "first_ticket_id",
        I.text_time(F.col("cooldown_until")).alias("cooldown_until"), "status",
    )


@query
def replay_once(spark, sf):
    fired = monitor.replay(I.event_tickets(spark, sf), _baseline(spark, sf), min_count=2)
    return fired.select("key", I.text_time(F.col("tick")).alias("tick"), "count", "first_ticket_id")


@query
def in_cooldown(spark, sf):
    users = I.events(spark, sf).groupBy(F.col("user_id").cast("string").alias("key")).agg(F.count("*").alias("count"))
    alerts = I.events(spark, sf).filter((F.col("event_type") == "error") & (F.col("ts") <= at(I.NOW))).select(
        F.col("user_id").cast("string").alias("key"), (F.col("ts") + F.expr("interval 2 hours")).alias("cooldown_until")
    )
    return monitor.suppress_in_cooldown(users, alerts, at(I.NOW))


@query
def lifecycle(spark, sf):
    closed = monitor.alert_lifecycle(I.order_alerts(spark, sf), at("1998-01-01 02:00:00"))
    return closed.groupBy("key", "status").agg(F.count("*").alias("alerts"), F.sum("id").alias("ids"))


@query
def latest_alert(spark, sf):
    return monitor.latest_alert(I.order_alerts(spark, sf)).select("key", "id", I.text_time(F.col("opened_at")).alias("opened"))


@query
def verdicts(spark, sf):
    return monitor.apply_verdicts(I.order_alerts(spark, sf), I.line_verdicts(spark, sf)).select(
        "id", "status", F.coalesce("verdict", F.lit("none")).alias("verdict")
    )


# --- evidence ---------------------------------------------------------------
def _signals(spark, sf):
    return evidence.signal_counts(I.logs(spark, sf), I.hour_clusters(spark, sf), I.catalog(spark))


@query
def signal_counts(spark, sf):
    return _signals(spark, sf).withColumn("elevated", evidence.elevated()).select(
        "cluster_id", "signal_key", "role", "stream", "mode", "count", "prior", "elevated"
    )


@query
def confidence(spark, sf):
    return evidence.confidence_tier(_signals(spark, sf))


@query
def alert_evidence(spark, sf):
    proof = evidence.alert_evidence(_signals(spark, sf), _pools(spark, sf))
    lines = F.transform(
        "evidence.signals",
        lambda s: F.concat_ws(":", s["key"], s["role"], s["count"].cast("string"), s["prior"].cast("string"), s["elevated"].cast("string")),
    )
    return proof.select(
        "cluster_id", F.col("evidence.confidence").alias("confidence"), joined(lines).alias("signals"),
        joined(F.col("evidence.pools")).alias("pools"),
    )


def _samples(spark, sf):
    return evidence.signal_samples(I.logs(spark, sf), I.hour_clusters(spark, sf), I.catalog(spark), 5)


@query
def log_samples(spark, sf):
    return evidence.limit_samples(_samples(spark, sf), 3).select("cluster_id", "signal_key", "ord", "event_id", "desktop")


@query
def sample_fields(spark, sf):
    tagged = evidence.tag_signals(I.logs(spark, sf), I.catalog(spark))
    shown = evidence.sample_log_fields(tagged, ("desktop", "user"))
    return shown.select("signal_key", I.text_time(F.col("timestamp")).alias("at"), "source", "event", "desktop", "user")


def _pool_counts(spark, sf):
    return evidence.pool_counts(I.logs(spark, sf), I.hour_clusters(spark, sf), I.catalog(spark))


def _pools(spark, sf):
    return evidence.pools_seen(_pool_counts(spark, sf))


@query
def pools_seen(spark, sf):
    return _pools(spark, sf)


@query
def log_window(spark, sf):
    return landed.filter_log_events(
        I.logs(spark, sf), "horizon", "2024-01-10 00:00:00", "2024-01-12 06:00:00"
    ).select("event_id", "event_type")


def _app_logs(spark, sf):
    level = F.when(F.col("value") > 30, "Error").when(F.col("value") > 15, "Warning").otherwise("Info")
    return I.events(spark, sf).select(
        F.col("event_type").alias("app"), level.alias("level"), F.col("ts").alias("timestamp"),
        F.col("user_id").cast("string").alias("machine"), F.lit("s").alias("session"),
    )


@query
def error_rate(spark, sf):
    rate = evidence.log_error_rate(_app_logs(spark, sf), I.hour_clusters(spark, sf), "purchase")
    return rate.select("cluster_id", "signal_key", "count", "prior")


# metrics over the given events: peaks of value per event type
EVENT_METRICS = (
    D.Metric("m.view", "view", "a"), D.Metric("m.click", "click", "a", 60.0), D.Metric("m.signup", "signup", "b"),
)
EVENT_WORDS = {"a": ("view", "err"), "b": ("sign",)}


@query
def metric_elevation(spark, sf):
    points = I.events(spark, sf).select(F.col("event_type").alias("metric"), "ts", "value")
    asked = I.hour_clusters(spark, sf).withColumn(
        "metrics", evidence.pick_metrics(F.array("key"), EVENT_METRICS, EVENT_WORDS)
    )
    peaks = evidence.metric_elevation(points, asked)
    signal = evidence.metric_signal(peaks).select("cluster_id", "signal_key", "count", "prior", "threshold_hit")
    ratio = peaks.select(
        "cluster_id", F.concat(F.lit("metric."), "metric_key").alias("signal_key"), F.coalesce("ratio", F.lit(-1.0)).alias("ratio")
    )
    return signal.join(ratio, ["cluster_id", "signal_key"])


def _pairs(spark, sf):
    asked = I.ship_clusters(spark, sf)
    return evidence.change_keyword_match(
        evidence.change_overlap(asked, evidence.parsed_changes(I.changes(spark, sf)))
    )


@query
def change_overlap(spark, sf):
    return evidence.change_feed_signal(I.ship_clusters(spark, sf), _pairs(spark, sf)).select("cluster_id", "count")


@query
def change_samples(spark, sf):
    return evidence.change_samples(_pairs(spark, sf)).select("cluster_id", "rank", "id", "subject")


@query
def change_updates(spark, sf):
    return evidence.change_updates(I.ship_clusters(spark, sf), evidence.parsed_changes(I.changes(spark, sf)))


@query
def filter_changes(spark, sf):
    return landed.filter_changes(I.changes(spark, sf), "1996-03-01 00:00:00").select("id", "subject", "updated_at")


def _suppliers(spark, sf):
    key = F.col("s_suppkey")
    return I.table(spark, sf, "supplier").select(
        key.alias("ord"), F.concat(F.lit("man"), key.cast("string"), F.lit("-vdi")).alias("name"),
        F.concat(F.lit("Pool "), key.cast("string")).alias("display_name"), (key % 5).cast("int").alias("error_count"),
    )


def _customer_hints(spark, sf):
    key = F.col("c_custkey")
    return I.table(spark, sf, "customer").select(
        F.concat(F.lit("c"), key.cast("string")).alias("cluster_id"),
        F.when(key % 3 != 0, F.concat(F.lit("man"), (key % 150).cast("string"))).alias("pool_hint"),
    )


@query
def pool_errors(spark, sf):
    return evidence.pool_error_signal(_customer_hints(spark, sf), _suppliers(spark, sf)).select("cluster_id", "count")


@query
def resolve_pool(spark, sf):
    found = evidence.resolve_pool(_customer_hints(spark, sf), _suppliers(spark, sf))
    return found.select("cluster_id", F.coalesce("pool", F.lit("none")).alias("pool"))


@query
def aligned_pools(spark, sf):
    hints = I.hour_clusters(spark, sf).select("cluster_id", F.coalesce("pool", F.lit("pool 1")).alias("pool_hint"))
    return evidence.aligned_pools(_pool_counts(spark, sf), hints)


def _cluster_tickets(spark, sf):
    hour = F.date_trunc("hour", "created_at")
    t = I.event_tickets(spark, sf).withColumn(
        "cluster_id", F.concat_ws("@", "key", F.unix_seconds(hour).cast("string"))
    )
    return t.join(I.hour_clusters(spark, sf).select("cluster_id"), "cluster_id", "left_semi")


@query
def cluster_keywords(spark, sf):
    return evidence.cluster_keywords(I.hour_clusters(spark, sf), _cluster_tickets(spark, sf)).select(
        "cluster_id", joined(F.col("keywords")).alias("keywords")
    )


@query
def cluster_pool_hint(spark, sf):
    n = F.col("id")
    t = _cluster_tickets(spark, sf).withColumn(
        "description_text",
        F.when(n % 2 == 0, F.concat(F.lit("on GR"), (n % 30).cast("string"), F.lit("-vdi-7"))).otherwise("slow"),
    )
    return evidence.cluster_pool_hint(t)


def _snapshots(spark, sf):
    prod = F.when(F.col("user_id") % 2 == 0, " (Prod)").otherwise(" Test-Flight")
    return I.events(spark, sf).select(
        "event_id", F.concat("event_type", prod).alias("app"), F.col("ts").alias("observed_at"),
        F.concat(F.date_format(F.date_trunc("week", "ts"), "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT")).alias("last_modified"),
        F.get_json_object("props", "$.k").cast("int").alias("_k"),
    ).withColumn("version", F.concat(F.lit("1.0."), (F.col("_k") % 3).cast("string"))).drop("_k")


@query
def version_transitions(spark, sf):
    return evidence.version_transitions(_snapshots(spark, sf)).select(
        "event_id", "changed", F.coalesce("previous", F.lit("none")).alias("previous")
    )


@query
def version_change(spark, sf):
    found = evidence.version_change_signal(I.hour_clusters(spark, sf), _snapshots(spark, sf), "click")
    return found.select("cluster_id", "signal_key", "count")


@query
def vendor_signal(spark, sf):
    pages = I.table(spark, sf, "pages").select(F.col("url").alias("vendor"), "html")
    return evidence.vendor_status_signal(I.hour_clusters(spark, sf), pages).select("cluster_id", "count")


def _corroborated(spark, sf):
    asked = I.hour_clusters(spark, sf).withColumn(
        "metrics", evidence.pick_metrics(F.array("key"), EVENT_METRICS, EVENT_WORDS)
    )
    return evidence.corroborate(
        asked, I.logs(spark, sf), I.catalog(spark), app_logs=_app_logs(spark, sf), app="purchase",
        pages=I.table(spark, sf, "pages").select(F.col("url").alias("vendor"), "html"),
        points=I.events(spark, sf).select(F.col("event_type").alias("metric"), "ts", "value"),
        snapshots=_snapshots(spark, sf), app_word="click",
    )


@query
def corroborate(spark, sf):
    lines = F.transform(
        "evidence.signals",
        lambda s: F.concat_ws(":", s["key"], s["role"], s["count"].cast("string"), s["prior"].cast("string"), s["elevated"].cast("string")),
    )
    return _corroborated(spark, sf).select(
        "cluster_id", F.col("evidence.confidence").alias("confidence"), joined(lines).alias("signals"),
        joined(F.col("evidence.pools")).alias("pools"),
    )


# --- digests ----------------------------------------------------------------
def _digest_inputs(spark, sf):
    alerts = I.hour_clusters(spark, sf).select(
        F.xxhash64("cluster_id").alias("id"), "cluster_id", "key", "count", "first_ticket_id",
        F.col("window_end").alias("opened_at"),
    )
    return alerts, digest.alert_tickets(alerts, I.event_tickets(spark, sf))


@query
def digests(spark, sf):
    alerts, listed = _digest_inputs(spark, sf)
    notes = digest.compose_digest(alerts, listed)
    return notes.join(alerts.select(F.col("id").alias("alert_id"), "cluster_id"), "alert_id").select(
        "cluster_id", "part", "note"
    )


@query
def digest_parts(spark, sf):
    alerts, _ = _digest_inputs(spark, sf)
    listed = digest.alert_tickets(alerts, I.event_tickets(spark, sf), note_tickets=3)
    notes = digest.compose_digest(alerts, listed)
    return notes.join(alerts.select(F.col("id").alias("alert_id"), "cluster_id"), "alert_id").select(
        "cluster_id", "part", F.length("note").alias("chars")
    )


@query
def outbox(spark, sf):
    alerts, listed = _digest_inputs(spark, sf)
    rows = digest.alert_outbox(alerts, digest.compose_digest(alerts, listed))
    return rows.join(alerts.select(F.col("id").alias("alert_id"), "cluster_id"), "alert_id").select(
        "cluster_id", "cluster_key", "label", "count", "first_ticket_id", "parts", "note"
    )


@query
def outbox_tickets(spark, sf):
    alerts, listed = _digest_inputs(spark, sf)
    named = alerts.select(F.col("id").alias("alert_id"), "cluster_id")
    return digest.outbox_tickets(listed).join(named, "alert_id").select("cluster_id", "rank", "ticket_id", "part")


@query
def digest_evidence(spark, sf):
    """The opening note of every alert with its evidence section."""
    alerts, listed = _digest_inputs(spark, sf)
    ids = alerts.select("cluster_id", F.col("id").alias("_alert"))
    proof = _corroborated(spark, sf).join(ids, "cluster_id").drop("cluster_id").withColumnRenamed("_alert", "cluster_id")
    notes = digest.compose_digest(alerts, listed, proof).filter("part = 0")
    section = F.regexp_extract("note", "(?s)(<p><b>Corroborators.*)$", 1)
    return notes.join(alerts.select(F.col("id").alias("alert_id"), "cluster_id"), "alert_id").select(
        "cluster_id", section.alias("section")
    )


# --- streaming --------------------------------------------------------------
@query
def stream_replay(spark, sf):
    """The live path over landed event files, run to its end, read back from its sink."""
    I.configure(spark)
    folder = f"{I.scratch(spark)}/replay"
    # the events as ticket files: the type is the text that the rules match
    given = spark.read.parquet(f"{sf}/events.parquet")
    landed = given.select(
        F.col("event_id").alias("id"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("created_at"),
        F.col("event_type").alias("description_text"), F.col("event_type").alias("category"),
        (F.col("user_id") % 3).cast("string").alias("sub_category"),
    )
    landed.write.json(f"{folder}/landed")
    kinds = [r[0] for r in given.select("event_type").distinct().orderBy("event_type").collect()]
    kinds_as_rules = [D.Rule(k, k, (k,), 1) for k in kinds if k]
    tickets = live.ticket_stream(spark, f"{folder}/landed", rules=kinds_as_rules)
    end = I.events(spark, sf).agg(I.text_time(F.max("ts") + F.expr("interval 3 hours"))).first()[0]
    windows = live.live_windows(live.with_closing(tickets, f"{folder}/closing", end))
    run = live.start_monitor(
        windows, f"{folder}/out", f"{folder}/checkpoint", baseline=_baseline(spark, sf), trigger={"availableNow": True}
    )
    run.awaitTermination()
    fired = records.read_alerts(spark, f"{folder}/out")
    return fired.select(
        "key", I.text_time(F.col("opened_at")).alias("opened"), "count", "first_ticket_id", "status"
    )
