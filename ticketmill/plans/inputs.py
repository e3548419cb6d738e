"""The given tables seen as tickets, conversations, documents, feedback and logs.

Each view is a plain projection; the oracles repeat it in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketmill import defaults as D
from ticketmill.functions.rules import system_key
from ticketmill.operators.feedback import boost_table, suggestion_stats
from ticketmill.session import configure, scratch_folder as scratch

NOW = "2024-01-15 12:00:00"

# Rules over words that occur in the given prose.
RULES = (
    D.Rule("w:that", "That", ("that",), 90),
    D.Rule("w:with", "With", ("with", "this"), 70),
    D.Rule("p:of-the", "Of the", ("of the", "and the"), 70),
    D.Rule("w:from", "From", ("from",), 40),
)
WORDS = ("that", "tion", "with", "from", "zzz")
CODE_PATTERNS = ("tion[a-z]{1,3}", "(?i)th([a-z]{3})")
HOST_PATTERNS = ("[A-Z][a-z]{2}er", "[a-z]{3}the")


TEXT_TABLES = ("documents", "conversations", "pages")
_FEW = 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; the text tables are spread over the cores when they are small."""
    df = configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


def spread(df: DataFrame) -> DataFrame:
    """Redistribute a file scan of a few splits before expensive text expressions.

    A scan of at least ``_FEW`` splits (about 4 GB) or one per core is left as
    it is: at scale the files themselves give the parallelism, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= min(cores, _FEW) else df.repartition(cores)


def text_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def iso_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


# --- conversations as tickets ----------------------------------------------
def conv_start(conv_id: Column) -> Column:
    return F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(hours=conv_id.cast("int"))


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ticket per conversation; its first user turn is the description."""
    user = F.col("role") == "user"
    grouped = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.min(F.when(user, F.struct("turn", "text"))).alias("d"), F.max("turn").alias("turns")
    )
    cid = F.col("conv_id")
    start = conv_start(cid)
    fix = F.when(
        cid % 7 == 0, F.concat(F.lit("Replaced the cable of desk "), cid.cast("string"), F.lit(" and restarted it."))
    ).otherwise("")
    return grouped.select(
        cid.alias("id"),
        F.concat(F.lit("T-"), cid.cast("string")).alias("display_id"),
        F.when(cid % 5 == 0, "2").otherwise("4").alias("status"),
        F.concat(F.lit("Ticket "), cid.cast("string")).alias("subject"),
        F.col("d.text").alias("description_text"),
        F.lit(None).cast("string").alias("description"),
        F.create_map(
            F.lit("resolution"), fix,
            F.lit("store"), F.concat((cid % 3).cast("string"), F.lit("-A, "), (cid % 4).cast("string"), F.lit("-B")),
        ).alias("custom_fields"),
        F.concat(F.lit("cat"), (cid % 4).cast("string")).alias("category"),
        F.when(cid % 3 != 0, F.concat(F.lit("Sub "), (cid % 3).cast("string"))).alias("sub_category"),
        F.lit(None).cast("string").alias("item_category"),
        F.when(cid % 2 == 0, cid % 6).alias("department_id"),
        F.lit("Sales").alias("department"),
        F.lit(None).cast("bigint").alias("group_id"),
        F.lit("Desk").alias("group"),
        F.lit("").alias("type"), F.lit("Incident").alias("ticket_type"),
        F.array(F.lit("kb")).alias("tags"),
        iso_text(start).alias("created_at"),
        F.lit(None).cast("string").alias("closed_at"),
        iso_text(start + F.make_dt_interval(hours=((cid % 9) * 20).cast("int"))).alias("resolved_at"),
        iso_text(start + F.make_dt_interval(mins=F.col("turns").cast("int"))).alias("updated_at"),
    )


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later user turns incoming, assistant turns public replies, system turns notes."""
    turns = table(spark, sf_dir, "conversations")
    first = (
        turns.filter("role = 'user'").groupBy(F.col("conv_id").alias("c")).agg(F.min("turn").alias("first"))
    )
    return (
        turns.join(first, F.col("conv_id") == F.col("c"), "left")
        .filter("role <> 'user' OR turn > first")
        .select(
            F.col("conv_id").alias("ticket_id"), F.col("turn").cast("int").alias("seq"),
            (F.col("role") == "system").alias("private"), (F.col("role") == "user").alias("incoming"),
            F.col("text").alias("body_text"), F.lit(None).cast("string").alias("body"),
            iso_text(conv_start(F.col("conv_id")) + F.make_dt_interval(mins=F.col("turn").cast("int"))).alias("created_at"),
        )
    )


# --- events as live tickets, logs, metrics and feedback ---------------------
def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def event_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One keyed live ticket per event."""
    return events(spark, sf_dir).select(
        F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.col("event_type").alias("key"),
        F.concat(F.lit("event "), F.col("event_id").cast("string"), F.lit(" <"), F.col("event_type"), F.lit(">"))
        .alias("subject"),
        F.col("event_type").alias("category"), (F.col("user_id") % 3).cast("string").alias("sub_category"),
        system_key(F.col("event_type"), (F.col("user_id") % 3).cast("string")).alias("system_key"),
    )


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(
        "event_id", F.lit("horizon").alias("stream"), F.col("ts").alias("timestamp"),
        F.concat(F.lit("host"), (F.col("user_id") % 5).cast("string")).alias("source"), "event_type",
        F.concat(F.lit("p"), (F.col("user_id") % 4).cast("string")).alias("desktop_id"),
        F.concat(F.lit("Pool "), (F.col("user_id") % 4).cast("string")).alias("desktop"),
        F.col("user_id").cast("string").alias("user"), F.lit("INFO").alias("severity"),
    )


CATALOG_ROWS = [
    (0, "log.signup", "cause", "horizon", "event_type", "signup"),
    (1, "log.error", "effect", "horizon", "event_type", "error"),
    (1, "log.error", "effect", "horizon", "event_type", "purchase"),
]


def catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        CATALOG_ROWS, "ord int, key string, role string, stream string, field string, value string"
    )


def hour_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours with at least five events of a type."""
    hour = F.date_trunc("hour", "created_at")
    at = F.unix_seconds("window_start")
    return (
        event_tickets(spark, sf_dir).groupBy("key", hour.alias("window_start"))
        .agg(F.count("*").alias("count"), F.min(F.struct("created_at", "id")).alias("f"))
        .filter("count >= 5")
        .select(
            F.concat_ws("@", "key", at.cast("string")).alias("cluster_id"), "key", "count",
            "window_start", (F.col("window_start") + F.expr("interval 1 hour")).alias("window_end"),
            F.col("f.id").alias("first_ticket_id"),
            F.when((at / 3600).cast("long") % 2 == 0, F.concat(F.lit("p"), ((at / 3600).cast("long") % 4).cast("string")))
            .alias("pool"),
        )
    )


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(
        (F.col("event_id") % 500).alias("ticket_id"), F.col("user_id").alias("suggested_ticket_id"),
        F.lit(1).alias("rank"), F.col("event_type").isin("purchase", "click").alias("accepted"),
        F.when(F.col("event_type") != "view", F.col("value") > 10).alias("resolved"),
        F.lit(None).cast("string").alias("agent"), F.lit(None).cast("string").alias("note"),
        F.col("ts").alias("at"),
        F.when(F.col("event_type") == "error", "cluster").otherwise("retrieval").alias("kind"),
        F.lit(None).cast("bigint").alias("alert_id"), F.lit(None).cast("string").alias("verdict"),
        F.lit(None).cast("string").alias("cluster_key"), F.col("event_id").alias("seq"),
    )


# --- documents as the knowledge base ---------------------------------------
def kb_docs(spark: SparkSession, sf_dir: str, vectors: bool = False) -> DataFrame:
    doc = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select(
        doc.cast("string").alias("id"), doc.alias("ticket_id"),
        F.concat(F.lit("T-"), doc.cast("string")).alias("display_id"), F.lit("").alias("subject"),
        F.col("text").alias("symptom_text"), F.col("text").alias("resolution_text"),
        F.lit("reply").alias("resolution_source"), (doc % 10 != 0).alias("has_resolution"),
        F.col("lang").alias("category"), F.lit(None).cast("string").alias("sub_category"),
        F.array("source").alias("store"), F.array(F.lit("outlook")).alias("apps"),
        F.array().cast("array<string>").alias("error_codes"), (doc % 500).cast("int").alias("age_days"),
        F.array().cast("array<string>").alias("linked_itglue_urls"),
    )
    if not vectors:
        return docs
    vecs = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("ticket_id"), F.col("embedding").alias("symptom_vector")
    )
    return docs.join(vecs, "ticket_id", "left")


def queries(spark: SparkSession, sf_dir: str, vectors: bool = False) -> DataFrame:
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    if not vectors:
        return q
    vecs = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")
    )
    return q.join(vecs, "query_id", "left")


def boosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boost_table(suggestion_stats(feedback(spark, sf_dir)))


def vector_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("ticket_id"), F.col("embedding").alias("symptom_vector"), "label"
    )


def vector_gold(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Gold items and members: the label is the fix group."""
    vecs = table(spark, sf_dir, "embeddings")
    members = vecs.select(F.col("label").cast("string").alias("fix_key"), F.col("vec_id").alias("ticket_id"))
    sizes = members.groupBy("fix_key").agg(F.count("*").alias("expected_count"))
    gold = members.join(sizes, "fix_key").select(
        F.col("ticket_id").alias("query_ticket_id"),
        F.concat(F.lit("vector "), F.col("ticket_id").cast("string")).alias("query_text"),
        F.lit(None).cast("array<bigint>").alias("expected_ticket_ids"), "fix_key", "expected_count",
    )
    return gold, members


# --- orders and lineitem as changes, alerts and verdicts --------------------
def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("o_orderdate").cast("timestamp")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("subject"),
        F.lit(None).cast("string").alias("description_text"),
        F.lit("Closed").alias("status"), F.lit("Low").alias("risk"),
        iso_text(start).alias("planned_start_date"),
        iso_text(start + F.expr("interval 2 days")).alias("planned_end_date"),
        F.array(F.concat(F.lit("svc "), F.col("o_orderstatus"))).alias("impacted_services"),
        iso_text(start).alias("updated_at"),
    )


def ship_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ship days with at least twenty lines; odd days look for two keywords."""
    day = F.col("l_shipdate").cast("timestamp")
    number = F.date_diff("window_start", F.lit("1992-01-01").cast("date"))
    return (
        table(spark, sf_dir, "lineitem").groupBy(day.alias("window_start")).agg(F.count("*").alias("count"))
        .filter("count >= 20")
        .select(
            F.concat(F.lit("ship@"), F.date_format("window_start", "yyyy-MM-dd")).alias("cluster_id"),
            F.lit("ship").alias("key"), "count", "window_start",
            (F.col("window_start") + F.expr("interval 1 hour")).alias("window_end"),
            F.when(number % 2 == 1, F.array(F.lit("urgent"), F.lit("svc f")))
            .otherwise(F.array().cast("array<string>")).alias("keywords"),
        )
    )


def order_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    opened = F.col("o_orderdate").cast("timestamp")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("key"),
        F.col("o_custkey").alias("first_ticket_id"), opened.alias("opened_at"), F.lit(3).cast("bigint").alias("count"),
        F.lit("open").alias("status"), (opened + F.expr("interval 2 hours")).alias("cooldown_until"),
    )


def line_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("alert_id"),
        F.when(flag == "A", "accept").when(flag == "R", "reject").otherwise("unsure").alias("verdict"),
        (F.col("l_linestatus") == "F").alias("close"), F.col("l_shipdate").cast("timestamp").alias("at"),
        F.col("l_linenumber").cast("bigint").alias("seq"),
    )
