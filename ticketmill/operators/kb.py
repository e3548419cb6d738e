"""Tickets and conversations to knowledge documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketmill import defaults as D
from ticketmill.functions import entities, times
from ticketmill.functions.once import compute_once
from ticketmill.functions.rules import is_terminal_status
from ticketmill.functions.text import (
    blank_to_null, clean_text, is_secret_only, redact, sanitize, strip_space,
)

_LAST = 2**63 - 1


def conversation_parts(convs: DataFrame) -> DataFrame:
    """The at most four texts of a ticket's conversations that a document uses.

    ``incoming_1``/``incoming_2``: the first two incoming entries in list order
    whose cleaned text is not empty. ``note``/``reply``: the last private note
    and the last public non-incoming reply by time (no time sorts first, ties go
    to the later position), among entries with raw text.

    The top-n is cut in every map task before the shuffle, so a ticket with any
    number of conversations sends a few rows only.
    """
    text = F.coalesce(blank_to_null(F.col("body_text")), blank_to_null(F.col("body")))
    private = F.coalesce("private", F.lit(False))
    incoming = F.coalesce("incoming", F.lit(False))
    rows = convs.select(
        "ticket_id",
        F.col("seq").cast("long").alias("seq"),
        F.coalesce(-F.unix_micros(times.parse_ts(F.col("created_at"))), F.lit(_LAST)).alias("late"),
        private.alias("private"), incoming.alias("incoming"), text.alias("text"),
    ).filter("text IS NOT NULL")
    rows = compute_once(rows, rows.columns, {"cleaned": F.when(F.col("incoming"), clean_text(F.col("text")))})
    late, back = F.col("late"), -F.col("seq")

    def part(cls: str, body: Column, o1: Column, o2: Column) -> Column:
        return F.struct(F.lit(cls).alias("cls"), body.alias("text"), o1.alias("o1"), o2.alias("o2"))

    # one struct per part the entry can serve as; a private incoming entry has two
    parts = F.array(
        part("incoming", F.col("cleaned"), F.col("seq"), F.lit(0).cast("long")),
        part("note", F.when(F.col("private"), F.col("text")), late, back),
        part("reply", F.when(~F.col("private") & ~F.col("incoming"), F.col("text")), late, back),
    )
    ranked = (
        rows.select("ticket_id", F.inline(parts))
        .filter("text <> ''")
        .withColumn("rn", F.row_number().over(Window.partitionBy("ticket_id", "cls").orderBy("o1", "o2")))
        .filter("rn <= 2")
        .filter("rn = 1 OR cls = 'incoming'")
    )

    def pick(cls: str, rn: int) -> Column:
        return F.max(F.when((F.col("cls") == cls) & (F.col("rn") == rn), F.col("text")))

    return ranked.groupBy("ticket_id").agg(
        pick("incoming", 1).alias("incoming_1"), pick("incoming", 2).alias("incoming_2"),
        pick("note", 1).alias("note"), pick("reply", 1).alias("reply"),
    )


def hydrate(tickets: DataFrame, convs: DataFrame) -> DataFrame:
    """Left join of each ticket to its conversation parts."""
    return tickets.join(
        conversation_parts(convs).withColumnRenamed("ticket_id", "id"), "id", "left"
    )


def with_texts(hydrated: DataFrame) -> DataFrame:
    """Add ``symptom``, ``resolution`` and ``resolution_source``.

    Symptom: cleaned description, then the first two incoming texts. Resolution:
    the first non-empty of field, note and reply; each is cleaned only where the
    one before it is empty.
    """
    base = hydrated.columns

    def raw_field(name: str) -> Column:
        value = F.col("custom_fields")[name]
        return F.when(~value.isin("", "[]"), value)

    described = F.coalesce(blank_to_null(F.col("description_text")), F.col("description"))
    found = compute_once(
        hydrated, base,
        {
            "_d": clean_text(described), "_f1": clean_text(raw_field("resolution")),
            "_f2": clean_text(raw_field("resolution_notes")),
        },
    ).withColumn("_f", F.coalesce(blank_to_null(F.col("_f1")), F.col("_f2")))
    found = compute_once(
        found, [*base, "_d", "_f"], {"_n": F.when(F.col("_f") == "", clean_text(F.col("note")))}
    )
    found = compute_once(
        found, [*base, "_d", "_f", "_n"], {"_p": F.when(F.col("_n") == "", clean_text(F.col("reply")))}
    )
    source = (
        F.when(F.col("_f") != "", "resolution_field").when(F.col("_n") != "", "private_note")
        .when(F.col("_p") != "", "reply").otherwise("unknown")
    )
    return found.select(
        *base,
        F.concat_ws("\n", blank_to_null(F.col("_d")), "incoming_1", "incoming_2").alias("symptom"),
        F.coalesce(
            blank_to_null(F.col("_f")), blank_to_null(F.col("_n")), F.col("_p"), F.lit("")
        ).alias("resolution"),
        source.alias("resolution_source"),
    )


def build_symptom(tickets: DataFrame, convs: DataFrame) -> DataFrame:
    return with_texts(hydrate(tickets, convs)).select("id", "symptom")


def build_resolution(tickets: DataFrame, convs: DataFrame) -> DataFrame:
    return with_texts(hydrate(tickets, convs)).select(
        "id", "resolution", F.col("resolution_source").alias("source")
    )


def qualifying(min_symptom_chars: int = D.MIN_SYMPTOM_CHARS, drop_secret_only: bool = True) -> Column:
    """Terminal status, a real symptom and a real fix, on cleaned unredacted text."""
    keep = (
        is_terminal_status(F.col("status"))
        & (F.length(strip_space(F.col("symptom"))) >= min_symptom_chars)
        & (strip_space(F.col("resolution")) != "")
    )
    return keep & ~is_secret_only(F.col("resolution")) if drop_secret_only else keep


def qualifies(
    df: DataFrame, min_symptom_chars: int = D.MIN_SYMPTOM_CHARS, drop_secret_only: bool = True
) -> DataFrame:
    """Filter rows that carry ``status``, ``symptom`` and ``resolution``."""
    return df.filter(qualifying(min_symptom_chars, drop_secret_only))


def link_documents(docs: DataFrame, links: DataFrame | None) -> DataFrame:
    """Left join of external document ids and urls on the string ticket id."""
    none = F.array().cast("array<string>")
    if links is None:
        return docs.withColumns({"linked_itglue_doc_ids": none, "linked_itglue_urls": none})
    named = links.select(
        F.col("ticket_id").cast("string").alias("id"),
        F.col("ids").alias("linked_itglue_doc_ids"), F.col("urls").alias("linked_itglue_urls"),
    )
    return docs.join(named, "id", "left").withColumns(
        {c: F.coalesce(c, none) for c in ("linked_itglue_doc_ids", "linked_itglue_urls")}
    )


def build_candidates(
    tickets: DataFrame, convs: DataFrame, min_symptom_chars: int = D.MIN_SYMPTOM_CHARS,
    drop_secret_only: bool = True,
) -> DataFrame:
    """Every hydrated ticket with its texts and the flag ``built``."""
    base = tickets.columns
    ok = F.col("id").isNotNull() & qualifying(min_symptom_chars, drop_secret_only)
    judged = compute_once(
        with_texts(hydrate(tickets, convs)), [*base, "symptom", "resolution", "resolution_source"], {"_ok": ok}
    )
    # redaction only for rows that qualify
    texts = compute_once(
        judged, [*base, "resolution_source"],
        {
            "symptom_text": F.when(F.col("_ok"), sanitize(F.col("symptom"))),
            "resolution_text": F.when(F.col("_ok"), sanitize(F.col("resolution"))),
        },
    )
    built = F.coalesce((F.col("symptom_text") != "") & (F.col("resolution_text") != ""), F.lit(False))
    return texts.withColumn("built", built)


def project_documents(
    candidates: DataFrame, links: DataFrame | None = None, redact_subject: bool = True,
    error_patterns: Sequence[str] = D.ERROR_CODE_PATTERNS,
    host_patterns: Sequence[str] | None = None,
    dictionary: Sequence[str] = D.APP_DICTIONARY,
) -> DataFrame:
    """Document columns for the built candidates."""
    subject = F.coalesce("subject", F.lit(""))
    closed = F.coalesce(blank_to_null(F.col("closed_at")), F.col("resolved_at"))
    times_ = compute_once(
        candidates.filter("built"), candidates.columns,
        {
            "_created": times.parse_ts(F.col("created_at")),
            "_closed": times.parse_ts(closed),
            "_updated": times.parse_ts(F.col("updated_at")),
        },
    )

    def id_or_name(key: str, name: str) -> Column:
        return F.coalesce(F.when(F.col(key) != 0, F.col(key).cast("string")), F.col(name))

    found = entities.enrich(
        F.col("symptom_text"), F.col("resolution_text"), error_patterns=error_patterns,
        host_patterns=host_patterns, dictionary=dictionary,
    )
    docs = times_.select(
        F.col("id").cast("string").alias("id"),
        F.col("id").cast("long").alias("ticket_id"),
        "display_id",
        (redact(subject) if redact_subject else subject).alias("subject"),
        "symptom_text", "resolution_text", "resolution_source",
        F.lit(True).alias("has_resolution"),
        "category", "sub_category", "item_category",
        id_or_name("department_id", "department").alias("department"),
        entities.normalize_store(F.col("custom_fields")).alias("store"),
        id_or_name("group_id", "group").alias("group"),
        F.coalesce(blank_to_null(F.col("type")), F.col("ticket_type")).alias("ticket_type"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        *[c.alias(n) for n, c in found.items()],
        F.col("_created").alias("created_at"),
        F.col("_closed").alias("closed_at"),
        F.col("_updated").alias("updated_at"),
        times.age_days(F.col("_created"), F.col("_closed")).alias("age_days"),
    )
    return link_documents(docs, links)


def build_documents(
    tickets: DataFrame, convs: DataFrame, links: DataFrame | None = None,
    min_symptom_chars: int = D.MIN_SYMPTOM_CHARS, drop_secret_only: bool = True, **projection,
) -> DataFrame:
    """Tickets that should be indexed, as knowledge documents.

    Tickets that are not terminal leave before the join, and only conversations
    of the others are ranked and cleaned.
    """
    ready = tickets.filter(F.col("id").isNotNull() & is_terminal_status(F.col("status")))
    own = convs.join(ready.select(F.col("id").alias("ticket_id")), "ticket_id", "left_semi")
    candidates = build_candidates(ready, own, min_symptom_chars, drop_secret_only)
    return project_documents(candidates, links, **projection)


def build_metrics(candidates: DataFrame) -> DataFrame:
    """Seen, built and dropped tickets and the newest update among the built ones."""
    newest = F.max(F.when(F.col("built"), times.parse_ts(F.col("updated_at"))))
    return candidates.agg(
        F.count("*").alias("tickets_seen"),
        F.count_if("built").alias("records_built"),
        F.count_if(~F.col("built")).alias("records_dropped"),
        newest.alias("newest_updated_at"),
    )


def upload_metrics(accepted: DataFrame, rejected: DataFrame) -> DataFrame:
    """Upload counts from the two sides of the dimension check."""
    both = accepted.select(F.lit(True).alias("ok")).unionAll(rejected.select(F.lit(False).alias("ok")))
    return both.agg(F.count_if("ok").alias("upload_ok"), F.count_if(~F.col("ok")).alias("upload_failed"))
