"""Read schemas (never inferred) and the document schema with field roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TICKETS = """
  id BIGINT, display_id STRING, status STRING, subject STRING, description_text STRING,
  description STRING, custom_fields MAP<STRING,STRING>, category STRING, sub_category STRING,
  item_category STRING, department_id BIGINT, department STRING, group_id BIGINT,
  `group` STRING, type STRING, ticket_type STRING, tags ARRAY<STRING>, created_at STRING,
  closed_at STRING, resolved_at STRING, updated_at STRING
"""
CONVERSATIONS = """
  ticket_id BIGINT, seq INT, private BOOLEAN, incoming BOOLEAN, body_text STRING,
  body STRING, created_at STRING
"""
INLINE_CONVERSATIONS = """
  id BIGINT, conversations ARRAY<STRUCT<private: BOOLEAN, incoming: BOOLEAN,
  body_text: STRING, body: STRING, created_at: STRING>>
"""
CHANGES = """
  id BIGINT, subject STRING, description_text STRING, status STRING, risk STRING,
  planned_start_date STRING, planned_end_date STRING, impacted_services ARRAY<STRING>,
  updated_at STRING
"""
LOG_EVENTS = """
  stream STRING, timestamp TIMESTAMP, source STRING, event_type STRING, desktop_id STRING,
  desktop STRING, user STRING, severity STRING, date DATE
"""
APP_LOGS = """
  Timestamp TIMESTAMP, Level STRING, RenderedMessage STRING, Id STRING, EventType STRING,
  Properties ARRAY<STRUCT<Name: STRING, Value: STRING>>
"""
CATALOG = """
  streams MAP<STRING, STRUCT<id: STRING, name: STRING, plane: STRING>>,
  fields MAP<STRING, MAP<STRING, STRING>>,
  signals ARRAY<STRUCT<key: STRING, role: STRING, stream: STRING, `any`: ARRAY<STRING>,
    event_field: STRING, display_fields: ARRAY<STRING>, note: STRING>>,
  excluded_high_volume ARRAY<STRUCT<event: STRING, why: STRING>>,
  saas_status ARRAY<STRUCT<vendor: STRING, url: STRING>>,
  engage_versions ARRAY<STRUCT<name: STRING, url: STRING>>
"""
GOLD = """
  query_ticket_id BIGINT, query_text STRING, expected_ticket_ids ARRAY<BIGINT>,
  category STRING, sub_category STRING, store ARRAY<STRING>, labeled BOOLEAN, fix_key STRING,
  expected_count BIGINT
"""
FEEDBACK = """
  ticket_id BIGINT, suggested_ticket_id BIGINT, rank INT, accepted BOOLEAN, resolved BOOLEAN,
  agent STRING, note STRING, at TIMESTAMP, kind STRING, alert_id BIGINT, verdict STRING,
  cluster_key STRING, seq BIGINT
"""
EVIDENCE = (
    "STRUCT<confidence: STRING, signals: ARRAY<STRUCT<key: STRING, role: STRING, count: BIGINT,"
    " prior: BIGINT, elevated: BOOLEAN>>, pools: ARRAY<STRING>>"
)
ALERTS = f"""
  id BIGINT, key STRING, first_ticket_id BIGINT, opened_at TIMESTAMP, count BIGINT,
  status STRING, cooldown_until TIMESTAMP, evidence {EVIDENCE}
"""
OUTBOX = {
    "outbox": "alert_id BIGINT, cluster_key STRING, label STRING, count BIGINT, first_ticket_id BIGINT, parts INT, note STRING",
    "outbox_tickets": "alert_id BIGINT, rank BIGINT, ticket_id BIGINT, part INT",
    "notes": "alert_id BIGINT, part INT, note STRING",
}
BASELINE = """
  key STRING, dow INT, hour INT, n INT, median DOUBLE, mad DOUBLE, updated_at TIMESTAMP
"""
LIVE_TICKETS = """
  id BIGINT, created_at STRING, subject STRING, description_text STRING, description STRING,
  category STRING, sub_category STRING, status STRING
"""

# Columns the lexical index covers.
SEARCHABLE = ("subject", "symptom_text", "resolution_text")


def kb_schema(dimensions: int) -> T.StructType:
    """The knowledge document: types plus role metadata per field."""
    text, ids = T.StringType(), T.ArrayType(T.StringType())
    f, c, s = "filterable", "facetable", "sortable"
    q, r = "searchable", "retrievable"
    # fixed values: field order, types and roles
    fields = [
        ("id", text, ("key", f)),
        ("ticket_id", T.LongType(), (f, s, c)),
        ("display_id", text, (f, r)),
        ("subject", text, (q, r)),
        ("symptom_text", text, (q, r)),
        ("resolution_text", text, (q, r)),
        ("resolution_source", text, (f, c, r)),
        ("has_resolution", T.BooleanType(), (f, r)),
        ("category", text, (f, c, r)),
        ("sub_category", text, (f, c, r)),
        ("item_category", text, (f, c, r)),
        ("department", text, (f, c, r)),
        ("store", ids, (f, c, r)),
        ("group", text, (f, c, r)),
        ("ticket_type", text, (f, c, r)),
        ("tags", ids, (f, c, r)),
        ("error_codes", ids, (f, c, r)),
        ("hostnames", ids, (f, c, r)),
        ("apps", ids, (f, c, r)),
        ("created_at", T.TimestampType(), (f, s, r)),
        ("closed_at", T.TimestampType(), (f, s, r)),
        ("updated_at", T.TimestampType(), (f, s, r)),
        ("age_days", T.IntegerType(), (f, s, r)),
        ("linked_itglue_doc_ids", ids, (f, r)),
        ("linked_itglue_urls", ids, (r,)),
        ("symptom_vector", T.ArrayType(T.FloatType()), (q,)),
        ("resolution_vector", T.ArrayType(T.FloatType()), (q,)),
    ]
    return T.StructType(
        [
            T.StructField(
                name, dtype, True,
                {"roles": list(roles)} | ({"dimensions": dimensions} if "vector" in name else {}),
            )
            for name, dtype, roles in fields
        ]
    )


def facetable_fields() -> list[str]:
    return [f.name for f in kb_schema(0).fields if "facetable" in f.metadata["roles"]]


def vector_fits(vector: Column, dimensions: int) -> Column:
    """A vector is either not there yet or has exactly ``dimensions`` values."""
    return F.coalesce(F.size(vector).isin(0, dimensions), F.lit(True))


def split_by_dimensions(
    docs: DataFrame, dimensions: int, vectors: tuple[str, ...] = ("symptom_vector", "resolution_vector")
) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) documents by the vector dimension check."""
    fits = F.lit(True)
    for name in vectors:
        fits &= vector_fits(F.col(name), dimensions)
    return docs.filter(fits), docs.filter(~fits)
