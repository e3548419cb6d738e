"""Small scalar rules: status, keys, boosts, outcomes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ticketmill import defaults as D
from ticketmill.functions.text import blank_to_null, strip_space


def is_terminal_status(status: Column) -> Column:
    return F.coalesce(F.trim(status.cast("string")).try_cast("int").isin(*D.TERMINAL_STATUSES), F.lit(False))


def system_key(category: Column, sub_category: Column) -> Column:
    """``category`` or ``category/sub`` in lower case; never used for detection."""
    main = F.lower(strip_space(F.coalesce(blank_to_null(category), F.lit("uncategorized"))))
    sub = F.lower(strip_space(F.coalesce(sub_category, F.lit(""))))
    return F.when(sub != "", F.concat(main, F.lit("/"), sub)).otherwise(main)


def feedback_outcome(resolved: Column) -> Column:
    return (
        F.when(resolved, "resolved").when(~resolved, "not_resolved").otherwise("unknown")
    )


def recency_boost(days: Column) -> Column:
    # fixed values: gentle decay by age
    return (
        F.when(days.isNull(), 1.0)
        .when(days <= 30, 1.15)
        .when(days <= 180, 1.05)
        .when(days <= 365, 1.0)
        .otherwise(0.9)
    )


def pool_hint(text: Column) -> Column:
    """Site code of a machine name such as ``MAN2-VDI-128``, lower case, else null."""
    return blank_to_null(F.lower(F.regexp_extract(text, r"(?iU)\b([A-Za-z]{2,}\d{1,2})-VDI-\d+", 1)))


def metadata_filter(
    category: str | None = None,
    sub_category: str | None = None,
    store: str | None = None,
    app: str | None = None,
    only_with_resolution: bool = True,
    exclude_ticket_id: int | None = None,
) -> Column:
    """Conjunction of the given constraints, applied before any scoring."""
    keep = F.lit(True)
    if only_with_resolution:
        keep &= F.col("has_resolution")
    if category:
        keep &= F.col("category") == category
    if sub_category:
        keep &= F.col("sub_category") == sub_category
    if store:
        keep &= F.array_contains("store", store)
    if app:
        keep &= F.array_contains("apps", app)
    if exclude_ticket_id is not None:
        keep &= F.col("ticket_id") != int(exclude_ticket_id)
    return keep
