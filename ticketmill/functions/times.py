"""Time parsing and calendar slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Shape of an ISO-8601 date or date-time; the lax cast alone would also accept
# "2026" or "2026-9-1".
_ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d{1,6}\d*)?)?)?([zZ]|[+-]\d{2}(:?\d{2})?)?)?$"

_WHOLE = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"


def parse_ts(text: Column) -> Column:
    """ISO-8601 text to TIMESTAMP; no offset means UTC, anything else is null."""
    trimmed = F.trim(text)
    # bare hour, bare minute and comma fraction in the form the cast understands
    fixed = F.regexp_replace(trimmed, r"^(\d{4}-\d{2}-\d{2}[T ]\d{2})(?=$|[zZ+-])", "$1:00")
    fixed = F.regexp_replace(fixed, r"^(.{11}\d{2}:\d{2})(?=$|[zZ+-])", "$1:00")
    fixed = F.regexp_replace(fixed, ",", ".")
    # anchored: the time of an ISO text begins at its eleventh character
    fixed = F.regexp_replace(fixed, r"^(.{10}[T ].{2,30}[+-]\d{2})$", "$1:00")
    fixed = F.regexp_replace(fixed, "z$", "Z")

    def utc(text: Column) -> Column:
        has_zone = text.rlike(r"([Z]|[T ].*[+-]\d{2}:?\d{2})$")
        return F.when(has_zone, text).otherwise(
            F.when(text.rlike("[T ]"), F.concat(text, F.lit("Z"))).otherwise(F.concat(text, F.lit("T00:00:00Z")))
        )

    # as a lambda's argument the text is made once
    zoned = F.get(F.transform(F.array(fixed), utc), F.lit(0))
    # a whole date-time in UTC needs no mending
    return F.when(trimmed.rlike(_WHOLE), trimmed.try_cast("timestamp")).when(
        trimmed.rlike(_ISO), zoned.try_cast("timestamp")
    )


def iso(ts: Column) -> Column:
    """UTC text with seconds and ``Z``."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def age_days(created: Column, closed: Column) -> Column:
    """Whole days from creation to closing, at least 0, null if either is null."""
    span = (F.unix_micros(closed) - F.unix_micros(created)) / F.lit(86_400_000_000)
    return F.when(span.isNotNull(), F.greatest(F.lit(0), F.floor(span).cast("int")))


def http_date_age_hours(text: Column, now: Column) -> Column:
    """Hours from an RFC-1123 date to ``now``; bad dates are null."""
    day_month = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3,9},\s*", "")
    padded = F.regexp_replace(day_month, r"^(\d) ", "0$1 ")
    dated = F.when(
        padded.rlike(r"^\d{2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2} [A-Z]{3}$"),
        F.try_to_timestamp(padded, F.lit("dd MMM yyyy HH:mm:ss z")),
    )
    return (F.unix_micros(now) - F.unix_micros(dated)) / F.lit(3_600_000_000)


def local_time(ts: Column, tz: str) -> Column:
    """Wall clock of ``tz``; the session zone must be UTC."""
    return F.from_utc_timestamp(ts, tz)


def slot(ts: Column, tz: str) -> tuple[Column, Column]:
    """(weekday with Monday = 0, hour) of the local wall clock."""
    local = local_time(ts, tz)
    return F.weekday(local), F.hour(local)


def week_starts(now: Column, weeks: int, tz: str) -> Column:
    """Mondays of the ISO weeks that the trailing ``weeks*7+1`` local days touch."""
    last = F.to_date(F.date_trunc("week", local_time(now, tz)))
    return F.sequence(F.date_sub(last, weeks * 7), last, F.expr("interval 7 days"))


def week_set(spark: SparkSession, now: str, weeks: int, tz: str) -> DataFrame:
    """The trailing ISO weeks as rows ``(week_start, iso_year, iso_week)``."""
    at = F.lit(now).cast("timestamp")
    monday = F.col("week_start")
    return (
        spark.range(1)
        .select(F.explode(week_starts(at, weeks, tz)).alias("week_start"))
        .select(
            "week_start",
            F.extract(F.lit("YEAROFWEEK"), monday).alias("iso_year"),
            F.weekofyear(monday).alias("iso_week"),
        )
    )
