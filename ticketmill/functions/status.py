"""Vendor status pages and application manifests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ticketmill.functions.text import blank_to_null, strip_html

_COMMENT = r"(?s)<!--.*?-->"
# fixed values: the two phrases a status banner can carry
_STATUS = r"status is (up|down|degraded)"
_TROUBLE = r"is experiencing (?:issues|an outage|degraded|service degradation)(?!\?)"
_BANNER = rf"(?iU)(<h[12][^>]*>[^<]*?(?:{_STATUS}|{_TROUBLE})[^<]*?</h[12]>)"
_CHECKED = r'(?iU)<time[^>]*dateTime="([^"]+)"'
_CHECKED_TEXT = r"(?U)Last checked[:\s]*([0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9:.]+Z)"


def _segment_status(text: Column) -> Column:
    word = F.lower(F.regexp_extract(text, "(?iU)" + _STATUS, 1))
    return (
        F.when(word == "up", "up")
        .when(word != "", "issues")
        .when(text.rlike("(?iU)" + _TROUBLE), "issues")
        .otherwise("unknown")
    )


def parse_status_banner(html: Column) -> Column:
    """``struct(status, checked)``: the heading banner first, else the whole page's text."""
    page = F.regexp_replace(F.coalesce(html, F.lit("")), _COMMENT, "")
    banner = _segment_status(strip_html(F.regexp_extract(page, _BANNER, 1)))
    body = _segment_status(strip_html(page))
    checked = F.coalesce(
        blank_to_null(F.regexp_extract(page, _CHECKED, 1)),
        blank_to_null(F.regexp_extract(page, _CHECKED_TEXT, 1)),
    )
    return F.struct(
        F.when(banner != "unknown", banner).otherwise(body).alias("status"),
        checked.alias("checked"),
    )


def manifest_version(body: Column) -> Column:
    """Version of the assembly identity, else any four-part version."""
    return F.coalesce(
        blank_to_null(
            F.regexp_extract(body, r'assemblyIdentity[^>]*version="([0-9][0-9.]*)"', 1)
        ),
        blank_to_null(F.regexp_extract(body, r'version="([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)"', 1)),
    )
