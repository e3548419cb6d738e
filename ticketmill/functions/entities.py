"""Entity extraction: error codes, host names, applications, store lists."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ticketmill import defaults as D
from ticketmill.functions.text import strip_space


def dedupe_ci(values: Column) -> Column:
    """Trim, drop empties, keep the first spelling of each value ignoring case."""
    # exact repeats go first by hash; the spellings of a value then lie side by side
    kept = F.array_distinct(F.filter(F.transform(values, strip_space), lambda v: v != ""))
    placed = F.sort_array(F.transform(kept, lambda v, i: F.struct(F.lower(v).alias("low"), i.alias("i"), v.alias("v"))))

    def firsts(row: Column) -> Column:
        new = F.filter(row, lambda s, n: (n == 0) | (F.get(row, n - 1)["low"] != s["low"]))
        return F.transform(F.sort_array(F.transform(new, lambda s: F.struct(s["i"], s["v"]))), lambda s: s["v"])

    # a lambda's argument is made once, other expressions anew for every element
    return F.get(F.transform(F.array(placed), firsts), F.lit(0))


def _all_matches(text: Column, patterns: Iterable[str]) -> Column:
    found = []
    for pattern in patterns:
        # group 1 when the pattern captures, else the whole match
        group = 1 if "(" in pattern.replace("(?", "") else 0
        found.append(F.regexp_extract_all(text, F.lit("(?U)" + pattern), F.lit(group)))
    return F.concat(*found)


def _extract(texts: Sequence[Column], patterns: Iterable[str]) -> Column:
    patterns = tuple(patterns)
    per_text = [_all_matches(F.coalesce(t, F.lit("")), patterns) for t in texts]
    return dedupe_ci(F.concat(*per_text))


def extract_error_codes(*texts: Column, patterns: Sequence[str] = D.ERROR_CODE_PATTERNS) -> Column:
    return _extract(texts, patterns)


def extract_hostnames(*texts: Column, patterns: Sequence[str] | None = None) -> Column:
    return _extract(texts, patterns or D.hostname_patterns())


def extract_apps(*texts: Column, dictionary: Sequence[str] = D.APP_DICTIONARY) -> Column:
    """Dictionary words found anywhere in the lower-cased text, dictionary order."""
    hay = F.lower(F.concat_ws(" ", *texts))
    hits = F.array(*[F.when(F.contains(hay, F.lit(w)), F.lit(w)) for w in dict.fromkeys(dictionary)])
    return F.array_compact(hits)


def enrich(
    *texts: Column,
    error_patterns: Sequence[str] = D.ERROR_CODE_PATTERNS,
    host_patterns: Sequence[str] | None = None,
    dictionary: Sequence[str] = D.APP_DICTIONARY,
) -> dict[str, Column]:
    """The three entity columns, for ``withColumns``."""
    return {
        "error_codes": extract_error_codes(*texts, patterns=error_patterns),
        "hostnames": extract_hostnames(*texts, patterns=host_patterns),
        "apps": extract_apps(*texts, dictionary=dictionary),
    }


def normalize_store(custom_fields: Column) -> Column:
    """First non-empty of three fields; a JSON list or a comma-separated string."""
    empty = ("", "[]")
    raw = F.coalesce(
        *[
            F.when(~custom_fields[k].isin(*empty), custom_fields[k])
            for k in ("msf_store", "store", "location")
        ]
    )
    as_list = F.from_json(raw, "array<string>")
    # an unreadable list keeps its text and is split like any other string
    listed = F.when(F.startswith(raw, F.lit("[")) & as_list.isNotNull(), as_list)
    parts = F.coalesce(listed, F.split(raw, ","))
    trimmed = F.transform(parts, strip_space)
    return F.coalesce(F.filter(trimmed, lambda v: v != ""), F.array().cast("array<string>"))
