"""Text cleaning and redaction as native column expressions.

Every pattern carries ``(?U)`` so that ``\\s``, ``\\w``, ``\\d`` and ``\\b`` are
Unicode-aware. Cleaning works on the whole text with line-anchored patterns
instead of an array of lines, so it stays inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ticketmill import defaults as D

# fixed values: white space (Unicode, with the four information separators) and
# line breaks other than the newline
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + (
    "\u2028\u2029\u202f\u205f\u3000"
)
_WS = (
    r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
_BLANK = rf"[{_WS}&&[^\n]]"
_BREAK = r"[\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
# A run of white space that ends in a newline. The look-behind comes after the
# first character, so it is only tried on white space, and it admits only the
# start of a run, so long runs stay linear.
_LINE_END = rf"[{_WS}](?<![{_WS}][{_WS}])[{_WS}]*\n"

_TAG = r"<[^>]+>"
_SECRET = (
    r"(?iU)\b(?:" + "|".join(D.SECRET_LABELS) + r")\b\s*[:=]\s*(?!<redacted)[^" + _WS + r"]+"
)

# fixed values: lines that open a quoted reply
_QUOTE_LINES = (
    rf"on [^\n]{{0,80}}\bwrote:{_BLANK}*(?=\n|\z)",
    rf"-{{2,}}{_BLANK}*original message{_BLANK}*-{{2,}}{_BLANK}*(?=\n|\z)",
    rf"from:{_BLANK}[^\n]+",
    rf"_{{5,}}{_BLANK}*(?=\n|\z)",
)
# fixed values: lines that open a signature
_SIGNATURE_LINES = (
    rf"(?:thanks|thank you|regards|best|sincerely|cheers)[,!.{_WS}&&[^\n]]*(?=\n|\z)",
    r"(?:sent from my|get outlook for)\b",
    rf"[-_]{{2,}}{_BLANK}*(?=\n|\z)",
    r"(?:this email|the information contained|confidentiality notice|disclaimer)\b",
)
# fixed values: greeting lines without content
_OPENER_LINE = (
    r"(?:hello|hi|hey|good morning|good afternoon)[ ,][^\n]{0,60}?"
    r"(?:thank you for contacting|thanks for contacting)[^\n]*"
)


def _from_first(lines: tuple[str, ...]) -> str:
    """Pattern for everything from the first line that starts with one of ``lines``."""
    return rf"(?iU)(?:^|\n){_BLANK}*(?:{'|'.join(lines)})[\S\s]*"


_QUOTE_TAIL = _from_first(_QUOTE_LINES)
_SIGNATURE_TAIL = _from_first(_SIGNATURE_LINES)
_OPENER = rf"(?iU)(?:^|\n){_BLANK}*{_OPENER_LINE}"


def strip_html(text: Column) -> Column:
    """Tags become spaces, then six entities are decoded in fixed order."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), _TAG, " ")
    for entity, char in D.HTML_ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def strip_space(text: Column) -> Column:
    """Trim Unicode white space from both ends."""
    return F.btrim(text, F.lit(SPACES))


def clean_text(text: Column) -> Column:
    """Drop HTML, blank lines, quoted replies, signatures and greeting lines."""
    out = F.replace(strip_html(text), F.lit("\r\n"), F.lit("\n"))
    out = F.rtrim(F.regexp_replace(out, _BREAK, "\n"), F.lit(SPACES))
    out = F.regexp_replace(out, _LINE_END, "\n")
    out = F.regexp_replace(out, _QUOTE_TAIL, "")
    out = F.regexp_replace(out, _SIGNATURE_TAIL, "")
    out = F.regexp_replace(out, _OPENER, "")
    return strip_space(out)


def redact(text: Column, contacts: bool = True) -> Column:
    """Replace keys, labelled secrets and (optionally) contact data by markers."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), "(?U)" + D.GUID, D.KEY_MARK)
    out = F.regexp_replace(out, _SECRET, D.SECRET_MARK)
    if contacts:
        out = F.regexp_replace(out, "(?U)" + D.EMAIL, D.EMAIL_MARK)
        out = F.regexp_replace(out, "(?U)" + D.PHONE, D.PHONE_MARK)
    return out


def contains_secret(text: Column) -> Column:
    return F.coalesce(text.rlike(_SECRET) | text.rlike("(?U)" + D.GUID), F.lit(False))


def sanitize(text: Column) -> Column:
    return redact(clean_text(text))


def is_secret_only(text: Column) -> Column:
    """A secret is present and fewer than 20 word characters remain without it."""
    rest = redact(text)
    for mark in (D.SECRET_MARK, D.KEY_MARK):
        rest = F.replace(rest, F.lit(mark), F.lit(""))
    return contains_secret(text) & (F.length(F.regexp_replace(rest, r"[^\p{L}\p{N}_]+", "")) < 20)


def normalize(text: Column) -> Column:
    """Lower case, runs of anything but ``a-z0-9`` become one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def resolution_signature(text: Column, chars: int | None = None) -> Column:
    """Word characters only, lower case: equal fixes share it. ``chars`` compares only so many of them."""
    squeezed = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+", "")
    return squeezed if chars is None else F.substring(squeezed, 1, chars)


def blank_to_null(text: Column) -> Column:
    return F.when(text != "", text)
