"""WARC derivatives: metadata and plain-text conversion records of response records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketmill.functions.once import compute_once
from ticketmill.llm.common import prepare

CRLF = "\r\n"
VERSION = "WARC/1.1"
# Fields of a response record, the input of ``derivatives``.
RESPONSE = "record_id string, target_uri string, warc_date string, block string"
# Elements whose content is not text, elements that end a line, and the named
# characters that are decoded (numbers are decoded too), the ampersand last.
HIDDEN = ("script", "style", "noscript", "template", "nav", "head")
BREAKING = ("p", "div", "br", "li", "ul", "ol", "tr", "table", "h[1-6]", "article", "section", "header", "footer", "pre", "blockquote")
NAMED = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&amp;": "&"}


def urn(*parts: Column) -> Column:
    """A record id made from its parts: the same record always gets the same id."""
    h = F.md5(F.concat_ws("|", *parts).cast("binary"))
    cuts = [F.substring(h, at, size) for at, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def plain_text(html: Column) -> Column:
    """Visible text: hidden elements and comments dropped, block elements end lines, characters decoded, blanks squeezed."""
    text = F.regexp_replace(html, "(?s)<!--.*?(?:-->|$)", " ")
    text = F.regexp_replace(text, rf"(?is)<({'|'.join(HIDDEN)})\b[^<>]*>.*?(?:</\1\s*>|$)", " ")
    text = F.regexp_replace(text, rf"(?i)</?(?:{'|'.join(BREAKING)})\b[^<>]*>", "\n")
    text = F.regexp_replace(text, "<[A-Za-z/!?][^>]*(?:>|$)", " ")
    for name, c in NAMED.items():
        text = F.replace(text, F.lit(name), F.lit(c))
    text = F.regexp_replace(text, "[ \t\r ]+", " ")
    return F.regexp_replace(F.regexp_replace(text, " ?\n[ \n]*", "\n"), "^[ \n]+|[ \n]+$", "")


def title(html: Column) -> Column:
    return F.regexp_extract(html, "(?is)<title[^<>]*>([^<]*)", 1)


def fields(*pairs: tuple[str, Column]) -> Column:
    """Named fields, one per line; those with a null value are left out."""
    lines = [F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)) for name, value in pairs]
    return F.concat(*[F.coalesce(line, F.lit("")) for line in lines])


def derivatives(responses: DataFrame) -> DataFrame:
    """For each response record a ``metadata`` and a ``conversion`` record, in Spark columns.

    ``responses`` has ``record_id``, ``target_uri``, ``warc_date`` and ``block``,
    the HTTP message: status line, header fields, an empty line, the payload.
    Result: ``warc_type``, ``record_id``, ``refers_to``, ``refers_to_date``,
    ``target_uri``, ``warc_date``, ``content_type``, ``content_length`` (bytes),
    ``block_digest``, ``payload_digest``, ``source_headers`` (an array of name
    and value, in order), ``block``.

    Both records refer to the response by its id, date and URI. The metadata
    record is ``application/warc-fields`` with the status, every header field of
    the response under ``http-header-``, the response's block and payload digest,
    the title and the id of the conversion record; the conversion record is the
    payload's visible text. ``payload_digest`` of both is that of the response's
    payload, so a derivative can be checked against its source.

    Null block: no headers, empty payload. No empty line: all is header. A null
    id, URI or date is left out of the fields that would hold it. Repeated
    responses give repeated records with equal ids. An empty table gives an
    empty table; other columns are not read. Row by row, no shuffle.
    """
    prepare(responses.sparkSession)
    whole = F.coalesce(F.col("block"), F.lit(""))
    cut = F.instr(whole, CRLF * 2)
    keep = ["record_id", "target_uri", "warc_date"]
    split = compute_once(responses, keep, {
        "head": F.when(cut > 0, F.substring(whole, F.lit(1), cut - 1)).otherwise(whole),
        "payload": F.when(cut > 0, F.substring(whole, cut + 4, F.length(whole))).otherwise(F.lit("")),
        "response_digest": digest(whole),
    })
    lines = F.split(F.col("head"), CRLF, -1)
    headers = F.transform(
        F.filter(F.slice(lines, 2, F.size(lines)), lambda line: F.instr(line, ":") > 1),
        lambda line: F.struct(
            F.trim(F.split_part(line, F.lit(":"), F.lit(1))).alias("name"),
            F.trim(F.substring(line, F.instr(line, ":") + 1, F.length(line))).alias("value"),
        ),
    )
    own = compute_once(split, [*keep, "response_digest"], {
        "status": F.get(lines, F.lit(0)), "source_headers": headers, "plain": plain_text(F.col("payload")),
        "title": F.trim(F.regexp_replace(title(F.col("payload")), r"\s+", " ")), "payload_digest": digest(F.col("payload")),
    })
    ids = [F.coalesce(F.col(c), F.lit("")) for c in keep]
    conversion_id = urn(F.lit("conversion"), *ids, F.col("response_digest"))
    metadata = F.concat(
        fields(("http-status", F.nullif("status", F.lit("")))),
        F.array_join(F.transform("source_headers", lambda h: F.concat(F.lit("http-header-"), F.lower(h["name"]), F.lit(": "), h["value"], F.lit(CRLF))), ""),
        fields(
            ("response-block-digest", F.col("response_digest")), ("response-payload-digest", F.col("payload_digest")),
            ("title", F.nullif("title", F.lit(""))), ("conversion-record", conversion_id),
        ),
    )

    def record(kind: str, record_id: Column, content_type: str, block: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("warc_type"), record_id.alias("record_id"), F.lit(content_type).alias("content_type"), block.alias("block")
        )

    both = compute_once(
        own, ["record_id", "target_uri", "warc_date", "payload_digest", "source_headers"],
        {"records": F.array(
            record("metadata", urn(F.lit("metadata"), *ids, F.col("response_digest")), "application/warc-fields", metadata),
            record("conversion", conversion_id, "text/plain; charset=UTF-8", F.col("plain")),
        )},
    )
    each = both.select("target_uri", "warc_date", "payload_digest", "source_headers", F.col("record_id").alias("refers_to"), F.explode("records").alias("r"))
    return each.select(
        "r.warc_type", "r.record_id", "refers_to", F.col("warc_date").alias("refers_to_date"), "target_uri", "warc_date", "r.content_type",
        F.octet_length("r.block").cast("bigint").alias("content_length"), digest(F.col("r.block")).alias("block_digest"),
        "payload_digest", "source_headers", "r.block",
    )


def serialised(records: DataFrame) -> DataFrame:
    """``record``: each record in the file format, without the two line ends that close it.

    Written with ``write_warc`` the files are WARC files.
    """
    head = F.concat(F.lit(VERSION + CRLF), fields(
        ("WARC-Type", F.col("warc_type")), ("WARC-Record-ID", F.col("record_id")), ("WARC-Date", F.col("warc_date")),
        ("WARC-Target-URI", F.col("target_uri")), ("WARC-Refers-To", F.col("refers_to")),
        ("WARC-Refers-To-Target-URI", F.col("target_uri")), ("WARC-Refers-To-Date", F.col("refers_to_date")),
        ("WARC-Block-Digest", F.col("block_digest")), ("WARC-Payload-Digest", F.col("payload_digest")),
        ("Content-Type", F.col("content_type")), ("Content-Length", F.col("content_length").cast("string")),
    ))
    return records.select(F.concat(head, F.lit(CRLF), F.col("block")).alias("record"))


def write_warc(records: DataFrame, path: str) -> None:
    """WARC files below ``path``, uncompressed, one per partition; never part of a record."""
    serialised(records).write.option("lineSep", CRLF * 2).text(path)


def page_responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Stored pages (``page_id``, ``url``, ``html``) as response records with a plain HTTP header.

    Null HTML is an empty payload.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    block = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=UTF-8{CRLF}Content-Length: "),
        F.octet_length(html).cast("string"), F.lit(CRLF * 2), html,
    )
    number = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    return pages.select(
        "page_id", urn(F.lit("response"), number, F.coalesce(F.col("url"), F.lit(""))).alias("record_id"),
        F.col("url").alias("target_uri"), F.lit(date).alias("warc_date"), block.alias("block"),
    )


def _sql_urn(kind: str, *parts: str) -> str:
    h = f"md5(concat_ws('|', '{kind}', {', '.join(parts)}))"
    cuts = ", '-', ".join(f"substr({h}, {at}, {size})" for at, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    return f"concat('<urn:uuid:', {cuts}, '>')"


def _sql_plain(html: str) -> str:
    text = f"regexp_replace({html}, '(?s)<!--.*?(?:-->|$)', ' ', 'g')"
    hidden = "|".join(rf"<{e}\b[^<>]*>.*?(?:</{e}\s*>|$)" for e in HIDDEN)
    text = rf"regexp_replace({text}, '(?is)(?:{hidden})', ' ', 'g')"
    text = rf"regexp_replace({text}, '(?i)</?(?:{'|'.join(BREAKING)})\b[^<>]*>', chr(10), 'g')"
    text = f"regexp_replace({text}, '<[A-Za-z/!?][^>]*(?:>|$)', ' ', 'g')"
    for name, c in NAMED.items():
        quoted = c.replace("'", "''")
        text = f"replace({text}, '{name}', '{quoted}')"
    text = f"regexp_replace({text}, '[ \\t\\r ]+', ' ', 'g')"
    return f"regexp_replace(regexp_replace({text}, ' ?\\n[ \\n]*', chr(10), 'g'), '^[ \\n]+|[ \\n]+$', '', 'g')"


_DATE = "2024-01-01T00:00:00Z"
ORACLE = f"""
WITH p AS (
  SELECT {_sql_urn("response", "coalesce(page_id::VARCHAR, '')", "coalesce(url, '')")} AS refers_to, url,
         coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n,
         concat('HTTP/1.1 200 OK', chr(13), chr(10), 'Content-Type: text/html; charset=UTF-8', chr(13), chr(10), 'Content-Length: ',
                strlen(coalesce(html, '')), chr(13), chr(10), chr(13), chr(10), coalesce(html, '')) AS block
  FROM pages
), o AS (
  SELECT *, 'sha256:' || sha256(block) AS rd, 'sha256:' || sha256(html) AS pd, {_sql_plain("html")} AS plain,
         trim(regexp_replace(regexp_extract(html, '(?is)<title[^<>]*>([^<]*)', 1), '\\s+', ' ', 'g')) AS title
  FROM p
), i AS (
  SELECT *, {_sql_urn("conversion", "refers_to", "coalesce(url, '')", f"'{_DATE}'", "rd")} AS cid,
         {_sql_urn("metadata", "refers_to", "coalesce(url, '')", f"'{_DATE}'", "rd")} AS mid
  FROM o
), r AS (
  SELECT 'conversion' AS warc_type, cid AS record_id, 'text/plain; charset=UTF-8' AS content_type, plain AS b, * FROM i
  UNION ALL
  SELECT 'metadata', mid, 'application/warc-fields', concat('http-status: HTTP/1.1 200 OK', chr(13), chr(10),
    'http-header-content-type: text/html; charset=UTF-8', chr(13), chr(10), 'http-header-content-length: ', n, chr(13), chr(10),
    'response-block-digest: ', rd, chr(13), chr(10), 'response-payload-digest: ', pd, chr(13), chr(10),
    CASE WHEN title <> '' THEN concat('title: ', title, chr(13), chr(10)) ELSE '' END, 'conversion-record: ', cid, chr(13), chr(10)), * FROM i
)
SELECT warc_type, record_id, refers_to, '{_DATE}' AS refers_to_date, url AS target_uri, '{_DATE}' AS warc_date, content_type,
       strlen(b)::BIGINT AS content_length, 'sha256:' || sha256(b) AS block_digest, pd AS payload_digest,
       concat('Content-Type=text/html; charset=UTF-8|Content-Length=', n) AS source_headers, b AS block
FROM r
"""
