from __future__ import annotations

import hashlib
import re

from ticketmill.llm import warc

SCHEMA = "record_id string, target_uri string, warc_date string, block string, warc_type int"
HTML = "<html><head><title> A\n title </title><style>x</style></head><body><!-- no --><p>One &amp;amp; two<br>three</p>" \
       "<script>var a = '<p>';</script><div>é&lt;b&gt;</div><p</body>"
BLOCK = f"HTTP/1.1 404 Not Found\r\nContent-Type: text/html\r\nX-Odd: a: b\r\nnot a field\r\n\r\n{HTML}"


def rows(spark, blocks):
    df = spark.createDataFrame([(f"<urn:uuid:{i}>", f"http://x/{i}", "2024-05-05T00:00:00Z", b, 1) for i, b in enumerate(blocks)], SCHEMA)
    return df, {(r.refers_to, r.warc_type): r for r in warc.derivatives(df).collect()}


def test_records(spark):
    _, got = rows(spark, [BLOCK])
    meta, text = got["<urn:uuid:0>", "metadata"], got["<urn:uuid:0>", "conversion"]
    assert text.block == "One &amp; two\nthree\né<b>" or text.block == "One & two\nthree\né<b>"
    assert [tuple(h) for h in meta.source_headers] == [("Content-Type", "text/html"), ("X-Odd", "a: b")]
    sha = lambda t: "sha256:" + hashlib.sha256(t.encode()).hexdigest()
    assert meta.payload_digest == text.payload_digest == sha(HTML)
    assert meta.block.splitlines() == [
        "http-status: HTTP/1.1 404 Not Found", "http-header-content-type: text/html", "http-header-x-odd: a: b",
        f"response-block-digest: {sha(BLOCK)}", f"response-payload-digest: {sha(HTML)}", "title: A title", f"conversion-record: {text.record_id}",
    ]
    for r in (meta, text):
        assert r.content_length == len(r.block.encode()) and r.block_digest == sha(r.block)
        assert re.fullmatch(r"<urn:uuid:[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}>", r.record_id)
        assert (r.target_uri, r.refers_to_date) == ("http://x/0", "2024-05-05T00:00:00Z")


def test_edges(spark):
    blocks = [None, "", "HTTP/1.1 200 OK\r\nA: b", "\r\n\r\n", "HTTP/1.1 200 OK\r\n\r\n" + "<p" * 50_000, "x\r\n\r\n" + "<script>" * 20_000,
              "x\r\n\r\n" + "word &amp; <b>more</b> " * 20_000, "x\r\n\r\n" + " \n" * 50_000 + "end"]
    df, got = rows(spark, blocks)
    assert len(got) == 2 * len(blocks)
    text = [got[f"<urn:uuid:{i}>", "conversion"].block for i in range(len(blocks))]
    assert text[:4] == [""] * 4 and text[5] == "" and text[7] == "end" and text[6].startswith("word & more word")
    again = warc.derivatives(df.unionAll(df))
    assert again.count() == 4 * len(blocks) and again.select("record_id").distinct().count() == 2 * len(blocks)
    assert warc.derivatives(df.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, None, None, BLOCK, 1)], SCHEMA)
    assert "None" not in "".join(r.record for r in warc.serialised(warc.derivatives(nulls)).collect())


def test_files(spark, tmp_path):
    df, got = rows(spark, [BLOCK, "HTTP/1.1 200 OK\r\n\r\n<p>a\r\n\r\nb</p>"])
    warc.write_warc(warc.derivatives(df).coalesce(1), f"{tmp_path}/out")
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("part-*")))
    found = {}
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        assert lines[0] == "WARC/1.1"
        named = dict(line.split(": ", 1) for line in lines[1:])
        size = int(named["Content-Length"])
        body, end, data = rest[:size], rest[size : size + 4], rest[size + 4 :]
        assert end == b"\r\n\r\n" and named["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(body).hexdigest()
        found[named["WARC-Refers-To"], named["WARC-Type"]] = body.decode()
    assert found == {k: r.block for k, r in got.items()}
