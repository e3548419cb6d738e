"""Fill-in-middle transformation over seekable compressed frames."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ticketmill.llm.common import prepare

# UTF-8 bytes of a frame before compression.
FRAME_BYTES = 65_536
LEVEL = 1

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
# The parts of an output in their order: marker and the section after it.
ORDERS = {"psm": ((PREFIX, 0), (SUFFIX, 2), (MIDDLE, 1)), "spm": ((SUFFIX, 2), (PREFIX, 0), (MIDDLE, 1))}

FRAMES = "frames array<binary>, ends array<bigint>"


class Zstd:
    """One compressor and one decompressor for all texts of a task; each holds buffers of its own."""

    def __init__(self) -> None:
        import zstandard

        self.pack = zstandard.ZstdCompressor(level=LEVEL).compress
        self.unpack = zstandard.ZstdDecompressor().decompress


class Frames:
    """A text as independent compressed frames; ``ends`` counts the code points up to each frame's end."""

    def __init__(self, frames: list[bytes], ends: list[int], zstd: Zstd):
        self.frames, self.ends, self.zstd = frames, ends, zstd

    @property
    def units(self) -> int:
        return self.ends[-1] if self.ends else 0

    def frame(self, k: int) -> bytes:
        return self.zstd.unpack(self.frames[k])

    def stream(self, start: int = 0, end: int | None = None) -> Iterator[bytes]:
        """Bytes of the code points from ``start`` to ``end``, frame by frame; others are not decompressed."""
        end = self.units if end is None else end
        k = bisect_right(self.ends, start)
        while start < end:
            raw, first = self.frame(k), self.ends[k - 1] if k else 0
            last = min(end, self.ends[k])
            if first < start or last < self.ends[k]:  # a cut frame
                at = _starts(raw)
                raw = raw[at[start - first] : at[last - first] if last < self.ends[k] else len(raw)]
            yield raw
            start, k = last, k + 1

    def find(self, marker: bytes) -> int:
        """The code point where a marker starts first, or -1. The last bytes of a frame are looked at again."""
        held = b""
        for k, raw in enumerate(map(self.frame, range(len(self.frames)))):
            at = (held + raw).find(marker)
            if at >= 0:
                first = self.ends[k - 1] if k else 0
                return first - _units(held) + _units((held + raw)[:at])
            held = (held + raw)[1 - len(marker) :]
        return -1


class Writer:
    """Collects bytes of whole code points into frames."""

    def __init__(self, zstd: Zstd) -> None:
        self.zstd = zstd
        self.held: list[bytes] = []
        self.size = 0
        self.frames: list[bytes] = []
        self.ends: list[int] = []

    def write(self, raw: bytes) -> None:
        while raw:
            room = FRAME_BYTES - self.size
            end = _boundary(raw, room)
            self.held.append(raw[:end])
            self.size += end
            raw = raw[end:]
            if raw or self.size >= FRAME_BYTES:
                self.flush()

    def flush(self) -> None:
        whole = b"".join(self.held)
        if whole:
            self.frames.append(self.zstd.pack(whole))
            self.ends.append((self.ends[-1] if self.ends else 0) + _units(whole))
        self.held, self.size = [], 0

    def close(self) -> Frames:
        self.flush()
        return Frames(self.frames, self.ends, self.zstd)


def _continues(raw: bytes) -> np.ndarray:
    return (np.frombuffer(raw, np.uint8) & 0xC0) == 0x80


def _units(raw: bytes) -> int:
    return len(raw) - int(np.count_nonzero(_continues(raw)))


def _starts(raw: bytes) -> np.ndarray:
    return np.flatnonzero(~_continues(raw))


def _boundary(raw: bytes, room: int) -> int:
    """The largest end of a code point within ``room`` bytes, at least one code point."""
    if len(raw) <= room:
        return len(raw)
    end = max(room, 0)
    while end and raw[end] & 0xC0 == 0x80:
        end -= 1
    if not end:
        end = 1
        while end < len(raw) and raw[end] & 0xC0 == 0x80:
            end += 1
    return end


def cuts(frames: Frames, h: tuple[int, int, int, int], rate: int, spm_share: int) -> tuple[str, int, int]:
    """Form and the two cuts of a text, from its four numbers."""
    n = frames.units
    first, second = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not n or h[2] % 100 >= rate or any(frames.find(m) >= 0 for m in (PREFIX, SUFFIX, MIDDLE)):
        return "plain", first, second
    return "spm" if h[3] % 100 < spm_share else "psm", first, second


def compose(frames: Frames, form: str, first: int, second: int) -> Frames:
    """The output of a form, as frames of its own."""
    if form == "plain":
        return frames
    bounds = (0, first, second, frames.units)
    out = Writer(frames.zstd)
    for marker, section in ORDERS[form]:
        out.write(marker)
        for raw in frames.stream(bounds[section], bounds[section + 1]):
            out.write(raw)
    return out.close()


def restore(output: Frames, form: str) -> Iterator[bytes]:
    """The text again, from an output and its form alone, frame by frame.

    Texts that hold a marker stay plain, and a marker starts with its only
    ``<``: so each marker's first place is the one that was written.
    """
    if form == "plain":
        yield from output.stream()
        return
    places = [output.find(marker) for marker, _ in ORDERS[form]] + [output.units]
    spans = {section: (places[k] + len(marker), places[k + 1]) for k, (marker, section) in enumerate(ORDERS[form])}
    for section in range(3):
        yield from output.stream(*spans[section])


def digest(chunks: Iterable[bytes]) -> str:
    found = hashlib.sha256()
    for chunk in chunks:
        found.update(chunk)
    return found.hexdigest()


def store_frames(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: ``id`` and its text as ``frames`` with cumulative code points ``ends``.

    Null and empty texts have no frame. One frame is compressed at a time, from
    the Arrow buffer, so a text of any length needs one copy of itself.
    """
    prepare(docs.sparkSession)
    key = docs.schema[id_column].dataType
    id_type = to_arrow_type(key)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd = Zstd()
        for batch in batches:
            stored = []
            for text in batch.column(1):
                out = Writer(zstd)
                if text.is_valid:
                    raw = text.as_buffer()
                    at = 0
                    while at < raw.size:
                        piece = raw.slice(at, min(FRAME_BYTES + 4, raw.size - at)).to_pybytes()
                        end = _boundary(piece, FRAME_BYTES)
                        out.write(piece[:end])
                        at += end
                stored.append(out.close())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(id_type), *_columns(stored)], ["id", "frames", "ends"],
            )

    picked = docs.select(docs[id_column].alias("id"), docs[text_column].cast("binary").alias("text"))
    return picked.mapInArrow(run, f"id {key.simpleString()}, {FRAMES}")


def _columns(stored: list[Frames]) -> list[pa.Array]:
    return [pa.array([f.frames for f in stored], pa.list_(pa.binary())), pa.array([f.ends for f in stored], pa.list_(pa.int64()))]


def draws(id_column: Column, label: str = "1") -> Column:
    """Four numbers of an id: the first 8-digit groups of the sha256 of ``label:id``, a null id as ''."""
    hashed = F.sha2(F.concat(F.lit(f"{label}:"), F.coalesce(id_column.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.array(*(F.conv(F.substring(hashed, 1 + 8 * k, 8), 16, 10).cast("bigint") for k in range(4)))


def transform(stored: DataFrame, rate: int = 90, spm_share: int = 20, with_output: bool = False) -> DataFrame:
    """Fill-in-middle examples from stored frames.

    Per row of ``store_frames``: ``id``, ``n`` code points, ``form`` (``plain``,
    ``psm``, ``spm``), the lengths ``prefix_chars`` and ``middle_chars`` (null if
    plain), ``output_sha256`` and ``restored_sha256`` (the text rebuilt from
    output and form), and on demand the output's own ``out_frames`` and
    ``out_ends``. Two numbers drawn from the id cut the text, a third makes
    ``100 - rate`` of 100 ids plain, a fourth makes ``spm_share`` of 100 spm.

    Only the frames that a cut falls into are decompressed to be cut; sections
    and digests run over frames in their order, one at a time. No shuffle; a row
    needs nothing but itself. Empty texts and texts with a marker are plain.
    Repeated ids get equal cuts; an empty table gives an empty table.
    """
    prepare(stored.sparkSession)
    key = stored.schema["id"].dataType
    id_type = to_arrow_type(key)
    names = ["id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    schema = (f"id {key.simpleString()}, n bigint, form string, prefix_chars bigint, middle_chars bigint, "
              "output_sha256 string, restored_sha256 string")
    if with_output:
        names += ["out_frames", "out_ends"]
        schema += ", out_frames array<binary>, out_ends array<bigint>"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd = Zstd()
        for batch in batches:
            rows, outputs = [], []
            for frames, ends, h in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                text = Frames(frames.as_py(), ends, zstd)
                form, first, second = cuts(text, h, rate, spm_share)
                output = compose(text, form, first, second)
                lengths = (None, None) if form == "plain" else (first, second - first)
                rows.append((text.units, form, *lengths, digest(output.stream()), digest(restore(output, form))))
                if with_output:
                    outputs.append(output)
            columns = list(map(list, zip(*rows))) or [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            found = [pa.array(c, kind) for c, kind in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(id_type), *found, *(_columns(outputs) if with_output else [])], names,
            )

    picked = stored.select("id", "frames", "ends", draws(F.col("id")).alias("h"))
    return picked.mapInArrow(run, schema)


def fill_in_middle(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rate: int = 90, spm_share: int = 20,
    with_output: bool = False,
) -> DataFrame:
    """``transform`` of the stored frames of ``docs``, under the name of its id column; other columns are not read."""
    found = transform(store_frames(docs, id_column, text_column), rate, spm_share, with_output)
    return found.withColumnRenamed("id", id_column)


ORACLE = """
WITH drawn AS (
    SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
           sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
    FROM documents),
numbers AS (
    SELECT doc_id, t, n, ('0x' || h[1:8])::UBIGINT AS h1, ('0x' || h[9:16])::UBIGINT AS h2,
           ('0x' || h[17:24])::UBIGINT AS h3, ('0x' || h[25:32])::UBIGINT AS h4
    FROM drawn),
cut AS (
    SELECT doc_id, t, n, CAST(least(h1 % (n + 1), h2 % (n + 1)) AS BIGINT) AS a,
           CAST(greatest(h1 % (n + 1), h2 % (n + 1)) AS BIGINT) AS b,
           CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90
                THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM numbers),
parts AS (
    SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1, n - b) AS s FROM cut)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""
