"""Passages that documents share: runs of over 50 equal words, wherever they stand in a line or a text.

A window of ``WINDOW`` words has an anchor: of its runs of ``ANCHOR`` words the
one with the least hash. Equal windows have equal anchors at equal places, so
only windows around an anchor that two documents hold are looked at further.
Consecutive windows with one anchor make a segment; of equal segments one stands
for all. The windows of different segments with one anchor meet by their hashes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ticketmill.llm.common import materialise, rows_of
from ticketmill.llm.windows import Windows, anchor_places

# Words of a window (a passage has more than 50) and of its anchor.
WINDOW, ANCHOR = 51, 10
# Words that are hashed at once.
PART_WORDS = 4_000_000


def word_codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in a row, and where each text begins and the last ends.

    Words are runs without ASCII white space, A-Z in lower case.
    """
    from xxhash import xxh64_intdigest

    split = pc.ascii_split_whitespace(pc.ascii_lower(pa.array([t or "" for t in texts], pa.large_string())))
    words = split.flatten()
    kept = pc.greater(pc.binary_length(words), 0)
    real = np.concatenate([[0], np.cumsum(kept.to_numpy(zero_copy_only=False))])
    lists = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))])
    coded = words.filter(kept).dictionary_encode()
    distinct = coded.dictionary.to_numpy(zero_copy_only=False)
    hashes = np.fromiter(map(xxh64_intdigest, distinct), np.uint64, len(distinct))
    return hashes[coded.indices.to_numpy()], real[lists]


def segments(codes: np.ndarray, bounds: np.ndarray, windows: Windows, length: int, anchor: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Text, anchor hash, segment hash, first and last start (in ``codes``) of each segment, part by part."""
    for base in range(0, max(len(codes) - length + 1, 0), PART_WORDS):
        part = codes[base : base + PART_WORDS + length - 1]
        windows.load_codes(part)
        at = np.arange(len(part) - anchor + 1)
        h = windows.hashes(at, at + anchor)
        least = anchor_places(h, length - anchor + 1)
        text = np.searchsorted(bounds, base + np.arange(len(least)), "right") - 1
        whole = base + np.arange(len(least)) + length <= bounds[text + 1]
        starts = np.flatnonzero(whole)
        if not len(starts):
            continue
        least = least[starts]
        new = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (starts[1:] != starts[:-1] + 1)]))
        first, last = starts[new], starts[np.concatenate([new[1:], [len(starts)]]) - 1]
        spot = least[new]
        own = windows.segment_hashes(first, last, spot, length)
        yield text[first], h[spot].view(np.int64), own.view(np.int64), first + base, last + base


def _anchors(docs: DataFrame, length: int, anchor: int) -> DataFrame:
    """``h``, ``seg``, ``id``, ``text_key``, ``st``, ``en`` (first and last start, in words) of every segment."""
    key = docs.schema["id"].dataType
    id_type = to_arrow_type(key)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows()
        for block in rows_of(batches, "id", "text_key", "text"):
            ids, keys = pa.array([r[0] for r in block], id_type), pa.array([r[1] for r in block], pa.int64())
            codes, bounds = word_codes([r[2] for r in block])
            for text, h, seg, first, last in segments(codes, bounds, windows, length, anchor):
                row = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h), pa.array(seg), ids.take(row), keys.take(row), pa.array(first - bounds[text]), pa.array(last - bounds[text])],
                    ["h", "seg", "id", "text_key", "st", "en"])

    return docs.select("id", "text_key", "text").mapInArrow(
        run, f"h bigint, seg bigint, id {key.simpleString()}, text_key bigint, st bigint, en bigint"
    )


def _windows(docs: DataFrame, chosen: DataFrame, length: int) -> DataFrame:
    """``h``, ``s`` (hash), ``seg``, ``o`` (place in the segment), ``low``, ``high`` of every window of the chosen segments."""
    wanted = chosen.groupBy("id", "text_key").agg(F.collect_list(F.struct("h", "seg", "low", "high", "st", "en")).alias("wanted")).select(
        F.col("id").alias("_id"), F.col("text_key").alias("_key"), "wanted"
    )
    joined = docs.join(wanted, (F.col("text_key") == F.col("_key")) & F.col("id").eqNullSafe(F.col("_id"))).select("wanted", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows()
        for block in rows_of(batches, "wanted", "text"):
            codes, bounds = word_codes([text for _, text in block])
            windows.load_codes(codes)
            rows = [(w["h"], w["seg"], w["low"], w["high"], begin + w["st"], w["en"] - w["st"] + 1)
                    for begin, (wanted, _) in zip(bounds.tolist(), block) for w in wanted]
            h, seg, low, high, first, size = (np.array(c, np.int64) for c in zip(*rows))
            o = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            at = np.repeat(first, size) + o
            s = windows.hashes(at, at + length).view(np.int64)
            h, seg, low, high = (np.repeat(c, size) for c in (h, seg, low, high))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (h, s, seg, o, low, high)], ["h", "s", "seg", "o", "low", "high"])

    return joined.mapInArrow(run, "h bigint, s bigint, seg bigint, o bigint, low bigint, high bigint")


def shared_words(docs: DataFrame, length: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """``id``, ``text_key``, ``n``: the words of a document that lie in a run of ``length`` words or more that another one holds.

    ``docs`` has ``id``, ``text_key`` (hash of the text), ``text``. Rows of equal
    id and text are one document. A row comes for every document with such words.
    """
    found = materialise(_anchors(docs, length, anchor))
    doc = F.xxhash64("id", "text_key")
    # most anchors are held by one document: these go first
    met = found.groupBy("h").agg(F.min(doc).alias("least"), F.max(doc).alias("most")).where("least <> most").select("h")
    near = materialise(found.join(met, "h", "left_semi"))
    segs = near.groupBy("h", "seg").agg(F.min(doc).alias("low"), F.max(doc).alias("high"))
    classes = segs.join(segs.groupBy("h").agg(F.count("*").alias("classes")), "h")
    places = materialise(near.join(classes, ["h", "seg"]))
    chosen = places.where("classes > 1").groupBy("h", "seg").agg(
        F.min(F.struct("id", "text_key", "st", "en")).alias("p"), F.first("low").alias("low"), F.first("high").alias("high")
    ).select("p.*", "h", "seg", "low", "high")
    windows = materialise(_windows(docs, chosen, length))
    often = windows.groupBy("h", "s").agg(F.min("low").alias("least"), F.max("high").alias("most")).where("least <> most")
    hits = windows.where("low = high").join(often, ["h", "s"]).groupBy("h", "seg").agg(F.collect_list("o").alias("starts"))
    whole = places.where("low <> high").select("id", "text_key", F.col("st").alias("a"), (F.col("en") + length).alias("b"))
    some = places.where("low = high").join(hits, ["h", "seg"]).select("id", "text_key", "st", F.explode("starts").alias("o"))
    runs = whole.unionAll(some.select("id", "text_key", F.col("st") + F.col("o"), F.col("st") + F.col("o") + length))
    listed = runs.groupBy("id", "text_key").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("runs"))
    none = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("to"))

    def add(seen, r):
        own = F.greatest(r["b"] - F.greatest(r["a"], seen["to"]), F.lit(0))
        return F.struct((seen["n"] + own).alias("n"), F.greatest(seen["to"], r["b"]).alias("to"))

    return listed.select("id", "text_key", F.aggregate("runs", none, add)["n"].alias("n"))
