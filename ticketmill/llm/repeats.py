"""Removal of long repeated strings: Burrows-Wheeler transforms and interval expansion up to a threshold.

A string of ``LENGTH`` bytes counts as repeated when it also starts elsewhere.
Its anchor is the window of ``ANCHOR`` bytes within it that has the least hash
(the first of equal ones), so equal strings have equal anchors at equal places.
Consecutive starts with one anchor make a segment. Segments are grouped by their
anchor; only segments of one group can share a string. Equal segments of a group
are one class with a weight. Of every group with different segments the classes
are laid end to end, and the transform of that text tells which strings occur
in two of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ticketmill.llm.common import materialise, prepare, rows_of
from ticketmill.llm.passages import shared_words
from ticketmill.llm.windows import Windows, anchor_places

LENGTH, ANCHOR = 400, 200
# Bytes of a text that are hashed at once, and of segments under one transform.
PART_BYTES, TEXT_BYTES = 4_000_000, 1_500_000
# Different segments of an anchor that are laid under one transform; an anchor
# with more is resolved by the hashes of its strings.
GROUP_SEGMENTS = 3_000
FIRST_SYMBOLS = 7


# --- anchors -----------------------------------------------------------------------
def segments(data: bytes, windows: Windows, length: int = LENGTH, anchor: int = ANCHOR) -> Iterator[tuple[np.ndarray, ...]]:
    """Anchor hash, segment hash, first and last start of each segment, part by part."""
    for base in range(0, max(len(data) - length + 1, 0), PART_BYTES):
        part = data[base : base + PART_BYTES + length - 1]
        windows.load(part)
        n = len(part)
        at = np.arange(n - anchor + 1)
        h = windows.hashes(at, at + anchor)
        least = anchor_places(h, length - anchor + 1)
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        last = np.concatenate([first[1:], [len(least)]]) - 1
        spot = least[first]
        own = windows.segment_hashes(first, last, spot, length)
        yield h[spot].view(np.int64), own.view(np.int64), first + base, last + base


# --- the transform -------------------------------------------------------------------
def suffix_order(codes: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of all suffixes up to the end of their segment (code 0), and the keys of their first symbols in that order.

    Prefix doubling from ``FIRST_SYMBOLS`` symbols; a suffix's rank is the place of
    the first one equal so far, and only suffixes that are not alone are sorted
    again. Suffixes equal to the end stand in order of position.
    """
    n = len(codes)
    place = np.arange(n)
    key = np.zeros(n, np.uint64)
    for k in range(FIRST_SYMBOLS):
        key = (key << np.uint64(9)) | codes[np.minimum(place + k, end)]
    order = np.argsort(key)
    first = key[order]
    head = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
    size = np.diff(np.concatenate([head, [n]]))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(head, size)
    active = order[np.repeat(size > 1, size)]
    longest, k = int((end - place).max()) + 1, FIRST_SYMBOLS
    while k < longest and len(active):
        beyond = np.where(active + k <= end[active], rank[np.minimum(active + k, n - 1)] + 1, 0)
        active = _refined(order, rank, active, rank[active] * (n + 2) + beyond, n + 2)
        k *= 2
    _refined(order, rank, active, rank[active] * (n + 2) + active, n + 2)
    return order, first


def _refined(order: np.ndarray, rank: np.ndarray, active: np.ndarray, key: np.ndarray, scale: int) -> np.ndarray:
    """Sort the active suffixes within their groups by ``key``; those still not alone."""
    if not len(active):
        return active
    by = np.argsort(key)
    active, key = active[by], key[by]
    old = key // scale
    start = np.flatnonzero(np.concatenate([[True], old[1:] != old[:-1]]))
    size = np.diff(np.concatenate([start, [len(old)]]))
    at = old + np.arange(len(old)) - np.repeat(start, size)
    order[at] = active
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.concatenate([new, [len(key)]]))
    rank[active] = np.repeat(at[new], size)
    return active[np.repeat(size > 1, size)]


def repeated_starts(parts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """Which starts of a string of ``length`` bytes in each part have an equal string at another start or part.

    Common prefixes of neighbouring suffixes are derived by increasing value.
    All intervals of strings of l symbols whose right end is a common prefix of
    l - 1 are extended backward by one symbol; where an extended interval ends at
    a border without a value, the value there is l, and the interval goes on to
    the next round. After ``length`` rounds borders without a value are common
    prefixes of ``length`` or more, and nothing longer is ever computed.
    """
    sizes = np.array([len(p) for p in parts])
    stops = np.cumsum(sizes + 1) - 1
    codes = np.zeros(int(stops[-1]) + 1, np.uint64)
    inside = np.ones(len(codes), bool)
    inside[stops] = False
    codes[inside] = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint64) + np.uint64(1)
    n, end = len(codes), np.repeat(stops, sizes + 1)
    order, first = suffix_order(codes, end)
    at = np.empty(n, np.int64)
    at[order] = np.arange(n)
    before = np.where(order > 0, codes[order - 1], 0).astype(np.int64)  # the transform
    back = np.where(before > 0, at[order - 1], -1)
    known = np.zeros(n + 1, bool)
    known[0] = known[n] = True
    differ = first[1:] != first[:-1]
    known[1:n] |= differ
    border = np.concatenate([[0], np.flatnonzero(differ) + 1, [n]])
    low, high = border[:-1], border[1:] - 1
    # the first round's borders are known from the first symbols: go on from those that share all but the last
    short = np.ones(len(low), bool)
    short[:-1] = (first[low[1:]] >> np.uint64(9)) == (first[low[:-1]] >> np.uint64(9))
    short[-1] = False
    low, high = low[short], high[short]
    for _ in range(FIRST_SYMBOLS, length):
        if not len(low):
            break
        low, high = _extended(low, high, before, back)
        new = ~known[high + 1]
        low, high = low[new], high[new]
        known[high + 1] = True
    twice = ~known[:-1] | ~known[1:]
    hit = np.zeros(n, bool)
    hit[order] = twice
    starts = stops - sizes
    return [hit[s : s + max(0, size - length + 1)] for s, size in zip(starts, sizes)]


def _extended(low: np.ndarray, high: np.ndarray, before: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The intervals of all one-symbol backward extensions; no symbol precedes a segment."""
    width = high - low + 1
    single = width == 1
    ones = back[low[single]]
    ones = ones[ones >= 0]
    low, width = low[~single], width[~single]
    if not len(low):
        return ones, ones
    of = np.repeat(np.arange(len(low)), width)
    rows = np.arange(len(of)) - np.repeat(np.cumsum(width) - width, width) + low[of]
    key = of * 512 + before[rows]
    to = back[rows]
    some = to >= 0
    key, to = key[some], to[some]
    order = np.argsort(key, kind="stable")
    key, to = key[order], to[order]
    if not len(key):
        return ones, ones
    change = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    last = np.concatenate([change[1:], [len(key)]]) - 1
    return np.concatenate([ones, to[change]]), np.concatenate([ones, to[last]])


def _runs(flags: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [{"a": int(a), "b": int(b) - 1} for a, b in zip(edge[::2], edge[1::2])]


# --- on Spark --------------------------------------------------------------------------
RANGES = "array<struct<a:bigint,b:bigint>>"


def anchors(docs: DataFrame, length: int, anchor: int) -> DataFrame:
    """``h``, ``seg``, ``id``, ``text_key``, ``st``, ``en`` of every segment of ``docs`` (``id``, ``text_key``, ``text``)."""
    key = docs.schema["id"].dataType
    id_type = to_arrow_type(key)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows()
        for block in rows_of(batches, "id", "text_key", "text"):
            rows, found = [], []
            for row, (_, _, text) in enumerate(block):
                for part in segments((text or "").encode(), windows, length, anchor):
                    rows.append(np.full(len(part[0]), row))
                    found.append(part)
            if found:
                at = pa.array(np.concatenate(rows))
                h, seg, st, en = (pa.array(np.concatenate(c)) for c in zip(*found))
                ids = pa.array([r[0] for r in block], id_type).take(at)
                keys = pa.array([r[1] for r in block], pa.int64()).take(at)
                yield pa.RecordBatch.from_arrays([h, seg, ids, keys, st, en], ["h", "seg", "id", "text_key", "st", "en"])

    return docs.select("id", "text_key", "text").mapInArrow(
        run, f"h bigint, seg bigint, id {key.simpleString()}, text_key bigint, st bigint, en bigint"
    )


def _combined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal (h, seg) of many rows of a task as one with their number, before anything is shuffled."""
    def out(pairs: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((pairs[:, 1], pairs[:, 0]))
        pairs = pairs[order]
        first = np.flatnonzero(np.concatenate([[True], (pairs[1:] != pairs[:-1]).any(axis=1)]))
        w = np.diff(np.concatenate([first, [len(pairs)]]))
        return pa.RecordBatch.from_arrays([pa.array(pairs[first, 0]), pa.array(pairs[first, 1]), pa.array(w)], ["h", "seg", "w"])

    held: list[np.ndarray] = []
    for batch in batches:
        held.append(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1))
        if sum(map(len, held)) >= 500_000:
            yield out(np.concatenate(held))
            held = []
    if held and sum(map(len, held)):
        yield out(np.concatenate(held))


def contents(docs: DataFrame, chosen: DataFrame, length: int) -> DataFrame:
    """``chosen`` (``id``, ``text_key``, ``st``, ``en``, ``h``, ``seg``, ``w``, ``classes``) with the segments' bytes."""
    wanted = chosen.groupBy("id", "text_key").agg(
        F.collect_list(F.struct("h", "seg", "w", "classes", "st", "en")).alias("wanted")
    ).select(F.col("id").alias("_id"), F.col("text_key").alias("_key"), "wanted")
    joined = docs.join(wanted, (F.col("text_key") == F.col("_key")) & F.col("id").eqNullSafe(F.col("_id"))).select("wanted", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in rows_of(batches, "wanted", "text"):
            rows = [(*(w[k] for k in ("h", "seg", "w", "classes")), data[w["st"] : w["en"] + length])
                    for wanted, text in block for data in [text.encode()] for w in wanted]
            h, seg, w, classes, part = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h, pa.int64()), pa.array(seg, pa.int64()), pa.array(w, pa.int64()), pa.array(classes, pa.int64()), pa.array(part, pa.binary())],
                ["h", "seg", "w", "classes", "part"],
            )

    return joined.mapInArrow(run, "h bigint, seg bigint, w bigint, classes bigint, part binary")


def expanded(parts: DataFrame, length: int) -> DataFrame:
    """``h``, ``seg``, ``ranges``: the starts of single segments that another segment of their anchor repeats."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, group = 0, None

        def out() -> pa.RecordBatch:
            flags = repeated_starts([row[3] for row in held], length)
            found = [(h, seg, _runs(f)) for (h, seg, w, _), f in zip(held, flags) if w == 1 and f.any()]
            h, seg, ranges = zip(*found) if found else ((), (), ())
            return pa.RecordBatch.from_arrays(
                [pa.array(h, pa.int64()), pa.array(seg, pa.int64()), pa.array(ranges, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))],
                ["h", "seg", "ranges"],
            )

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if row[0] != group and size >= TEXT_BYTES:
                    yield out()
                    held, size = [], 0
                group = row[0]
                held.append(row)
                size += len(row[3])
        if held:
            yield out()

    rows = parts.select("h", "seg", "w", "part").repartition("h").sortWithinPartitions("h")
    return rows.mapInArrow(run, f"h bigint, seg bigint, ranges {RANGES}")


def resolved(parts: DataFrame, length: int) -> DataFrame:
    """The same for anchors with very many different segments: equal hashes of their strings, 128 bits with the anchor's."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows()
        for batch in batches:
            for h, seg, w, part in zip(*(batch.column(i).to_pylist() for i in range(4))):
                windows.load(part)
                at = np.arange(len(part) - length + 1)
                s = windows.hashes(at, at + length).view(np.int64)
                n = len(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, h)), pa.array(s), pa.array(np.full(n, seg)), pa.array(at), pa.array(np.full(n, w))], ["h", "s", "seg", "o", "w"])

    strings = parts.select("h", "seg", "w", "part").mapInArrow(run, "h bigint, s bigint, seg bigint, o bigint, w bigint")
    often = strings.groupBy("h", "s").agg(F.count("*").alias("n")).where("n > 1")
    hit = strings.where("w = 1").join(often, ["h", "s"]).groupBy("h", "seg")
    return hit.agg(F.collect_list(F.struct(F.col("o").alias("a"), F.col("o").alias("b"))).alias("ranges"))


def repeated_ranges(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """``id``, ``text_key``, ``a``, ``b``: runs of starts whose string of ``length`` bytes also starts elsewhere.

    ``docs`` has ``id``, ``text_key``, ``text``. Equal segments are combined
    within tasks before they are shuffled by their anchor, so copies of one text
    are a few rows however many there are.
    """
    found = materialise(anchors(docs, length, anchor))
    partial = found.select("h", "seg").mapInArrow(_combined, "h bigint, seg bigint, w bigint").repartition("h")
    classes = partial.groupBy("h", "seg").agg(F.sum("w").alias("w"))
    by_anchor = Window.partitionBy("h")
    met = classes.select("h", "seg", "w", F.count("*").over(by_anchor).alias("classes")).where("classes > 1 OR w > 1")
    places = materialise(found.join(met, ["h", "seg"]))
    chosen = places.where("classes > 1").groupBy("h", "seg").agg(
        F.min(F.struct("id", "text_key", "st", "en")).alias("p"), F.first("w").alias("w"), F.first("classes").alias("classes")
    ).select("p.*", "h", "seg", "w", "classes")
    parts = materialise(contents(docs, chosen, length))
    single = expanded(parts.where(F.col("classes") <= GROUP_SEGMENTS), length).unionAll(
        resolved(parts.where(F.col("classes") > GROUP_SEGMENTS), length)
    )
    whole = places.where("w > 1").select("id", "text_key", F.col("st").alias("a"), F.col("en").alias("b"))
    some = places.where("w = 1").join(single, ["h", "seg"]).select("id", "text_key", "st", F.explode("ranges").alias("r")).select(
        "id", "text_key", (F.col("st") + F.col("r.a")).alias("a"), (F.col("st") + F.col("r.b")).alias("b")
    )
    return whole.unionAll(some)


def spans(ranges: list, n: int, length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that strings starting in ``ranges`` cover."""
    merged: list[list[int]] = []
    for a, b in sorted((r["a"], r["b"] + length) for r in ranges):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return [(a, min(b, n)) for a, b in merged]


def remove_repeats(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH, anchor: int = ANCHOR, with_spans: bool = False,
) -> DataFrame:
    """Per row: the id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``, ``n_shared_words`` (and ``spans``, ``kept``, on demand).

    A byte is removed if a string of ``length`` bytes that covers it also starts
    anywhere else, in the same text or another; matches never cross texts, and
    all strings are judged on the input. ``kept`` is what is left, as bytes: a
    removal may cut a character. ``n_shared_words`` counts the words in passages of
    over 50 words that another document holds too (:func:`~ticketmill.llm.passages.shared_words`);
    these may be shorter than ``length``, and nothing is removed for them.

    Null text counts as empty; texts shorter than ``length`` stay whole. Fully
    repeated rows are copies of each other like any other texts. A null id stays
    null, an empty table gives an empty table, other columns are not read.
    """
    prepare(docs.sparkSession)
    text = docs[text_column]
    named = docs.select(docs[id_column].alias("id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    removed = repeated_ranges(named, length, anchor).select("id", "text_key", F.struct("a", "b").alias("r"), F.lit(None).cast("bigint").alias("n"))
    shared = shared_words(named).select("id", "text_key", F.lit(None).cast(removed.schema["r"].dataType).alias("r"), "n")
    found = removed.unionAll(shared).groupBy("id", "text_key").agg(
        F.collect_set("r").alias("ranges"), F.max("n").alias("shared")
    ).select(F.col("id").alias("_id"), F.col("text_key").alias("_key"), "ranges", "shared")
    joined = named.join(found, (F.col("text_key") == F.col("_key")) & F.col("id").eqNullSafe(F.col("_id")), "left").select(
        "id", "ranges", F.coalesce("shared", F.lit(0)).cast("bigint").alias("shared"), "text"
    )
    key = docs.schema[id_column].dataType
    id_type = to_arrow_type(key)
    span_type = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in rows_of(batches, "id", "ranges", "shared", "text"):
            out = []
            for i, ranges, n_shared, own in block:
                data = (own or "").encode()
                gone = spans(ranges or [], len(data), length)
                edges = [0, *(x for span in gone for x in span), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
                row = (i, len(data), len(data) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), n_shared)
                out.append((*row, [{"a": a, "b": b} for a, b in gone], kept) if with_spans else row)
            types = [id_type, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), span_type, pa.binary()]
            names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared_words", "spans", "kept"]
            columns = [pa.array(c, t) for c, t in zip(zip(*out), types)]
            yield pa.RecordBatch.from_arrays(columns, names[: len(columns)])

    schema = f"id {key.simpleString()}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, n_shared_words bigint"
    schema += f", spans {RANGES}, kept binary" * with_spans
    return joined.mapInArrow(run, schema).withColumnRenamed("id", id_column)
