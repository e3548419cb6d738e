"""SimHash fingerprints and near-duplicate groups by pivot distance tables."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ticketmill.llm.common import free_names, materialise, prepare, rows_of
from ticketmill.llm.components import connected_components

WIDTH, SEED = 4, 42
# Bytes of a text, and shingles of it, that are taken at once.
PART_BYTES, PART_SHINGLES = 4_000_000, 65_536
# Bit positions where the six blocks of a fingerprint begin, and its end. Two
# fingerprints that differ in at most four bits agree in two blocks at least.
BLOCKS = (0, 11, 22, 33, 44, 54, 64)
MAX_DISTANCE = 4
# Rows of a key that are compared in one task; larger keys are cut into tiles.
TILE = 4096
PIVOTS = 24


# --- fingerprints ------------------------------------------------------------
def word_runs(data: bytes, width: int) -> Iterator[list[bytes]]:
    """The words of a text in runs that overlap by ``width - 1`` words.

    A text of fewer words than ``width`` is one run; any other run has at least
    ``width`` words, and each window of ``width`` words is in exactly one.
    """
    run: list[bytes] = []
    at, first = 0, True
    while at < len(data):
        cut = re.compile(rb"[\x20\x09-\x0D]").search(data, at + PART_BYTES)
        end = cut.start() if cut else len(data)
        run = run + data[at:end].split()
        at = end
        if len(run) >= width:
            yield run
            run, first = run[len(run) - width + 1 :], False
    if first and run:
        yield run


def fingerprint(text: str | None) -> int:
    """64-bit SimHash over word shingles, as a signed integer; zero without words."""
    from xxhash import xxh64_digest

    counts, total = np.zeros(64, np.int64), 0
    data = (text or "").encode().lower()
    for words in word_runs(data, WIDTH):
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate([[0], ends[:-1]])
        width = min(WIDTH, len(words))
        spans = list(zip(starts[: len(words) - width + 1].tolist(), (ends[width - 1 :] - 1).tolist()))
        for at in range(0, len(spans), PART_SHINGLES):
            part = spans[at : at + PART_SHINGLES]
            hashes = b"".join([xxh64_digest(joined[a:b], SEED) for a, b in part])
            bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
            counts += bits.sum(axis=0, dtype=np.int64)
            total += len(part)
    return int(np.packbits(2 * counts > total).view(">i8")[0]) if total else 0


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: the id, ``fp`` (signed 64 bits) and ``text_key``, a hash of the text."""
    prepare(docs.sparkSession)
    key = docs.schema[id_column].dataType
    id_type = to_arrow_type(key)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in rows_of(batches, "id", "text_key", "text"):
            ids, keys, texts = zip(*block)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, id_type), pa.array(keys, pa.int64()), pa.array(map(fingerprint, texts), pa.int64())],
                ["id", "text_key", "fp"],
            )

    text = docs[text_column]
    picked = docs.select(docs[id_column].alias("id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    out = picked.mapInArrow(run, f"id {key.simpleString()}, text_key bigint, fp bigint")
    return out.withColumnRenamed("id", id_column)


# --- links -------------------------------------------------------------------
def block_keys(fp: Column) -> Column:
    """One key per pair of blocks: the pair's number and the bits of both blocks."""
    def bits(low: int, high: int) -> Column:
        return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << (high - low)) - 1))

    blocks = list(zip(BLOCKS, BLOCKS[1:]))
    return F.array(*[
        F.shiftleft(F.lit(n).cast("long"), 32) + F.shiftleft(bits(*x), 11) + bits(*y)
        for n, (x, y) in enumerate(combinations(blocks, 2))
    ])


def reference_fingerprints(count: int) -> np.ndarray:
    """Pseudo-random reference fingerprints: bits spread by multiply and shift."""
    x = np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def linked(groups: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between rows of the same group: enough of them to connect all that are connected.

    A table holds every row's distances to the reference fingerprints. Rows are
    in order of their group and their first distance. Row i meets row i+1, i+2,
    and so on, until the group ends or the first distances are too far apart. A
    pair whose distances to any reference differ by more than the limit cannot
    be close (triangle inequality) and is discarded; what survives is compared
    itself. Pairs that earlier links connect are passed over.
    """
    pivots = reference_fingerprints(PIVOTS)
    fps = fps.view(np.uint64)
    first = np.bitwise_count(fps ^ pivots[0])
    order = np.lexsort((first, groups))
    groups, fps = groups[order], fps[order]
    distances = [np.bitwise_count(fps ^ p).astype(np.int8) for p in pivots]
    label = np.arange(len(fps))
    bounds = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1], [True]]))
    end = np.repeat(bounds[1:], np.diff(bounds))
    begin = np.repeat(bounds[:-1], np.diff(bounds))
    a, b, rows, step = [], [], np.arange(len(fps)), 1
    while True:
        rows = rows[rows + step < end[rows]]
        rows = rows[distances[0][rows + step] - distances[0][rows] <= MAX_DISTANCE]
        if not len(rows):
            break
        left = rows[label[rows] != label[rows + step]]
        for table in distances[1:]:
            left = left[np.abs(table[left + step] - table[left]) <= MAX_DISTANCE]
        left = left[np.bitwise_count(fps[left] ^ fps[left + step]) <= MAX_DISTANCE]
        for i in left.tolist():
            x, y = label[i], label[i + step]
            if x != y:
                own = label[begin[i] : end[i]]
                own[own == y] = x
                a.append(i)
                b.append(i + step)
        step += 1
    return fps[a].view(np.int64), fps[b].view(np.int64)


def _link_groups(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole groups of the sorted rows of a partition, a batch at a time."""
    held = np.empty((0, 4), np.int64)

    def links(rows: np.ndarray) -> pa.RecordBatch:
        change = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
        a, b = linked(np.concatenate([[0], np.cumsum(change)]), np.ascontiguousarray(rows[:, 3]))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        rows = np.stack([batch.column(i).to_numpy() for i in range(4)], axis=1)
        held = np.concatenate([held, rows])
        if not len(held):
            continue
        same = (held[:, :3] == held[-1, :3]).all(axis=1)
        last = int(np.argmax(same))
        if last:
            yield links(held[:last])
        held = held[last:]
    if len(held):
        yield links(held)


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """Links ``a``, ``b`` between distinct fingerprints (column ``fp``) of at most four differing bits.

    Per group the links form a forest, so their number stays below that of its
    rows; what is connected by close pairs is connected by them. Rows meet under
    the bits of two of six blocks. A key with more than ``TILE`` rows is cut into
    tiles, and every pair of tiles is a task of its own.
    """
    keyed = distinct.select("fp", F.explode(block_keys(F.col("fp"))).alias("key"))
    counts = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    tiles = F.ceil(F.col("n") / TILE).cast("long")
    own = F.pmod(F.xxhash64("fp"), F.col("tiles"))
    met = keyed.join(counts, "key").select("key", "fp", tiles.alias("tiles")).select(
        "key", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("other")
    ).select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "fp")
    return (
        met.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
        .mapInArrow(_link_groups, "a bigint, b bigint")
    )


# --- groups ------------------------------------------------------------------
def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: the id, ``fingerprint``, ``component_id`` (and ``text_key``, ``fp``, ``component``).

    Fingerprints of words and 4-word shingles with ASCII letters lower-cased;
    rows are linked when theirs differ in at most four bits, and a component is
    all that links reach. Equal fingerprints are collapsed before anything is
    compared, so a group of copies of any size is one row.

    Null and empty text and text without words have fingerprint zero and are
    linked like any other. Repeated rows give repeated rows. A null id stays
    null and is ignored by ``component_id``, the smallest id of the component
    (null if all its ids are). An empty table gives an empty table; other
    columns are not read.
    """
    prints = materialise(fingerprints(docs, id_column, text_column))
    distinct = prints.groupBy("fp").agg(F.min(id_column).alias("least_id"))
    parts = connected_components(fingerprint_links(distinct.select("fp")))
    labelled = distinct.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least_id", F.coalesce("component", "fp").alias("component")
    )
    smallest = labelled.groupBy("component").agg(F.min("least_id").alias("component_id"))
    groups = labelled.select("fp", "component").join(smallest, "component")
    return prints.join(groups, "fp").select(
        id_column, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "text_key", "fp", "component"
    )


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that of the smallest id.

    Among rows of the same id and group the smaller text key stays; of fully
    repeated rows, one.
    """
    found = near_duplicates(docs, id_column, text_column)
    first = F.struct(F.col(id_column).isNull().alias("no_id"), id_column, "text_key")
    rows = found.groupBy("component", id_column, "text_key").agg(F.count("*").alias("copies"))
    key, text_key, copies = free_names(docs, "_id", "_key", "_copies")
    stays = rows.groupBy("component").agg(F.min(F.struct(first.alias("row"), "copies")).alias("s")).select(
        F.col(f"s.row.{id_column}").alias(key), F.col("s.row.text_key").alias(text_key), F.col("s.copies").alias(copies)
    )
    own = docs[id_column].eqNullSafe(F.col(key)) & (F.xxhash64(docs[text_column]) == F.col(text_key))
    kept = docs.join(stays, own)
    again = kept.where(F.col(copies) > 1).dropDuplicates([key, text_key])
    return kept.where(F.col(copies) == 1).unionAll(again).select(*[F.col(f"`{c}`") for c in docs.columns])
