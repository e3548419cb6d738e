"""Repeated paragraphs: MinHash bands, exact Jaccard verification, removal by components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ticketmill.llm.common import free_names, materialise, prepare, rows_of
from ticketmill.llm.components import connected_components
from ticketmill.llm.passages import shared_words

WIDTH, SIMILARITY, RECALL = 5, 0.8, 0.999
# Paragraphs of a bucket that one task compares, and cells of the matrix it
# multiplies at a time.
TILE, CELLS = 1024, 8_000_000
# Words a repeated paragraph must exceed to count as a shared passage.
PASSAGE_WORDS = 20


def tuned(similarity: float = SIMILARITY, recall: float = RECALL, budget: int = 64) -> tuple[int, int]:
    """Bands and rows per band: the most rows that still find a pair of that similarity with that probability."""
    best = (budget, 1)
    for rows in range(1, budget + 1):
        bands = next((b for b in range(1, budget // rows + 1) if 1 - (1 - similarity**rows) ** b >= recall), None)
        if bands:
            best = (bands, rows)
    return best


BANDS, ROWS = tuned()


def _constants(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    return rng.integers(1, 2**63, count, dtype=np.uint64) | np.uint64(1), rng.integers(0, 2**63, count, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# --- inside a task -----------------------------------------------------------------
class Hasher:
    """Hashes of word shingles and band keys of paragraphs, many paragraphs at once."""

    def __init__(self):
        from xxhash import xxh64_intdigest, xxh128_digest

        self.word_hash, self.digest = xxh64_intdigest, xxh128_digest
        self.factors, self.offsets = _constants(BANDS * ROWS)
        self.places, _ = _constants(WIDTH)

    def shingles(self, listed: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each window of ``WIDTH`` words within a paragraph, and where each paragraph begins and the last ends."""
        sizes = np.fromiter(map(len, listed), np.int64, len(listed))
        coded = pa.array(chain.from_iterable(listed), pa.large_string()).dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False)
        h = np.fromiter(map(self.word_hash, distinct), np.uint64, len(distinct))[coded.indices.to_numpy()]
        n = max(len(h) - WIDTH + 1, 0)
        total = np.zeros(n, np.uint64)
        for k, factor in enumerate(self.places):
            total += h[k : k + n] * factor
        inside = np.ones(n, bool)  # windows that begin in the last words of a paragraph reach into the next one
        inside[(np.cumsum(sizes)[:-1, None] - np.arange(1, WIDTH)).ravel()] = False
        return _mixed(total[inside]), np.concatenate([[0], np.cumsum(sizes - WIDTH + 1)])

    def bands(self, every: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """One key per paragraph and band."""
        starts = bounds[:-1]
        keys = np.empty((len(starts), BANDS), np.uint64)
        for band in range(BANDS):
            key = np.full(len(starts), band + 1, np.uint64)
            for k in range(band * ROWS, (band + 1) * ROWS):
                key = _mixed(key ^ np.minimum.reduceat(every * self.factors[k] + self.offsets[k], starts))
            keys[:, band] = key
        return keys.view(np.int64)


def paragraphs(text: str | None) -> list[tuple[int, list[str]]]:
    """Number and lower-cased words of each line of at least ``WIDTH`` words."""
    lines = ((i, line.split()) for i, line in enumerate((text or "").lower().split("\n")))
    return [(i, words) for i, words in lines if len(words) >= WIDTH]


def _union(label: np.ndarray, near: np.ndarray) -> list[tuple[int, int]]:
    """A forest of the graph ``near``, given what ``label`` already connects."""
    links = []
    for i in range(len(label)):
        for j in np.flatnonzero(near[i, :i] & (label[:i] != label[i])).tolist():
            if label[i] != label[j]:
                label[label == label[j]] = label[i]
                links.append((i, j))
    return links


def similar(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links of Jaccard ``SIMILARITY`` or more between the given sets: a forest that connects what they connect.

    Only shingles of two sets or more count towards an intersection; the counts
    are products of the sets' rows, taken in bounded groups of shingles.
    """
    sizes = np.array([len(s) for s in sets], np.float64)
    if len(sets) == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(1, 0)] if both >= SIMILARITY * (sizes.sum() - both) else []
    row = np.repeat(np.arange(len(sets)), sizes.astype(int))
    values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = count[column] > 1
    row, column = row[often], np.unique(column[often], return_inverse=True)[1]
    common = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    columns = int(column[-1]) + 1 if len(column) else 0
    width = min(columns, max(1, CELLS // len(sets)))
    for at in range(0, columns, width or 1):
        low, high = np.searchsorted(column, (at, at + width))
        m = np.zeros((len(sets), width), np.float32)
        m[row[low:high], column[low:high] - at] = 1
        common += m @ m.T
    near = common >= SIMILARITY * (sizes[:, None] + sizes[None, :] - common)
    return _union(np.arange(len(sets)), near)


def _verified(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole buckets of the sorted rows of a partition."""
    key, ids, sets = None, [], []

    def links() -> Iterator[pa.RecordBatch]:
        found = similar(sets) if len(sets) > 1 else []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i, _ in found]), pa.array([ids[j] for _, j in found])], ["a", "b"])

    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(4)]
        arrays = batch.column(4)
        values, offsets = arrays.values.to_numpy(), arrays.offsets.to_numpy()
        for n, (*own, pid) in enumerate(zip(*columns)):
            if own != key:
                yield from links()
                key, ids, sets = own, [], []
            ids.append(pid)
            sets.append(values[offsets[n] : offsets[n + 1]].copy())
    yield from links()


# --- on Spark ------------------------------------------------------------------------
def occurrences(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Every paragraph: ``id``, ``text_key``, ``par``, ``n_words``, ``pid`` (128-bit hash of its words), ``bands``.

    The band keys come once per paragraph and block of texts, else they are null.
    """
    key = docs.schema[id_column].dataType
    id_type = to_arrow_type(key)
    names = ["id", "text_key", "par", "n_words", "pid", "bands"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for block in rows_of(batches, "id", "text_key", "text"):
            ids, keys, pars, sizes, pids, listed, first = [], [], [], [], [], [], {}
            for i, text_key, text in block:
                for par, words in paragraphs(text):
                    pid = hasher.digest(" ".join(words))
                    ids.append(i)
                    keys.append(text_key)
                    pars.append(par)
                    sizes.append(len(words))
                    if pid not in first:
                        first[pid] = len(pids)
                        listed.append(words)
                    pids.append(pid)
            if not pids:
                continue
            bands: list = [None] * len(pids)
            for at, row in zip(first.values(), hasher.bands(*hasher.shingles(listed))):
                bands[at] = row
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, id_type), pa.array(keys, pa.int64()), pa.array(pars, pa.int32()), pa.array(sizes, pa.int32()),
                 pa.array(pids, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names)

    text = docs[text_column]
    picked = docs.select(docs[id_column].alias("id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    return picked.mapInArrow(run, f"id {key.simpleString()}, text_key bigint, par int, n_words int, pid binary, bands array<bigint>")


def colliding(found: DataFrame) -> DataFrame:
    """``key`` and ``pid`` of the paragraphs that share a band key with another one.

    The keys are shuffled with a 64-bit hash of the ``pid``, which halves their bytes; few are left to meet the ``pid``.
    """
    named = found.where("bands IS NOT NULL").select(F.xxhash64("pid").alias("p"), "pid", "bands")
    rows = named.select("p", F.explode("bands").alias("key"))
    bucket = Window.partitionBy("key")
    seen = rows.select("key", "p", F.min("p").over(bucket).alias("low"), F.max("p").over(bucket).alias("high"))
    met = seen.where("low <> high").select("key", "p").distinct()
    return met.join(named.select("p", "pid"), "p").select("key", "pid").distinct()


def shingle_sets(docs: DataFrame, chosen: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``pid`` and its set of shingle hashes, sorted, of each chosen paragraph (``id``, ``text_key``, ``par``, ``pid``)."""
    wanted = chosen.groupBy("id", "text_key").agg(F.collect_list(F.struct("par", "pid")).alias("wanted")).select(
        F.col("id").alias("_id"), F.col("text_key").alias("_key"), "wanted"
    )
    text = docs[text_column]
    own = docs.select(docs[id_column].alias("id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    joined = own.join(wanted, (F.col("text_key") == F.col("_key")) & F.col("id").eqNullSafe(F.col("_id"))).select("wanted", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for block in rows_of(batches, "wanted", "text"):
            pids, listed = [], []
            for wanted, text in block:
                lines = text.lower().split("\n")
                for w in wanted:
                    pids.append(w["pid"])
                    listed.append(lines[w["par"]].split())
            every, bounds = hasher.shingles(listed)
            sets = [np.unique(s).view(np.int64) for s in np.split(every, bounds[1:-1])]
            yield pa.RecordBatch.from_arrays([pa.array(pids, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], ["pid", "shingles"])

    return joined.mapInArrow(run, "pid binary, shingles array<bigint>").dropDuplicates(["pid"])


def links(docs: DataFrame, found: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Verified links ``a``, ``b`` between different paragraphs of Jaccard similarity 0.8 or more.

    The paragraphs of a bucket are compared exactly. Per bucket the links form a
    forest, so their number stays below that of its rows. A bucket of more than
    ``TILE`` paragraphs is cut into tiles; each pair of tiles is compared in a
    task of its own.
    """
    met = materialise(colliding(found))
    place = F.min(F.struct("id", "text_key", "par")).alias("p")
    chosen = found.join(met.select("pid").distinct(), "pid", "left_semi").groupBy("pid").agg(place)
    sets = materialise(shingle_sets(docs, chosen.select("p.id", "p.text_key", "p.par", "pid"), id_column, text_column))
    sizes = met.groupBy("key").agg(F.ceil(F.count("*") / TILE).cast("long").alias("tiles"))
    own = F.pmod(F.xxhash64("pid"), F.col("tiles"))
    tiled = met.join(sizes, "key").select(
        "key", "pid", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("other")
    ).select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "pid")
    rows = tiled.join(sets, "pid").select("key", "x", "y", "pid", "shingles")
    return rows.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(_verified, "a binary, b binary")


def repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each occurrence of a repeated paragraph.

    ``id``, ``text_key``, ``par``, ``n_words``, ``first_id``, ``first_par``,
    ``removed``, and ``shared``: whether its cluster lies in two documents.

    Paragraphs are lines of five words or more. Equal ones (words, ignoring case
    and spacing) are one class; classes of similarity 0.8 or more are linked, and
    a component of links is a cluster. The occurrence with the smallest id, then
    text key, then line number stays; the others are removed.
    """
    prepare(docs.sparkSession)
    found = materialise(occurrences(docs, id_column, text_column))
    place = F.struct("id", "text_key", "par")
    classes = found.groupBy("pid").agg(F.count("*").alias("n"), F.min(place).alias("place"), F.max(place).alias("last"))
    parts = connected_components(links(docs, found, id_column, text_column))
    labelled = classes.join(parts.withColumnRenamed("node", "pid"), "pid", "left").where("n > 1 OR component IS NOT NULL").select(
        "pid", "place", "last", F.coalesce("component", "pid").alias("component")
    )
    first = labelled.groupBy("component").agg(F.min("place").alias("first"), F.max("last").alias("last"))
    named = labelled.select("pid", "component").join(first, "component").select("pid", "first", "last")
    one = F.col("first.id").eqNullSafe(F.col("last.id")) & F.col("first.text_key").eqNullSafe(F.col("last.text_key"))
    return found.select("id", "text_key", "par", "n_words", "pid").join(named, "pid").select(
        "id", "text_key", "par", "n_words", F.col("first.id").alias("first_id"), F.col("first.par").alias("first_par"),
        (~place.eqNullSafe(F.col("first"))).alias("removed"), (~one).alias("shared"),
    )


def repeated_paragraphs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: the id, ``n_paragraphs`` (lines), ``n_repeated``, ``n_removed``, ``n_shared``, ``n_shared_words``, ``repeats``.

    ``repeats`` lists the lines that belong to a cluster: ``par``, ``first_id``
    and ``first_par`` (the occurrence that stays), ``n_words``, ``removed`` and
    ``shared`` (the cluster lies in two documents or more). ``n_shared`` counts
    the shared ones of more than ``PASSAGE_WORDS`` words. ``n_shared_words``
    counts the words in passages of over 50 words that another document holds
    too, also inside lines that differ otherwise
    (:func:`~ticketmill.llm.passages.shared_words`); nothing is removed for them.

    Null text has no lines, empty text one. Lines of fewer than five words are
    left alone. Fully repeated rows are one document: each is reported, and none
    is removed for the other's sake. A null id is the smallest. An empty table
    gives an empty table; other columns are not read.
    """
    found = repeats(docs, id_column, text_column).select(
        "id", "text_key", F.struct("par", "first_id", "first_par", "n_words", "removed", "shared").alias("r"), F.lit(None).cast("bigint").alias("n")
    )
    text = docs[text_column]
    named = docs.select(docs[id_column].alias("id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    passages = shared_words(named).select("id", "text_key", F.lit(None).cast(found.schema["r"].dataType).alias("r"), "n")
    by_doc = found.unionAll(passages).groupBy("id", "text_key").agg(
        F.sort_array(F.collect_set("r")).alias("repeats"), F.max("n").alias("n")
    ).select(F.col("id").alias("_id"), F.col("text_key").alias("_key"), "repeats", "n")
    rows = docs.select(
        docs[id_column].alias("id"), F.xxhash64(text).alias("text_key"),
        F.coalesce(F.size(F.split(text, "\n", -1)), F.lit(0)).cast("bigint").alias("n_paragraphs"),
    )
    joined = rows.join(by_doc, (F.col("text_key") == F.col("_key")) & F.col("id").eqNullSafe(F.col("_id")), "left")
    own = F.coalesce("repeats", F.array().cast(by_doc.schema["repeats"].dataType))
    return joined.select(
        F.col("id").alias(id_column), "n_paragraphs", F.size(own).cast("bigint").alias("n_repeated"),
        F.size(F.filter(own, lambda r: r["removed"])).cast("bigint").alias("n_removed"),
        F.size(F.filter(own, lambda r: r["shared"] & (r["n_words"] > PASSAGE_WORDS))).cast("bigint").alias("n_shared"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n_shared_words"), own.alias("repeats"),
    )


def without_repeats(docs: DataFrame, found: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with the removed lines of ``repeated_paragraphs`` taken out of their texts; rows of one id share them."""
    key, lost = free_names(docs, "_id", "_gone")
    removed = F.transform(F.filter("repeats", lambda r: r["removed"]), lambda r: r["par"])
    gone = found.select(F.col(id_column).alias(key), removed.alias(lost)).where(F.size(lost) > 0).dropDuplicates([key])
    joined = docs.join(gone, docs[id_column].eqNullSafe(F.col(key)), "left")
    kept = _kept_lines(docs[text_column], F.col(lost))
    new = F.when(F.col(lost).isNull(), docs[text_column]).otherwise(kept)
    return joined.select(*[new.alias(c) if c == text_column else docs[c] for c in docs.columns])


def _kept_lines(text: Column, gone: Column) -> Column:
    lines = F.transform(F.split(text, "\n", -1), lambda line, i: F.when(~F.array_contains(gone, i), line))
    return F.array_join(lines, "\n")
