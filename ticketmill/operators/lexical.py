"""BM25 over a stored inverted index whose blocks carry upper bounds.

Documents are dealt into blocks of similar length. The index has one row per
(term, block) with the block's postings, its largest term frequency and its
shortest document, which bound what the term can add to a document there. A
search first reads, per query, the blocks of the highest bounds until they hold
enough documents; the k-th score found there is a floor, and of all other blocks
only those whose bound reaches it are read.

A text is shuffled once, as its distinct words, to the task that makes all rows of
its block; a search sends the rows of its words once to the tasks that score a
block for up to ``TILE_QUERIES`` queries. The arithmetic is numpy inside Spark tasks.

Layout below a folder: ``postings`` (``term, block, n, max_tf, min_dl, entries``), in
folders by ``bucket``, a hash of the term, every file sorted by term, so that a search
touches only its words' places. The empty term, in a bucket of its own, lists the
documents of a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ticketmill import defaults as D
from ticketmill.schemas import SEARCHABLE
from ticketmill.session import scratch_folder, stored

# Documents of a block, about; and folders of the postings.
BLOCK_DOCS = 512
BUCKETS = 16
# Distinct query words that are broadcast at most, about 50 bytes each.
BROADCAST_WORDS = 500_000
# Lengths within a factor of 2 ** (1 / LENGTH_STEPS) share a class; a corpus
# fills about so many classes.
LENGTH_STEPS = 4
CLASSES = 8
# Words from which a text counts as several for the size of its block.
LONG_WORDS = 2_048
# Queries and terms whose weights a task holds at once, and (block, tile of queries) pairs that are broadcast at most.
TILE_QUERIES, TILE_TERMS = 512, 1_024
# Words of texts that a task counts at once.
PIECE_WORDS = 500_000
BROADCAST_TILES = 500_000
DOCUMENTS = -1  # the bucket of the empty term

POSTINGS = (
    "term STRING, block BIGINT, n BIGINT, max_tf BIGINT, min_dl INT, "
    "entries ARRAY<STRUCT<ticket_id: BIGINT, tf: BIGINT, dl: INT>>, bucket INT"
)
COUNTED = "ticket_id BIGINT, dl INT, terms ARRAY<STRING>, tfs ARRAY<BIGINT>"


@dataclass
class LexicalIndex:
    """``docs`` has ``ticket_id`` and length ``dl``; ``n`` and ``avgdl`` are their number and mean length.

    ``narrow`` says that the postings are those of a search's words alone.
    """

    docs: DataFrame
    postings: DataFrame
    n: int
    avgdl: float | None
    narrow: bool = False


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _bucket(term: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _flat(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Lengths of a column's lists, and their elements in one array."""
    lengths = pc.list_value_length(column).to_numpy().astype(np.int64)
    flat = pc.list_flatten(column)
    return lengths, flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in pieces of about ``PIECE_WORDS`` words."""
    words = np.cumsum(pc.list_value_length(batch.column("toks")).to_numpy(), dtype=np.int64)
    cuts = (np.flatnonzero(np.diff(words // PIECE_WORDS)) + 1).tolist()
    for start, end in zip([0, *cuts], [*cuts, batch.num_rows]):
        yield batch.slice(start, end - start)


def _counted(batches: Iterator[pa.RecordBatch], wanted: pa.Array | None) -> Iterator[pa.RecordBatch]:
    """Per text its number of words, its distinct words (among the wanted ones) and how often each occurs."""
    for batch in (piece for batch in batches for piece in _pieces(batch)):
        dl, toks = _flat(batch.column("toks"))
        coded = toks.dictionary_encode()
        codes, terms = coded.indices.to_numpy(), coded.dictionary
        owner = np.repeat(np.arange(len(dl)), dl)
        if wanted is not None:
            kept = pc.is_in(terms, value_set=wanted).to_numpy(zero_copy_only=False)[codes]
            owner, codes = owner[kept], codes[kept]
        pairs, tf = np.unique(owner * max(len(terms), 1) + codes, return_counts=True)
        owner, codes = np.divmod(pairs, max(len(terms), 1))
        at = pa.array(np.searchsorted(owner, np.arange(len(dl) + 1)), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("ticket_id"), pa.array(dl, pa.int32()),
                pa.ListArray.from_arrays(at, terms.take(pa.array(codes, pa.int64()))),
                pa.ListArray.from_arrays(at, pa.array(tf, pa.int64())),
            ],
            names=["ticket_id", "dl", "terms", "tfs"],
        )


def _block_postings(table: pa.Table) -> pa.Table:
    """All rows of one block; rows with one id and length are one document."""
    keys = np.stack([table.column("ticket_id").to_numpy(), table.column("dl").to_numpy()])
    (ids, dl), doc = np.unique(keys, axis=1, return_inverse=True)
    lengths, terms = _flat(table.column("terms"))
    coded = terms.dictionary_encode()
    owner = np.repeat(doc.reshape(-1), lengths)
    pairs, at = np.unique(coded.indices.to_numpy() * np.int64(len(ids)) + owner, return_inverse=True)
    tf = np.bincount(at, _flat(table.column("tfs"))[1].to_numpy(), len(pairs)).astype(np.int64)
    code, owner = np.divmod(pairs, len(ids))
    starts = np.flatnonzero(np.diff(code, prepend=-1))

    # the empty term's row comes last and lists the documents
    def column(term: np.ndarray, document: np.ndarray) -> pa.Array:
        return pa.array(np.concatenate([term, document]))

    def least(x: np.ndarray, ufunc: np.ufunc) -> np.ndarray:
        return ufunc.reduceat(x, starts) if len(starts) else x

    entries = pa.StructArray.from_arrays(
        [column(ids[owner], ids), column(tf, np.ones_like(ids)), column(dl[owner], dl).cast(pa.int32())],
        names=["ticket_id", "tf", "dl"],
    )
    ends = np.concatenate([starts, [len(pairs), len(pairs) + len(ids)]])
    named = pa.concat_arrays([coded.dictionary.take(pa.array(code[starts], pa.int64())), pa.array([""])])
    return pa.table({
        "term": named, "block": pa.array(np.full(len(named), table.column("block")[0].as_py()), pa.int64()),
        "n": column(np.diff(ends[:-1]), np.array([len(ids)])),
        "max_tf": column(least(tf, np.maximum), np.array([1])),
        "min_dl": column(least(dl[owner], np.minimum), np.array([dl.min()])).cast(pa.int32()),
        "entries": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries),
    })


def write_index(
    docs: DataFrame, path: str, fields: tuple[str, ...] = SEARCHABLE, words: DataFrame | None = None,
    block_docs: int = BLOCK_DOCS, buckets: int = BUCKETS,
) -> LexicalIndex:
    """Write the index of ``docs`` to the new folder ``path``.

    Texts are read and tokenized once and shuffled once, as their distinct words.
    ``words`` (``term``) limits the postings to some terms, for a search without a
    stored index. Rows without a ticket id are left out. A frequent term has one
    row per block, so no row grows with the corpus.
    """
    spark = docs.sparkSession
    docs = docs.where("ticket_id IS NOT NULL")
    few, wanted = False, None
    if words is not None:
        words = words.select("term").distinct()
        # few words go to every task, so that all other tokens end in the scan
        few = words.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS
        wanted = spark.sparkContext.broadcast(words.toArrow().column("term").combine_chunks()) if few else None
    toks = docs.select(
        F.col("ticket_id").cast("long").alias("ticket_id"), tokens(F.concat_ws(" ", *[F.col(f) for f in fields])).alias("toks")
    )
    counted = toks.mapInArrow(lambda batches: _counted(batches, wanted.value if wanted else None), COUNTED)
    # blocks of one length class; a class is dealt out by the hash of the id, long texts to more blocks
    n = docs.count()
    step = F.floor(F.log2(F.col("dl") + 1) * LENGTH_STEPS).cast("long")
    long = F.floor(F.pow(F.lit(2.0), step / LENGTH_STEPS) / LONG_WORDS).cast("long") + 1
    block = step * F.lit(2**32) + F.pmod(F.xxhash64("ticket_id"), F.lit(n // (CLASSES * block_docs) + 1) * long)
    schema = POSTINGS.removesuffix(", bucket INT")
    postings = counted.withColumn("block", block).groupBy("block").applyInArrow(_block_postings, schema)
    if words is not None and not few:
        postings = postings.join(words.unionByName(spark.range(1).select(F.lit("").alias("term"))), "term", "left_semi")
    bucket = F.lit(0) if words is not None else _bucket("term", buckets)
    placed = postings.withColumn("bucket", F.when(F.col("term") == "", DOCUMENTS).otherwise(bucket))
    placed.sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(f"{path}/postings")
    return open_index(spark, path, words is not None)


def open_index(spark: SparkSession, path: str, narrow: bool = False) -> LexicalIndex:
    rows = spark.read.schema(POSTINGS).parquet(f"{path}/postings")
    docs = rows.where(F.col("bucket") == DOCUMENTS).select(F.inline("entries")).select("ticket_id", "dl")
    n, avgdl = docs.agg(F.count("*"), F.avg("dl")).first()
    return LexicalIndex(docs, rows.where(F.col("bucket") != DOCUMENTS), n, avgdl, narrow)


def bounds(index: LexicalIndex, weights: DataFrame, part: Column) -> DataFrame:
    """Per (query, block): the bound of a document's score and how many documents it has at least.

    Reads the small columns of the query words' rows alone.
    """
    met = index.postings.select("term", "block", "n", "max_tf", "min_dl").join(weights, "term")
    return met.groupBy("query_id", "block").agg(
        F.sum(F.col("idf") * part).alias("bound"), F.max("n").alias("docs"), F.count("*").alias("words"),
    )


def first_blocks(bounded: DataFrame, needed: DataFrame) -> DataFrame:
    """The blocks of the highest bounds that together hold ``needed`` documents per query."""
    order = Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "block")
    before = F.coalesce(F.sum("docs").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return bounded.join(needed, "query_id").withColumn("_before", before).where("_before < needed").select("query_id", "block")


def further_blocks(bounded: DataFrame, firsts: DataFrame, scored: DataFrame, top: int) -> DataFrame:
    """All other blocks that can reach the k-th score found; with fewer scores found, all others."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "ticket_id")
    kth = scored.withColumn("_r", F.row_number().over(order)).where(F.col("_r") == top).select(
        "query_id", F.col("score").alias("floor")
    )
    rest = bounded.join(firsts, ["query_id", "block"], "left_anti").join(kth, "query_id", "left")
    # scores are rounded to 9 places
    return rest.where("floor IS NULL OR bound + 2e-9 >= floor").select("query_id", "block", "floor")


def _block_scores(found: pa.Table, asked: pa.Table, k1: float, b: float, avgdl: float) -> tuple[np.ndarray, ...]:
    """Hits of some queries in one block: place of the query, id, score, ordered; at most ``needed`` per query."""
    lengths, entries = _flat(found.column("entries"))
    ids, doc = np.unique(entries.field("ticket_id").to_numpy(), return_inverse=True)
    tf, dl = (entries.field(name).to_numpy().astype(np.float64) for name in ("tf", "dl"))
    part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))
    ends = np.concatenate([[0], np.cumsum(lengths)])
    owner = np.repeat(np.arange(len(lengths)), lengths)
    words, listed = _flat(asked.column("words"))
    terms = found.column("term").combine_chunks()
    place = pc.index_in(listed.field("term"), value_set=terms).fill_null(-1).to_numpy()
    query, idf = np.repeat(np.arange(len(words)), words), listed.field("idf").to_numpy()
    scores = np.zeros((len(words), len(ids)))
    for at in range(0, len(lengths), TILE_TERMS):
        size = min(TILE_TERMS, len(lengths) - at)
        rows = slice(ends[at], ends[at + size])
        parts = np.bincount((owner[rows] - at) * len(ids) + doc[rows], part[rows], size * len(ids)).reshape(size, -1)
        met = (place >= at) & (place < at + size)
        weights = np.bincount(query[met] * size + place[met] - at, idf[met], len(words) * size).reshape(-1, size)
        scores += weights @ parts
    needed = asked.column("needed").to_numpy()
    floor = asked.column("floor").to_numpy().astype(np.float64)
    floor = np.where(np.isnan(floor), 0.0, floor - 2e-9)
    most = int(needed.max())
    if most < len(ids):
        kth = np.partition(scores, len(ids) - most, axis=1)[:, len(ids) - most]
        floor = np.maximum(floor, kth - 2e-9)  # scores are rounded to 9 places
    q, d = np.nonzero((scores > 0) & (scores >= floor[:, None]))
    s = np.round(scores[q, d], 9)
    order = np.lexsort((d, -s, q))
    q, d, s = q[order], d[order], s[order]
    kept = np.arange(len(q)) - np.searchsorted(q, q) < needed[q]
    return q[kept], ids[d[kept]], s[kept]


def _scores(
    index: LexicalIndex, weights: DataFrame, blocks: DataFrame, withheld: DataFrame | None, needed: DataFrame,
    k1: float, b: float,
) -> DataFrame:
    """The best scores of the documents in the given (query, block) pairs, at least ``needed`` per pair where it has them.

    The rows of a block go once to a tile of queries; a document is in one
    block, so its sum needs no further shuffle.
    """
    avgdl = index.avgdl or 1.0
    if "floor" not in blocks.columns:
        blocks = blocks.withColumn("floor", F.lit(None).cast("double"))
    tiles = -(-needed.count() // TILE_QUERIES)
    tiled = blocks.withColumn("tile", F.pmod(F.xxhash64("query_id"), F.lit(max(tiles, 1))).cast("int"))
    tiled = stored(tiled, scratch_folder(blocks.sparkSession))
    met = tiled.select(F.col("block").alias("block"), F.col("tile").alias("tile")).distinct()
    if met.limit(BROADCAST_TILES + 1).count() <= BROADCAST_TILES:
        met = F.broadcast(met)
    found = index.postings.select("term", "block", "entries").join(met, "block")
    words = weights.groupBy("query_id").agg(F.collect_list(F.struct("term", "idf")).alias("words"))
    asked = tiled.join(words.join(needed, "query_id"), "query_id")
    kind = weights.schema["query_id"].dataType

    def score(rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not rows.num_rows or not queries.num_rows:
            empty = pa.array([], pa.int64())
            return pa.table({"query_id": queries.column("query_id").slice(0, 0), "ticket_id": empty, "score": empty.cast(pa.float64())})
        q, ids, s = _block_scores(rows, queries, k1, b, avgdl)
        return pa.table({"query_id": queries.column("query_id").take(pa.array(q)), "ticket_id": pa.array(ids), "score": pa.array(s)})

    scored = found.groupBy("block", "tile").cogroup(asked.groupBy("block", "tile")).applyInArrow(
        score, f"query_id {kind.simpleString()}, ticket_id long, score double"
    )
    return scored if withheld is None else scored.join(withheld, ["query_id", "ticket_id"], "left_anti")


def query_words(queries: DataFrame) -> DataFrame:
    """Distinct ``(query_id, term)``."""
    return queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).distinct()


def bm25_search(
    index: LexicalIndex, queries: DataFrame, top: int, k1: float = D.BM25_K1, b: float = D.BM25_B,
) -> DataFrame:
    """Top ``top`` documents per query: ``(query_id, ticket_id, score, rank)``.

    ``queries`` has ``query_id, text`` and may have ``exclude_id``; a query with
    several ids to withhold has several rows. A query without words matches
    every document with score 1. Scores are rounded to 9 places: copies of a
    document tie exactly, whatever the order of summation, and go by id. The
    plan is the same for any number of queries, and nothing that grows with the
    corpus or the queries passes the driver.
    """
    spark = queries.sparkSession
    folder = scratch_folder(spark)
    n, avgdl = index.n, index.avgdl
    withheld = None
    if "exclude_id" in queries.columns:
        withheld = queries.select("query_id", F.col("exclude_id").cast("long").alias("ticket_id")).where(
            "ticket_id IS NOT NULL"
        ).distinct()

    def part(tf: str, dl: str) -> Column:
        return F.col(tf) * (k1 + 1) / (F.col(tf) + k1 * (1 - b + b * F.col(dl) / (avgdl or 1.0)))

    asked = query_words(queries)
    if not index.narrow:
        # one pass over the stored rows; few words go to every task, so that no other row is shuffled
        terms = asked.select("term").distinct()
        few = terms.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS
        rows = index.postings.join(F.broadcast(terms) if few else terms, "term", "left_semi")
        index = LexicalIndex(index.docs, stored(rows, f"{folder}/narrow"), n, avgdl, True)
    df = index.postings.select("term", "n").groupBy("term").agg(F.sum("n").alias("df"))
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = stored(asked.join(df, "term").select("query_id", "term", idf.alias("idf")), f"{folder}/weights")
    bounded = stored(bounds(index, weights, part("max_tf", "min_dl")), f"{folder}/bounds")

    needed = weights.select("query_id").distinct().withColumn("needed", F.lit(top).cast("long"))
    if withheld is not None:
        more = withheld.groupBy("query_id").agg(F.count("*").alias("more"))
        needed = needed.join(more, "query_id", "left").select(
            "query_id", (F.col("needed") + F.coalesce("more", F.lit(0))).alias("needed")
        )
    firsts = first_blocks(bounded, needed)
    early = stored(
        top_per_query(_scores(index, weights, firsts, withheld, needed, k1, b), top).drop("rank"), f"{folder}/early"
    )
    others = further_blocks(bounded, firsts, early, top)
    scored = early.unionByName(_scores(index, weights, others, withheld, needed, k1, b))
    return top_per_query(scored, top).unionByName(_match_all(index, queries, withheld, top))


def _match_all(index: LexicalIndex, queries: DataFrame, withheld: DataFrame | None, top: int) -> DataFrame:
    """Queries without words take the first documents in id order."""
    empty = queries.groupBy("query_id").agg(F.max(F.size(tokens(F.col("text")))).alias("words")).where("words = 0")
    empty = empty.select("query_id")
    most = 0
    if withheld is not None:
        per_query = withheld.join(empty, "query_id", "left_semi").groupBy("query_id").count()
        most = per_query.agg(F.max("count")).first()[0] or 0
    first = index.docs.select("ticket_id").distinct().orderBy("ticket_id").limit(top + most).withColumn(
        "pos", F.row_number().over(Window.orderBy("ticket_id"))  # of these few rows
    )
    asked = empty.withColumn("pos", F.explode(F.sequence(F.lit(1), F.lit(top + most))))
    pairs = asked.join(first, "pos").drop("pos")
    if withheld is not None:
        pairs = pairs.join(withheld, ["query_id", "ticket_id"], "left_anti")
    return top_per_query(pairs.withColumn("score", F.lit(1.0)), top)


def top_per_query(scored: DataFrame, top: int | None) -> DataFrame:
    """Rank by score, ties to the smaller id; the cut also runs before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("ticket_id"))
    ranked = scored.withColumn("rank", F.row_number().over(order))
    return ranked if top is None else ranked.filter(F.col("rank") <= top)


def bm25_scores(
    docs: DataFrame, queries: DataFrame, top: int, fields: tuple[str, ...] = SEARCHABLE,
    k1: float = D.BM25_K1, b: float = D.BM25_B, index: LexicalIndex | None = None,
) -> DataFrame:
    """:func:`bm25_search` in ``index``, or else in one of ``docs`` limited to the words of the queries."""
    if index is None:
        words = query_words(queries).select("term")
        index = write_index(docs, scratch_folder(docs.sparkSession), fields, words)
    return bm25_search(index, queries, top, k1, b)
