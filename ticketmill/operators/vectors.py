"""Embedding and exact nearest neighbours.

The arithmetic is numpy inside Spark tasks; Spark partitions the documents and
merges the per-task top-k lists.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

HITS = "query_id long, ticket_id long, score double"
# Largest query matrix sent to every executor, in bytes; beyond it queries and
# documents are both cut into blocks.
BROADCAST_BYTES = 32 << 20
_BLOCK_DOCS = 50_000
# Queries and documents whose scores a task holds at once: 16 MB, whatever the number of queries.
TILE_QUERIES, TILE_DOCS = 512, 4_096


UPPER = {c: c + 32 for c in range(65, 91)}  # A-Z


def hashing_vector(texts: list[str], dims: int = 64) -> list[list[float]]:
    """Default embedding: signed feature hashing of words, unit length.

    Words are runs without ASCII white space, A-Z in lower case. The first four
    bytes of a word's MD5 choose the place and its top bit the sign; each
    distinct word is hashed once per call.
    """
    listed = [re.findall(r"[^\x20\x09-\x0D]+", text.translate(UPPER)) for text in texts]
    hashes = {w: int.from_bytes(hashlib.md5(w.encode()).digest()[:4]) for words in listed for w in set(words)}
    out = []
    for words in listed:
        h = np.array([hashes[w] for w in words], np.int64)
        v = np.bincount(h % dims, np.where(h & 0x80000000, 1.0, -1.0), dims) if len(h) else np.zeros(dims)
        norm = np.float32(np.sqrt((v * v).sum()))
        out.append((v.astype(np.float32) / norm if norm else v).tolist())
    return out


def embed_documents(
    df: DataFrame, embed_fn: Callable[[list[str]], list[list[float]]] = hashing_vector,
    batch_size: int = 16,
) -> DataFrame:
    """Add ``symptom_vector`` and ``resolution_vector``; row order is kept.

    ``embed_fn`` gets at most ``batch_size`` texts per call, inside the tasks;
    only the texts go to it, the other columns stay where they are.
    """

    def embed(texts: pd.Series) -> pd.Series:
        listed = texts.fillna("").tolist()
        vectors: list[list[float]] = []
        for at in range(0, len(listed), batch_size):
            vectors.extend(embed_fn(listed[at : at + batch_size]))
        return pd.Series(vectors, index=texts.index, dtype=object)

    vector = F.pandas_udf(embed, T.ArrayType(T.FloatType()))
    return df.withColumns({"symptom_vector": vector("symptom_text"), "resolution_vector": vector("resolution_text")})


def matrix_of(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(-1, max(dim, 1))
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)


class TopK:
    """Running top-k per query over batches of document scores.

    The best so far lie flat, one entry per hit: place of the query, score, id.
    """

    def __init__(self, qids: np.ndarray, exclude: np.ndarray | None, k: int):
        self.qids, self.exclude, self.k = qids, exclude, k
        # per block of queries, and the k-th score of every query with its id
        self.best = [(np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))] * -(-len(qids) // TILE_QUERIES)
        self.floor, self.last = np.full(len(qids), -np.inf), np.full(len(qids), np.iinfo(np.int64).max)

    def add(self, block: int, ids: np.ndarray, order: np.ndarray, scores: np.ndarray) -> None:
        """``scores`` is (query of the block x document); minus infinity means no hit.

        ``order`` sorts ``ids``. Equal scores go to the smaller id.
        """
        first = block * TILE_QUERIES
        queries = slice(first, first + len(scores))
        if self.exclude is not None:
            own = self.exclude[queries]
            lo, hi = (np.searchsorted(ids, own, side, sorter=order) for side in ("left", "right"))
            for q in np.flatnonzero(hi > lo):
                scores[q, order[lo[q] : hi[q]]] = -np.inf
        floor = self.floor[queries].copy()
        new = np.flatnonzero(floor == -np.inf)
        if len(new) and len(ids) > self.k:
            floor[new] = np.partition(scores[new], len(ids) - self.k, axis=1)[:, len(ids) - self.k]
        # rounding moves a score by less than this
        q, d = np.nonzero((scores >= floor[:, None] - 1e-12) & (scores > -np.inf))
        # rounding lets copies tie exactly
        s, i = np.round(scores[q, d], 12), ids[d]
        above = (s > self.floor[first + q]) | ((s == self.floor[first + q]) & (i < self.last[first + q]))
        if not above.any():
            return
        q, s, i = (np.concatenate([old, x[above]]) for old, x in zip(self.best[block], (q, s, i)))
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        kth = place == self.k - 1
        self.floor[first + q[kth]], self.last[first + q[kth]] = s[kth], i[kth]
        kept = place < self.k
        self.best[block] = (q[kept], s[kept], i[kept])

    def batch(self) -> pa.RecordBatch:
        queries = [n * TILE_QUERIES + q for n, (q, _, _) in enumerate(self.best)]
        cat = (lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(self.qids[cat(queries, np.int64)], pa.int64()),
                pa.array(cat([i for _, _, i in self.best], np.int64), pa.int64()),
                pa.array(cat([s for _, s, _ in self.best], np.float64), pa.float64()),
            ],
            names=["query_id", "ticket_id", "score"],
        )


def add_vectors(best: TopK, qmat: np.ndarray, ids: np.ndarray, mat: np.ndarray, step: int = TILE_DOCS) -> None:
    """The documents' scores, in tiles of a bounded number of queries and documents."""
    for at in range(0, len(ids), step):
        some, rows = ids[at : at + step], mat[at : at + step].T
        order = np.argsort(some, kind="stable")
        for block in range(len(best.best)):
            first = block * TILE_QUERIES
            best.add(block, some, order, qmat[first : first + TILE_QUERIES] @ rows)


def query_arrays(table: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    table = table.combine_chunks()
    qids = table.column("query_id").to_numpy()
    vectors = table.column("vector")
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    exclude = table.column("exclude_id").to_numpy()
    return qids, matrix_of(vectors, dim), exclude


def knn(docs: DataFrame, queries: DataFrame, k: int, vector: str = "symptom_vector",
        broadcast_bytes: int = BROADCAST_BYTES, dim: int | None = None) -> DataFrame:
    """Exact cosine k-NN: ``(query_id, ticket_id, score, rank)``.

    The size of the query matrix is measured first. A small one goes to every
    task, which streams its documents past it and emits k rows per query. A
    large one is cut into blocks that meet blocks of documents in co-grouped
    tasks of bounded size.

    Only vectors of width ``dim`` (by default the widest of the queries) without
    a null take part, on both sides; a query without one has no hits.
    """
    exclude = F.col("exclude_id") if "exclude_id" in queries.columns else F.lit(None)
    q = queries.select(
        F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<float>").alias("vector"),
        F.coalesce(exclude.cast("long"), F.lit(-(2**63))).alias("exclude_id"),
    )
    if dim is None:
        dim = q.agg(F.max(F.size("vector"))).first()[0] or 0
    whole = (F.size("vector") == max(dim, 0)) & ~F.exists("vector", lambda x: x.isNull())
    q = q.filter(F.col("query_id").isNotNull() & whole)
    n = q.count()
    d = docs.select(
        F.col("ticket_id").cast("long").alias("ticket_id"), F.col(vector).cast("array<float>").alias("vector")
    ).filter(F.col("ticket_id").isNotNull() & whole)
    if n * dim * 8 <= broadcast_bytes:
        partial = _knn_broadcast(d, q, k, dim)
    else:
        partial = _knn_blocks(d, q, k, dim, -(-n * dim * 8 // broadcast_bytes))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("ticket_id"))
    return partial.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _knn_broadcast(docs: DataFrame, queries: DataFrame, k: int, dim: int) -> DataFrame:
    qids, qmat, exclude = query_arrays(queries.toArrow(), dim)
    shared = docs.sparkSession.sparkContext.broadcast((qids, qmat, exclude))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix, withheld = shared.value
        best = TopK(ids, withheld, k)
        for batch in batches:
            if batch.num_rows:
                add_vectors(best, matrix, batch.column("ticket_id").to_numpy(), matrix_of(batch.column("vector"), dim))
        yield best.batch()

    return docs.mapInArrow(score, HITS)


def _knn_blocks(docs: DataFrame, queries: DataFrame, k: int, dim: int, q_blocks: int) -> DataFrame:
    d_blocks = max(1, -(-docs.count() // _BLOCK_DOCS))

    def block(col: str, n: int):
        return F.pmod(F.xxhash64(col), F.lit(n)).cast("int")

    def every(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    d = docs.withColumn("db", block("ticket_id", d_blocks)).withColumn("qb", every(q_blocks))
    q = queries.withColumn("qb", block("query_id", q_blocks)).withColumn("db", every(d_blocks))

    def score(doc_table: pa.Table, query_table: pa.Table) -> pa.Table:
        if not query_table.num_rows or not doc_table.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "ticket_id": pa.array([], pa.int64()),
                             "score": pa.array([], pa.float64())})
        ids, matrix, withheld = query_arrays(query_table, dim)
        best = TopK(ids, withheld, k)
        for batch in doc_table.to_batches():
            add_vectors(best, matrix, batch.column("ticket_id").to_numpy(), matrix_of(batch.column("vector"), dim))
        return pa.Table.from_batches([best.batch()])

    return d.groupBy("db", "qb").cogroup(q.groupBy("db", "qb")).applyInArrow(score, HITS)
