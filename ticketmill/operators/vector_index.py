"""Exact cosine k-NN over a stored inverted file with metric pruning.

Unit vectors are assigned to the nearest of some centroids and lie in rings
around it. Between unit vectors the cosine is ``1 - d * d / 2`` of the distance
``d``, and by the triangle inequality a vector of a ring is at least as far from
a query as the query is from the ring. A search reads, per query, the nearest
cells until they hold enough vectors, and then only those whose bound reaches
the k-th score found. The result is that of the full comparison.

Layout below a folder: ``vectors`` (``ticket_id, vector, cell, part``), sorted by
cell, ``cells`` (``cell, n, low, high, parts``) and ``centroids`` (``list, centroid``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ticketmill.operators.vectors import HITS, TopK, add_vectors, matrix_of, query_arrays
from ticketmill.session import scratch_folder

# Vectors the centroids are fitted on, at most; lists at most; rings of a list.
SAMPLE = 20_000
MAX_LISTS = 4_096
RINGS = 16
# Vectors of a cell, and queries, that meet in one task.
CELL_DOCS = 50_000
TASK_QUERIES = 10_000
# Pairs of a query, with its vector, and a cell that a task holds at once.
PICKED_PAIRS = 100_000
# More than the rounding of scores and distances.
SLACK = 1e-9
NOWHERE = -1  # the cell of vectors without direction: their score is 0 with everything

VECTORS = "ticket_id BIGINT, vector ARRAY<FLOAT>, cell BIGINT, part INT"
CELLS = "cell BIGINT, n BIGINT, low DOUBLE, high DOUBLE, parts INT"
CENTROIDS = "list INT, centroid ARRAY<DOUBLE>"


@dataclass
class VectorIndex:
    vectors: DataFrame
    cells: DataFrame
    centroids: DataFrame


def usable(vector: str, dim: int) -> Column:
    """Vectors of the right width without a null."""
    return (F.size(vector) == max(dim, 0)) & ~F.exists(vector, lambda x: x.isNull())


def fit_centroids(sample: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """k-means on unit vectors, started at evenly spaced rows; lists without a vector go."""
    lists = min(lists, len(sample))
    centroids = sample[np.linspace(0, len(sample) - 1, lists).astype(int)] if lists else sample[:0]
    for _ in range(rounds):
        if not len(centroids):
            break
        nearest = np.argmax(sample @ centroids.T - (centroids**2).sum(1) / 2, axis=1)
        centroids = np.array([sample[nearest == k].mean(0) for k in np.unique(nearest)])
    return centroids


def _distances(unit: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    squares = (unit**2).sum(1)[:, None] + (centroids**2).sum(1)[None, :] - 2 * unit @ centroids.T
    return np.sqrt(np.maximum(squares, 0))


def write_index(
    docs: DataFrame, path: str, lists: int = 256, vector: str = "symptom_vector", dim: int | None = None,
) -> VectorIndex:
    """Write the index of ``docs`` (``ticket_id`` and a vector column) to the new folder ``path``.

    The centroids are fitted on at most ``SAMPLE`` vectors, those of the
    smallest hash of the id; every vector is assigned and kept. Rows without an
    id, and vectors that are not ``dim`` wide (by default the widest) or hold a
    null, are left out. A cell with very many vectors, such as copies, is dealt
    into parts.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col("ticket_id").cast("long").alias("ticket_id"), F.col(vector).cast("array<float>").alias("vector")
    ).where("ticket_id IS NOT NULL")
    if dim is None:
        dim = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    rows = rows.where(usable("vector", dim))
    drawn = rows.orderBy(F.xxhash64("ticket_id"), "ticket_id").limit(SAMPLE).select("vector").toArrow()
    unit = matrix_of(drawn.column("vector").combine_chunks(), dim)
    centroids = fit_centroids(unit[unit.any(1)], min(lists, MAX_LISTS))
    shared = spark.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = matrix_of(batch.column("vector"), dim)
            cell, near = np.full(len(unit), NOWHERE), np.zeros(len(unit))
            for at in range(0, len(unit), 4096):
                some = unit[at : at + 4096]
                if len(shared.value):
                    far = _distances(some, shared.value)
                    best = far.argmin(1)
                    near[at : at + 4096] = far[np.arange(len(some)), best]
                    ring = np.minimum((near[at : at + 4096] * RINGS / 2).astype(int), RINGS - 1)
                    cell[at : at + 4096] = np.where(some.any(1), best * RINGS + ring, NOWHERE)
            yield pa.RecordBatch.from_arrays(
                [batch.column("ticket_id"), batch.column("vector"), pa.array(cell, pa.int64()), pa.array(near)],
                ["ticket_id", "vector", "cell", "far"],
            )

    folder = scratch_folder(spark)
    schema = "ticket_id long, vector array<float>, cell long, far double"
    rows.mapInArrow(assign, schema).write.parquet(folder)
    assigned = spark.read.schema(schema).parquet(folder)
    cells = assigned.groupBy("cell").agg(
        F.count("*").alias("n"), F.min("far").alias("low"), F.max("far").alias("high"),
        F.ceil(F.count("*") / CELL_DOCS).cast("int").alias("parts"),
    )
    cells.coalesce(1).write.parquet(f"{path}/cells")
    # lists times rings, at most
    parts = F.broadcast(spark.read.schema(CELLS).parquet(f"{path}/cells").select("cell", "parts"))
    placed = assigned.join(parts, "cell").select(
        "ticket_id", "vector", "cell", F.pmod(F.xxhash64("ticket_id"), "parts").cast("int").alias("part")
    )
    placed.repartitionByRange("cell", "part").sortWithinPartitions("cell", "part").write.parquet(f"{path}/vectors")
    listed = [(k, [float(x) for x in c]) for k, c in enumerate(centroids)]
    spark.createDataFrame(listed, CENTROIDS).coalesce(1).write.parquet(f"{path}/centroids")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    def read(name: str, schema: str) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{path}/{name}")

    return VectorIndex(read("vectors", VECTORS), read("cells", CELLS), read("centroids", CENTROIDS))


def wanted_cells(queries: DataFrame, model: tuple, dim: int, k: int | None) -> DataFrame:
    """``(query_id, vector, cell)`` of the cells a query must read.

    With ``k``, the nearest cells that together hold that many vectors and the
    query's withheld ones (``more``); else the cells beyond those (``more``)
    whose bound reaches the query's ``floor``.
    """
    shared = queries.sparkSession.sparkContext.broadcast(model)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, cell, n, low, high = shared.value
        step = max(1, PICKED_PAIRS // max(len(cell), 1))
        for batch in (whole.slice(at, step) for whole in batches for at in range(0, whole.num_rows, step)):
            unit = matrix_of(batch.column("vector"), dim)
            more, floor = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("more", "floor"))
            rows, picked = [], []
            for i in range(len(unit)):
                bound = np.zeros(len(cell))
                if len(centroids) and unit[i].any():
                    far = _distances(unit[i : i + 1], centroids)[0][np.maximum(cell, 0) // RINGS]
                    gap = np.maximum(np.maximum(far - high, low - far) - SLACK, 0)
                    bound = np.where(cell == NOWHERE, 0.0, 1 - gap**2 / 2)
                order = np.lexsort((cell, -bound))
                before = np.cumsum(n[order]) - n[order]
                first = before < (k or 0) + more[i]
                if k is None:
                    chosen = order[~first & (bound[order] + SLACK >= floor[i])]
                else:
                    chosen = order[first]
                rows.append(np.full(len(chosen), i))
                picked.append(cell[chosen])
            at = pa.array(np.concatenate(rows) if rows else np.empty(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("query_id").take(at), batch.column("vector").take(at),
                 pa.array(np.concatenate(picked) if picked else np.empty(0, np.int64), pa.int64())],
                ["query_id", "vector", "cell"],
            )

    asked = queries.select("query_id", "vector", "more", "floor")
    return asked.mapInArrow(pick, "query_id long, vector array<float>, cell long")


def _score(index: VectorIndex, wanted: DataFrame, dim: int, k: int, task_queries: int) -> DataFrame:
    """The k best of every query within each task's cell part."""
    blocks = wanted.select("query_id").distinct().count() // task_queries + 1
    asked = wanted.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    met = asked.select(F.col("cell").alias("_c"), F.col("qb").alias("_q")).distinct()
    docs = index.vectors.join(met, F.col("cell") == F.col("_c")).select("ticket_id", "vector", "cell", "part", F.col("_q").alias("qb"))
    asked = asked.join(index.cells.select("cell", "parts"), "cell").select(
        "query_id", "vector", "cell", "qb", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
        F.lit(None).cast("long").alias("exclude_id"),
    )

    def score(found: pa.Table, table: pa.Table) -> pa.Table:
        if not table.num_rows or not found.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "ticket_id": pa.array([], pa.int64()),
                             "score": pa.array([], pa.float64())})
        ids, matrix, _ = query_arrays(table, dim)
        best = TopK(ids, None, k)
        for batch in found.to_batches():
            add_vectors(best, matrix, batch.column("ticket_id").to_numpy(), matrix_of(batch.column("vector"), dim))
        return pa.Table.from_batches([best.batch()])

    keys = ["cell", "part", "qb"]
    return docs.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(score, HITS)


def knn(index: VectorIndex, queries: DataFrame, k: int) -> DataFrame:
    """Exact cosine k-NN: ``(query_id, ticket_id, score, rank)``, as :func:`~ticketmill.operators.vectors.knn`.

    ``queries`` has ``query_id, vector`` and may have ``exclude_id``, in several
    rows for several ids. Only the cells (lists times rings, at most 65,536 small
    rows) and the centroids pass the driver.
    """
    spark = queries.sparkSession
    folder = scratch_folder(spark)
    listed = index.centroids.orderBy("list").toArrow().column("centroid").combine_chunks()
    dim = index.vectors.agg(F.max(F.size("vector"))).first()[0] or 0
    centroids = listed.flatten().to_numpy().reshape(len(listed), -1) if len(listed) else np.empty((0, dim))
    cells = index.cells.orderBy("cell").toArrow()
    model = (centroids, *(cells.column(c).to_numpy() for c in ("cell", "n", "low", "high")))

    q = queries.select(
        F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<float>").alias("vector")
    ).where(F.col("query_id").isNotNull() & usable("vector", dim)).dropDuplicates(["query_id"])
    q = q.withColumns({"more": F.lit(0).cast("long"), "floor": F.lit(None).cast("double")})
    withheld = None
    if "exclude_id" in queries.columns:
        withheld = queries.select(
            F.col("query_id").cast("long").alias("query_id"), F.col("exclude_id").cast("long").alias("ticket_id")
        ).where("query_id IS NOT NULL AND ticket_id IS NOT NULL").distinct()
        number = withheld.groupBy("query_id").agg(F.count("*").alias("_n"))
        q = q.join(number, "query_id", "left").withColumn("more", F.coalesce("_n", "more")).drop("_n")
    most = 0 if withheld is None else q.agg(F.max("more")).first()[0] or 0

    def ranked(scored: DataFrame) -> DataFrame:
        if withheld is not None:
            scored = scored.join(withheld, ["query_id", "ticket_id"], "left_anti")
        order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("ticket_id"))
        return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    near = _kept(wanted_cells(q, model, dim, k), f"{folder}/near")
    early = _kept(ranked(_score(index, near, dim, k + most, TASK_QUERIES)).drop("rank"), f"{folder}/early")
    kth = early.groupBy("query_id").agg(F.min("score").alias("_s"), F.count("*").alias("_n")).where(F.col("_n") >= k)
    floors = q.drop("floor").join(kth.select("query_id", F.col("_s").alias("floor")), "query_id", "left").withColumns(
        {"floor": F.coalesce("floor", F.lit(float("-inf"))), "more": F.col("more") + k}
    )
    far = _kept(wanted_cells(floors, model, dim, None), f"{folder}/far")
    late = _score(index, far, dim, k + most, TASK_QUERIES)
    return ranked(early.unionByName(late))


def _kept(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
