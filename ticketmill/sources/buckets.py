"""Tables in hash buckets: a manifest names the live folders of each bucket.

Rows lie in ``data/<part>/b=<bucket>`` by the hash of their key. Each version is
a manifest ``(bucket, part)``, written as a whole by :mod:`snapshots`, so readers
see complete versions only. An upsert or delete rewrites the buckets that hold
its keys; all others keep their files. An append adds a delta to the buckets it
touches, and compaction folds deltas into one. One writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketmill.operators import corpus
from ticketmill.sources import snapshots

BUCKETS = 256
MANIFEST = "bucket INT, part STRING"
# Deltas of a bucket from which compaction rewrites it.
MAX_DELTAS = 8


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict[int, list[str]]:
    """Live parts by bucket: one entry per bucket and delta, however large the table."""
    if version is None:
        rows = snapshots.read_latest(spark, f"{path}/manifest", MANIFEST)
    else:
        rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest/v={version}")
    live: dict[int, list[str]] = {}
    for bucket, part in rows.orderBy("bucket", "part").collect():
        live.setdefault(bucket, []).append(part)
    return live


def _publish(spark: SparkSession, path: str, live: dict[int, list[str]]) -> int:
    rows = [(bucket, part) for bucket, parts in sorted(live.items()) for part in parts]
    return snapshots.write_version(spark.createDataFrame(rows, MANIFEST).coalesce(1), f"{path}/manifest")


def read(
    spark: SparkSession, path: str, schema: T.StructType | str, only: Iterable[int] | None = None,
    version: int | None = None,
) -> DataFrame:
    """The rows of a version, or of some of its buckets; other folders are not opened."""
    live = manifest(spark, path, version)
    wanted = live if only is None else {b: live[b] for b in only if b in live}
    folders = [f"{path}/data/{part}/b={bucket}" for bucket, parts in wanted.items() for part in parts]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*folders)


def touched_buckets(keys: DataFrame, key: str, buckets: int) -> list[int]:
    """The buckets that hold some keys: numbers below ``buckets``."""
    rows = keys.select(bucket_of(key, buckets).alias("b")).where("b IS NOT NULL").distinct().collect()
    return sorted(r[0] for r in rows)


def _write(rows: DataFrame, path: str, key: str, buckets: int, part: str) -> list[int]:
    """Rows into the folders of a part; returns the buckets that got some."""
    # rebalancing cuts a bucket with very many rows into several files
    dealt = rows.withColumn("b", bucket_of(key, buckets)).hint("rebalance", "b")
    dealt.write.mode("overwrite").partitionBy("b").parquet(f"{path}/data/{part}")
    jvm = rows.sparkSession.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/data/{part}")
    fs = folder.getFileSystem(rows.sparkSession.sparkContext._jsc.hadoopConfiguration())
    names = [entry.getPath().getName() for entry in fs.listStatus(folder)]
    return sorted(int(name[2:]) for name in names if name.startswith("b="))


def rewrite(
    spark: SparkSession, path: str, schema: T.StructType | str, key: str, keys: DataFrame,
    change: Callable[[DataFrame], DataFrame], buckets: int = BUCKETS,
) -> int:
    """Apply ``change`` to the rows of the buckets that hold ``keys``; returns the new version.

    ``change`` gets those rows and returns what shall stand in their place; it
    may only bring rows whose keys are among ``keys``.
    """
    touched = touched_buckets(keys, key, buckets)
    live = manifest(spark, path)
    part = uuid.uuid4().hex
    filled = _write(change(read(spark, path, schema, touched)), path, key, buckets, part) if touched else []
    live = {b: parts for b, parts in live.items() if b not in set(touched)} | {b: [part] for b in filled}
    return _publish(spark, path, live)


def upsert(
    spark: SparkSession, path: str, schema: T.StructType | str, updates: DataFrame, key: str = "id",
    buckets: int = BUCKETS,
) -> int:
    """:func:`~ticketmill.operators.corpus.upsert_documents` in the touched buckets; rows with a null key are left out."""
    updates = updates.where(F.col(key).isNotNull())
    return rewrite(
        spark, path, schema, key, updates, lambda rows: corpus.upsert_documents(rows, updates, key), buckets
    )


def delete(
    spark: SparkSession, path: str, schema: T.StructType | str, ids: DataFrame, key: str = "id", buckets: int = BUCKETS
) -> int:
    return rewrite(spark, path, schema, key, ids, lambda rows: corpus.delete_documents(rows, ids, key), buckets)


def append(rows: DataFrame, path: str, key: str, buckets: int = BUCKETS, part: str | None = None) -> int:
    """Add rows as a delta; a named ``part`` that the table already has changes nothing."""
    spark = rows.sparkSession
    live = manifest(spark, path)
    part = part or uuid.uuid4().hex
    if any(part in parts for parts in live.values()):
        return snapshots.latest_version(spark, f"{path}/manifest")
    for bucket in _write(rows.where(F.col(key).isNotNull()), path, key, buckets, part):
        live.setdefault(bucket, []).append(part)
    return _publish(spark, path, live)


def compact(
    spark: SparkSession, path: str, schema: T.StructType | str, key: str, buckets: int = BUCKETS,
    max_deltas: int = MAX_DELTAS,
) -> int | None:
    """Fold the deltas of buckets with more than ``max_deltas`` into one part; none such, no new version."""
    live = manifest(spark, path)
    many = [b for b, parts in live.items() if len(parts) > max_deltas]
    if not many:
        return None
    part = uuid.uuid4().hex
    filled = _write(read(spark, path, schema, many), path, key, buckets, part)
    return _publish(spark, path, live | {b: [part] for b in filled})


def expire(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Drop all but the last ``keep`` versions and the folders no kept version names; returns the parts dropped."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(f"{path}/data")
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    versions = snapshots.versions(spark, f"{path}/manifest")
    kept = versions[-max(keep, 1) :]
    needed = {(b, part) for v in kept for b, parts in manifest(spark, path, v).items() for part in parts}
    for version in versions[: len(versions) - len(kept)]:
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/v={version}"), True)
    dropped = []
    for entry in fs.listStatus(root) if fs.exists(root) else []:
        part = entry.getPath().getName()
        for inner in fs.listStatus(entry.getPath()):
            name = inner.getPath().getName()
            if name.startswith("b=") and (int(name[2:]), part) not in needed:
                fs.delete(inner.getPath(), True)
                dropped.append(f"{part}/{name}")
    return sorted(dropped)
