"""Tables appended per (query id, epoch), visible once committed.

A micro-batch writes its tables into folders of an attempt of its own and then
commits the attempt under its query id and epoch. A repeated epoch finds its
commit and changes nothing; an attempt that died is never read; a query that
starts with a fresh checkpoint has a new id and cannot meet earlier epochs.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PLACE = "query STRING, epoch BIGINT, attempt STRING"
KEYS = ["query", "epoch", "attempt"]


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def committed(spark: SparkSession, root: str, query: str, epoch: int) -> str | None:
    """The attempt that holds an epoch, if there is one."""
    fs, place = _files(spark, f"{root}/commits/{query}.{epoch}.json")
    if not fs.exists(place):
        return None
    return spark.read.schema("attempt STRING").json(f"{root}/commits/{query}.{epoch}.json").first()[0]


def write_epoch(tables: dict[str, DataFrame], root: str, query: str, epoch: int) -> str:
    """Write the tables of an epoch and commit them together; returns the attempt that counts.

    The commit is a file created only where none is, so of two attempts of one
    epoch the first to finish counts.
    """
    spark = next(iter(tables.values())).sparkSession
    if (done := committed(spark, root, query, epoch)) is not None:
        return done
    attempt = uuid.uuid4().hex
    for name, rows in tables.items():
        rows.write.parquet(folder(root, name, query, epoch, attempt))
    fs, place = _files(spark, f"{root}/commits/{query}.{epoch}.json")
    entry = json.dumps({"query": query, "epoch": epoch, "attempt": attempt, "tables": sorted(tables)})
    fs.mkdirs(place.getParent())
    # complete under a hidden name first; the rename fails where an entry stands
    _, hidden = _files(spark, f"{root}/commits/_{attempt}")
    out = fs.create(hidden, False)
    out.write(bytearray(entry.encode()))
    out.close()
    if not fs.exists(place) and fs.rename(hidden, place):
        return attempt
    fs.delete(hidden, False)
    return committed(spark, root, query, epoch)


def folder(root: str, table: str, query: str, epoch: int, attempt: str) -> str:
    return f"{root}/{table}/query={query}/epoch={epoch}/attempt={attempt}"


def commit_log(spark: SparkSession, root: str) -> DataFrame:
    """``query, epoch, attempt, tables`` of every committed epoch."""
    schema = f"{PLACE}, tables ARRAY<STRING>"
    fs, place = _files(spark, f"{root}/commits")
    return spark.read.schema(schema).json(f"{root}/commits") if fs.exists(place) else spark.createDataFrame([], schema)


def read_table(spark: SparkSession, root: str, table: str, schema: str) -> DataFrame:
    """Committed rows of a table; folders of other attempts are ignored."""
    fs, place = _files(spark, f"{root}/{table}")
    if not fs.exists(place):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, {PLACE}").parquet(f"{root}/{table}")
    # one entry per epoch: the scan is pruned to the folders it names
    return rows.join(commit_log(spark, root).select(*KEYS), KEYS, "left_semi").drop(*KEYS)
