"""Versioned table folders and the control table.

A write goes to a new ``v=<n>`` folder, which readers see only when it is
complete (Spark's ``_SUCCESS`` marker), so a failed job leaves the last version
in force and a lost executor only re-runs its tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def versions(spark: SparkSession, path: str) -> list[int]:
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    out = []
    for entry in fs.listStatus(root):
        name = entry.getPath().getName()
        marker = jvm.org.apache.hadoop.fs.Path(entry.getPath(), "_SUCCESS")
        if name.startswith("v=") and fs.exists(marker):
            out.append(int(name[2:]))
    return sorted(out)


def latest_version(spark: SparkSession, path: str) -> int | None:
    found = versions(spark, path)
    return found[-1] if found else None


def write_version(df: DataFrame, path: str, fmt: str = "parquet") -> int:
    """Write ``df`` as the next version; earlier versions stay readable."""
    spark = df.sparkSession
    number = (latest_version(spark, path) or 0) + 1
    df.write.mode("overwrite").format(fmt).save(f"{path}/v={number}")
    return number


def read_latest(spark: SparkSession, path: str, schema, fmt: str = "parquet") -> DataFrame:
    """The latest complete version, or an empty table of ``schema``."""
    number = latest_version(spark, path)
    if number is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).format(fmt).load(f"{path}/v={number}")


CONTROL = "last_updated_at TIMESTAMP, last_run_at TIMESTAMP, last_indexed_count BIGINT"


def read_control(spark: SparkSession, path: str) -> DataFrame:
    """The one-row control table; no readable state means an empty row."""
    latest = read_latest(spark, path, CONTROL, "json")
    empty = spark.range(1).selectExpr(
        "CAST(NULL AS TIMESTAMP) last_updated_at", "CAST(NULL AS TIMESTAMP) last_run_at",
        "CAST(NULL AS BIGINT) last_indexed_count",
    )
    # aggregating makes it one row whatever the folder holds
    return (
        latest.unionByName(empty)
        .agg(*[F.max(c).alias(c) for c in ("last_updated_at", "last_run_at", "last_indexed_count")])
    )


def effective_watermark(control: DataFrame, updated_since: str | None, no_watermark: bool):
    """Scalar column: the explicit value, else (unless a backfill) the stored one."""
    explicit = F.lit(updated_since).cast("timestamp")
    if no_watermark or updated_since is not None:
        return explicit
    return control.select(F.max("last_updated_at")).scalar()


def incremental_scan(
    df: DataFrame, control: DataFrame, updated_since: str | None = None,
    no_watermark: bool = False, column: str = "updated_at",
) -> DataFrame:
    """Rows at or after the effective watermark; everything when there is none."""
    mark = effective_watermark(control, updated_since, no_watermark)
    if no_watermark and updated_since is None:
        return df
    return df.filter((F.col(column) >= mark) | mark.isNull())


def may_advance(limit: int | None, no_watermark: bool, updated_since: str | None) -> bool:
    """Only an uncapped run driven by the stored watermark may move it."""
    return limit is None and not no_watermark and updated_since is None


def advance_watermark(
    control: DataFrame, built: DataFrame, limit: int | None = None, no_watermark: bool = False,
    updated_since: str | None = None, column: str = "updated_at",
) -> DataFrame:
    """The next control row, from the records built (not those seen).

    Write it with :func:`write_version` after the data write has succeeded.
    """
    newest = F.max(column) if may_advance(limit, no_watermark, updated_since) else F.lit(None).cast("timestamp")
    stored = control.select(F.max("last_updated_at")).scalar()
    return built.agg(newest.alias("newest"), F.count("*").alias("last_indexed_count")).select(
        F.coalesce("newest", stored).alias("last_updated_at"),
        F.current_timestamp().alias("last_run_at"),
        "last_indexed_count",
    )
