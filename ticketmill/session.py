"""Session settings the operators rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import ticketmill

# Runtime settings. UTC makes wall-clock arithmetic and TIMESTAMP_NTZ casts
# unambiguous; AQE resizes shuffles, splits skewed join partitions and picks
# broadcast joins from measured sizes.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session and return it.

    The package's functions travel to the Python workers by value, so executors
    need no installed copy.
    """
    cloudpickle.register_pickle_by_value(ticketmill)
    for key, value in SESSION_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the local bench."""
    return configure(
        SparkSession.builder.master(f"local[{cores}]")
        .appName("ticketmill")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only on one machine, where the setting is absent (tests), is a temporary
    folder used; on a cluster other executors could not read it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return configured or tempfile.mkdtemp(prefix="ticketmill-")


def scratch_folder(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{checkpoint_root(spark)}/run-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to the new folder ``path`` and read from there, so that its work is done once."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
