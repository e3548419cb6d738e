"""What the corpus operators share: tables, shared scratch tables, bounded blocks of texts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketmill.session import configure

# Texts that one step of a task holds at once, in characters.
BLOCK_CHARS = 2_000_000
# Arrow batches between the JVM and the Python workers.
BATCH_BYTES = "16m"


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings of the library, batches bounded in bytes, and a checkpoint folder."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    context = spark.sparkContext
    if context.getConf().get("spark.checkpoint.dir") is None and context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="ticketmill-llm-"))
    return spark


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder."""
    context = prepare(spark).sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    return f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: lineage ends there."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores added until ``df`` has no column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        found.append(name)
    return found


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text; a null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def rows_of(batches: Iterable[pa.RecordBatch], *names: str) -> Iterator[list[tuple]]:
    """Blocks of rows of the named columns; the last named is the text that bounds a block."""
    block: list[tuple] = []
    size = 0
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]
        for row in zip(*columns):
            block.append(row)
            size += len(row[-1] or "") + 64
            if size >= BLOCK_CHARS:
                yield block
                block, size = [], 0
    if block:
        yield block
