"""Small helpers that the text operators share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that separates words: space, tab, LF, VT, FF, CR.
SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: spark.checkpoint.dir; on one machine (tests), a temporary one where that is unset."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return configured or held.get()
    if not configured:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="gridwise-")
    spark.sparkContext.setCheckpointDir(configured)
    return configured


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder, so that its lineage ends there."""
    ensure_checkpoint_dir(df.sparkSession)
    with small_batches(df.sparkSession):
        return df.checkpoint(eager=True)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Arrow batches of few rows while a table of texts is written: a batch of 10,000 long texts takes much memory at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(held)) if int(held) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, held)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words(text) -> "F.Column":
    """Array of the maximal runs of characters other than ASCII white space; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def let(value, body):
    """body(value) with value computed once for each row."""
    return F.transform(F.array(value), body)[0]


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet under the shared checkpoint folder and read back: smaller than a checkpoint of rows."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows and bytes (of the values as text) of a join side that may be broadcast; beyond them the join sorts and merges.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 24_000_000


def sized(side: DataFrame) -> DataFrame:
    """side, which must be cheap to read (written out or tiny), hinted by its measured size."""
    width = F.sum(F.octet_length(F.struct("*").cast("string")).cast("long"))
    rows, size = side.limit(BROADCAST_ROWS + 1).agg(F.count(F.lit(1)), width).first()
    return side.hint("broadcast" if rows <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES else "merge")
