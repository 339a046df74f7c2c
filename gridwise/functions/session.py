"""Checkpoints in the folder that the cluster shares, and joins by the measured size of a side."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes (of the values as text) of a join side that is broadcast; a larger one is sorted and merged.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 24_000_000


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared folder, which ends its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def sized(side: DataFrame) -> DataFrame:
    """side, which must be written out (it is read once more), hinted for a join by its rows and bytes."""
    width = F.sum(F.octet_length(F.struct("*").cast("string")).cast("long"))
    rows, size = side.limit(BROADCAST_ROWS + 1).agg(F.count(F.lit(1)), width).first()
    return side.hint("broadcast" if rows <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES else "merge")


def measured(side: DataFrame) -> DataFrame:
    """side written to the shared folder and hinted by its size: for aggregates that may be a few rows or as many as there are items."""
    return sized(checkpointed(side))


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; on one machine (tests), a temporary folder where that is unset. Checkpoints go there, too."""
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    root = spark.conf.get("spark.checkpoint.dir", None) or (held.get() if held.isDefined() else None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="gridwise-")
    if not held.isDefined():
        spark.sparkContext.setCheckpointDir(root)
    return root
