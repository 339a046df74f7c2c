"""Tables of additive sums that a stream keeps up to date, each batch counted once.

A batch adds one folder of partial sums by key; the table is the sum over the folders
that its newest version names (sources/snapshots.py). A version also names the last
batch of each source, so a batch that is played again changes nothing, and one whose
writer died before the version was published is written again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwise.sources.snapshots import VersionLog

#: Folders that are read side by side; more are added up into one by the batch that comes then.
MOST_PARTS = 32


class SumTable:
    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], sums: Sequence[str]):
        self.spark, self.path, self.keys, self.sums = spark, path, list(keys), list(sums)
        self.log = VersionLog(spark, path)

    def _newest(self) -> tuple[int, dict]:
        version = max(self.log.versions(), default=-1)
        return version, self.log.read(version) if version >= 0 else {"parts": [], "batches": {}}

    def _added(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.keys).agg(*[F.sum(c).alias(c) for c in self.sums])

    def _parts(self, names: list[str]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/{p}" for p in names]).select(*self.keys, *self.sums)

    def add(self, partial: DataFrame, batch: int, source: str = "") -> bool:
        """Adds a batch's sums by key; False if the source's batch, or a later one, is in the table already."""
        version, held = self._newest()
        if held["batches"].get(source, -1) >= batch:
            return False
        name = f"parts/{uuid.uuid4().hex}"
        partial.select(*self.keys, *self.sums).write.parquet(f"{self.path}/{name}")
        parts = [*held["parts"], name]
        if len(parts) > MOST_PARTS:
            name = f"parts/{uuid.uuid4().hex}"
            self._added(self._parts(parts)).write.parquet(f"{self.path}/{name}")
            parts = [name]
        self.log.publish(version + 1, {"parts": parts, "batches": held["batches"] | {source: batch}})
        return True

    def read(self) -> DataFrame:
        """(keys..., sums...) of all batches of the newest version."""
        version, held = self._newest()
        if version < 0:
            raise FileNotFoundError(self.path)
        return self._added(self._parts(held["parts"]))

    def follow(self, stream: DataFrame, partial: Callable[[DataFrame], DataFrame], checkpoint: str, source: str = "") -> None:
        """Runs the stream over all that its source has now; partial gives a batch's sums by key."""
        q = stream.writeStream.foreachBatch(lambda df, batch: self.add(partial(df), batch, source)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
