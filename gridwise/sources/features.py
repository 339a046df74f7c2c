"""A versioned Parquet store of layered features with an index of its items.

Rows are (item, layer, frame, t_s, vec), in the order of item, layer and frame,
so filters on them reach the scan. A commit adds files of its own rows and a new
index: one row an item with the commit that holds it and its shape. Replacing or
deleting an item leaves older files as they are; rows whose commit is not the
one that the index names are no longer read. Index and data become visible by
one rename (snapshots.py); keys and shapes are read from the index alone.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwise.functions.session import checkpointed, sized
from gridwise.sources.snapshots import VersionLog, VersionTaken

TRIES = 20  # other writers that may publish between this one's reading and its own publishing


class FeatureStore:
    def __init__(self, spark: SparkSession, path: str, version: int | None = None):
        """version: the one to read (None: the newest at each call)."""
        self.spark, self.path, self.version = spark, path, version
        self.log = VersionLog(spark, path)

    def _newest(self) -> int:
        """The version that is read, -1 where there is none."""
        return self.version if self.version is not None else max(self.log.versions(), default=-1)

    def exists(self) -> bool:
        return self._newest() >= 0

    def _index_at(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self.log.read(version)['index']}")

    def index(self) -> DataFrame:
        """(item, commit, of, n_layers, n_time, n_channels, n_rows, n_values, files): the items of the version; of is the number of items that the commit wrote."""
        version = self._newest()
        if version < 0:
            raise FileNotFoundError(self.path)
        return self._index_at(version)

    def list_keys(self) -> DataFrame:
        return self.index().select("item")

    def shape(self) -> DataFrame:
        return self.index().select("item", "n_layers", "n_time", "n_channels")

    def read(self, items: DataFrame | None = None) -> DataFrame:
        """The rows of the version, or of some of its items. Commits whose items have all been replaced are not opened."""
        index = self.index()
        if items is not None:
            index = index.join(items.select("item").distinct(), "item", "left_semi")
        index = index.select("item", "commit", "of")
        if items is not None:
            index = checkpointed(index)
        held = index.groupBy("commit").agg(F.count(F.lit(1)).alias("n"), F.max("of").alias("of")).collect()  # one row a commit
        rows = lambda commits: self.spark.read.option("basePath", f"{self.path}/data").parquet(*[f"{self.path}/data/commit={c}" for c in commits])
        whole, partly = [r.commit for r in held if r.n == r.of], [r.commit for r in held if r.n < r.of]
        parts = [rows(whole)] if whole else []
        if partly:
            parts.append(rows(partly).join(sized(index.select("item", "commit")), ["item", "commit"], "left_semi"))
        if not parts:  # a version without items
            return rows([self.log.read(self._newest())["commit"]]).filter(F.lit(False)).drop("commit")
        return (parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])).drop("commit")

    def time_axis(self) -> DataFrame:
        return self.read().select("item", "frame", "t_s").distinct()

    def read_slice(self, layers: tuple[int, int] | None = None, frames: tuple[int, int] | None = None, channels: tuple[int, int] | None = None, items: DataFrame | None = None) -> DataFrame:
        """Half-open ranges of layers, frames and channels of the items."""
        df = self.read(items)
        for name, r in (("layer", layers), ("frame", frames)):
            if r is not None:
                df = df.filter((F.col(name) >= r[0]) & (F.col(name) < r[1]))
        return df if channels is None else df.withColumn("vec", F.slice("vec", channels[0] + 1, channels[1] - channels[0]))

    def write(self, df: DataFrame, overwrite: bool = False) -> DataFrame:
        """Adds the items that the store has not; with overwrite, replaces those it has. Returns (status, n) of items: ok, skip."""
        base, new = self._newest(), df
        if base >= 0 and not overwrite:
            new = df.join(self._index_at(base).select("item"), "item", "left_anti")
        commit = uuid.uuid4().hex
        self._save(new, commit)
        own = self._indexed(commit)

        def merged(version: int) -> DataFrame:
            if version < 0:
                return own
            old = self._index_at(version)
            if overwrite:
                return old.join(own.select("item"), "item", "left_anti").unionByName(own)
            return old.unionByName(own.join(old.select("item"), "item", "left_anti"))  # what another writer added meanwhile stays

        done = self._index_at(self._commit(commit, merged)).filter(F.col("commit") == commit).select("item", F.lit("ok").alias("status"))
        items = df.select("item").distinct().join(done, "item", "left")
        return checkpointed(items.groupBy(F.coalesce("status", F.lit("skip")).alias("status")).agg(F.count(F.lit(1)).alias("n")))

    def delete(self, items: DataFrame) -> None:
        """The items are no longer in the next version; no data file is touched."""
        gone = items.select("item").distinct()
        self._commit(self.log.read(self._newest())["commit"], lambda version: self._index_at(version).join(gone, "item", "left_anti"))

    def _save(self, df: DataFrame, commit: str) -> None:
        rows = df.select("item", "layer", "frame", "t_s", F.col("vec").cast("array<float>").alias("vec"))
        order = ("item", "layer", "frame")
        rows.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(f"{self.path}/data/commit={commit}")

    def _indexed(self, commit: str) -> DataFrame:
        """The index rows of a commit's files, read once when they are new."""
        rows = self.spark.read.parquet(f"{self.path}/data/commit={commit}").select("item", "layer", "frame", F.size("vec").alias("size"), F.col("_metadata.file_name").alias("file"))
        index = rows.groupBy("item").agg(
            F.count_distinct("layer").alias("n_layers"), (F.max("frame") + 1).alias("n_time"), F.max("size").alias("n_channels"), F.count(F.lit(1)).alias("n_rows"),
            F.sum("size").cast("long").alias("n_values"), F.array_sort(F.collect_set("file")).alias("files"),
        )
        index = checkpointed(index)
        return index.select("item", F.lit(commit).alias("commit"), F.lit(index.count()).cast("long").alias("of"), "n_layers", "n_time", "n_channels", "n_rows", "n_values", "files")

    def _commit(self, commit: str, merged) -> int:
        """Publishes merged(newest version) as the next version, again on top of another writer's where that came first."""
        for _ in range(TRIES):
            base = max(self.log.versions(), default=-1)
            name = f"index/{base + 1:020d}-{uuid.uuid4().hex}"
            merged(base).write.parquet(f"{self.path}/{name}")
            try:
                self.log.publish(base + 1, {"index": name, "commit": commit})
                return base + 1
            except VersionTaken:
                continue
        raise VersionTaken(f"{TRIES} other writers came first at {self.path}")


def read_bold(bold: DataFrame, key: str) -> DataFrame:
    """(tr, vec) of one item; an item without rows is an error when read."""
    n = bold.filter(F.col("fmri_item_id") == key)
    if n.isEmpty():
        raise KeyError(key)
    return n.select("tr", "vec")


def cache_inventory(spark: SparkSession, stores: dict[str, str]) -> DataFrame:
    """(modality, path, present, n_keys, n_values, n_bytes) of a store for each expected modality; keys and values by the index, bytes by the files that it needs."""
    rows = []
    for modality, path in sorted(stores.items()):  # a handful of names
        store = FeatureStore(spark, path)
        if not store.exists():
            rows.append((modality, path, False, 0, 0, 0))
            continue
        index = store.index()
        held = index.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_values"), F.lit(0))).first()
        files = index.select("commit", F.explode("files").alias("file")).distinct()
        listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(f"{path}/data").select("path", "length")
        sizes = listed.select(F.regexp_extract("path", "commit=([0-9a-f]+)/", 1).alias("commit"), F.element_at(F.split("path", "/"), -1).alias("file"), "length")
        size = sizes.hint("merge").join(files, ["commit", "file"]).agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
        rows.append((modality, path, True, held[0], held[1], size))
    return spark.createDataFrame(rows, "modality string, path string, present boolean, n_keys long, n_values long, n_bytes long")
