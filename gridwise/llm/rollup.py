"""Token counts as delta-maintained rollups.

A batch of changes (inserts, deletes, revised counts) becomes signed deltas,
summed by source, language and tokenizer version before anything is stored.
Data folders are written whole under names of their own and count only once the
manifest names them. A manifest is a numbered folder that is written whole and
then never changed; the highest number whose write ended (``_SUCCESS``) holds.
It lists, for each batch ever committed, the data folder that it counts in, so

* a batch committed again replaces itself and counts once,
* ``compact`` folds batches into one folder with one change of the manifest: a
  reader sees the state before or after it, and a crash leaves the one before,
* a batch that was folded may be committed again: it is known, and ignored if
  its deltas are the ones folded, else an error.

Totals are sums over the folders of the manifest. One writer at a time.

Defined results: null counts are zero tokens, null keys are keys of their own;
repeated rows in one batch count as often as they are there; a change of another
kind than insert, delete or revise is an error; a rollup without batches has no
totals; groups whose documents are all gone leave the totals; extra columns are
ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("source", "lang", "tokenizer")
_SCHEMA = "source string, lang string, tokenizer string, d_docs long, d_tokens long"
_MANIFEST = "batch string, data string, folded boolean, sign string"


def deltas(changes: DataFrame) -> DataFrame:
    """Signed sums by KEYS of (source, lang, tokenizer, kind, old_tokens, new_tokens)."""
    old, new = (F.coalesce(F.col(c).cast("long"), F.lit(0)) for c in ("old_tokens", "new_tokens"))
    kind = F.col("kind")
    docs = F.when(kind == "insert", 1).when(kind == "delete", -1).when(kind == "revise", 0).otherwise(F.raise_error(F.concat(F.lit("unknown kind of change: "), F.coalesce(kind, F.lit("null")))).cast("int"))
    tokens = F.when(kind == "insert", new).when(kind == "delete", -old).otherwise(new - old)
    signed = changes.select(*KEYS, docs.cast("long").alias("d"), tokens.alias("t"))
    return signed.groupBy(*KEYS).agg(F.sum("d").alias("d_docs"), F.sum("t").alias("d_tokens"))


class Rollup:
    """A rollup kept in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def commit(self, batch: str, changes: DataFrame) -> None:
        """Counts the deltas of a batch; the same batch again replaces itself, or, once folded, is left as it is."""
        held = self._manifest()
        data, sign = self._write(deltas(changes))
        known = held.get(batch)
        if known and known[1]:
            if known[2] != sign:
                raise ValueError(f"batch {batch} was folded with other deltas; commit the difference as a new batch")
            return
        self._publish({**held, batch: (data, False, sign)})

    def compact(self, batches: list[str] | None = None) -> None:
        """Folds batches (all, if none are named) into one data folder, with the folders that they were folded into before."""
        held = self._manifest()
        found = {held[b][0] for b in (held if batches is None else batches) if b in held}
        if found:
            rows = self._data(found).groupBy(*KEYS).agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens"))
            data, _ = self._write(rows)
            self._publish({b: (data, True, sign) if d in found else (d, folded, sign) for b, (d, folded, sign) in held.items()})

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) over all batches."""
        found = {d for d, _, _ in self._manifest().values()}
        rows = self._data(found) if found else self.spark.createDataFrame([], _SCHEMA)
        out = rows.groupBy(*KEYS).agg(F.sum("d_docs").alias("n_docs"), F.sum("d_tokens").alias("n_tokens"))
        return out.filter("n_docs <> 0 or n_tokens <> 0")

    def _data(self, found: set[str]) -> DataFrame:
        return self.spark.read.schema(_SCHEMA).parquet(*[f"{self.path}/data/{d}" for d in sorted(found)])

    def _write(self, rows: DataFrame) -> tuple[str, str]:
        """(name of the folder, sign of its rows); rows are sums by KEYS."""
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/data/{name}")
        sign = self._data({name}).agg(F.count(F.lit(1)), F.sum(F.xxhash64(*KEYS, "d_docs", "d_tokens").cast("decimal(38,0)"))).first()
        return name, f"{sign[0]}:{sign[1]}"

    def _versions(self) -> list[int]:
        """Numbers of the manifests whose write ended."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest/*/_SUCCESS")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path)
        return sorted(int(s.getPath().getParent().getName()) for s in found or ())

    def _manifest(self) -> dict[str, tuple[str, bool, str]]:
        """Batch -> (data folder, folded or not, sign): one entry for each batch, which are few."""
        versions = self._versions()
        if not versions:
            return {}
        return {r.batch: (r.data, r.folded, r.sign) for r in self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest/{versions[-1]}").collect()}

    def _publish(self, entries: dict[str, tuple[str, bool, str]]) -> None:
        number = max(self._versions(), default=0) + 1
        rows = self.spark.createDataFrame([(b, *x) for b, x in entries.items()], _MANIFEST)
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/{number}")  # over what a writer that died left
