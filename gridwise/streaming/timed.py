"""Operators with state that wait for event time: rows may come late and in any order, and state ends.

Rows of a key wait in steps of event time. When the watermark has passed the end of a
step, a timer fires and its rows are taken in their order of time, so the answer is the
same however the rows were dealt out over batches. What is kept of a key beyond its
waiting rows leaves by a later timer.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark):
    """Queries that are started within use the state store that timers need."""
    held = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, held)


class InSteps(StatefulProcessor):
    """Gives a key's rows to ``take`` in order, those of a step once the watermark has passed its end; what ``take`` keeps is forgotten ``keep_ms`` after a key's last row.

    Each call of the store is a message between two processes, so a key costs a few of them a batch, whatever the number of its rows
    and steps: waiting rows are one list that is appended to, and one timer stands for the first step that ends.
    """

    def __init__(self, columns: list[str], types: list[str], order: list[str], step_ms: int, keep_ms: int, kept: str):
        self.columns, self.types, self.order, self.step_ms, self.keep_ms, self.kept_type = columns, types, order, step_ms, keep_ms, kept

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", ", ".join(f"{c} array<{t}>" for c, t in zip(self.columns, self.types, strict=True)))
        self.kept = handle.getValueState("kept", f"last long, kept {self.kept_type}")
        self.timer = handle.getValueState("timer", "ms long")

    def _end(self, ms: int) -> int:
        return (ms // self.step_ms + 1) * self.step_ms

    def _wake(self, at: int) -> None:
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [tuple(r[c] for c in self.columns) for r in rows]
        self.waiting.appendValue(tuple(list(c) for c in zip(*new, strict=True)))
        first, timer = self._end(min(r[self.columns.index("ms")] for r in new)), self.timer.get()
        if timer is None or first < timer[0]:
            self._wake(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """All steps that the watermark has passed at once."""
        now, held = timerValues.getCurrentWatermarkInMs(), self.kept.get()
        last, kept = held if held is not None else (None, None)
        rows = [r for batch in self.waiting.get() for r in zip(*batch, strict=True)]
        ms, by = self.columns.index("ms"), [self.columns.index(c) for c in self.order]
        due = sorted((r for r in rows if self._end(r[ms]) <= now), key=lambda r: [(r[c] is None, r[c]) for c in by])
        out = []
        for r in due:
            if last is not None and r[ms] > last + self.keep_ms:
                kept = None  # by the rows' own times, whenever the timers fire
            kept = self.take(key, kept, r, out)
            last = r[ms]
        if due:
            self.kept.update((last, kept))
            rest = [r for r in rows if self._end(r[ms]) > now]
            if rest:
                self.waiting.put([tuple(list(c) for c in zip(*rest, strict=True))])
            else:
                self.waiting.clear()
            rows = rest
        elif last is not None and now >= last + self.keep_ms and all(r[ms] > last + self.keep_ms for r in rows):
            self.kept.clear()
            last = None
        ends = [self._end(r[ms]) for r in rows] + ([last + self.keep_ms] if last is not None and (not rows or last + self.keep_ms > now) else [])
        if ends:
            self._wake(min(ends))
        else:
            self.timer.clear()
        make = Row(*self.out)
        yield from (make(*row) for row in out)

    def take(self, key, kept, row: tuple, out: list[tuple]):
        """Adds to out what a row gives, and returns what is kept from now on."""
        raise NotImplementedError

    def close(self) -> None:
        pass


class LastWords(InSteps):
    """The last n words of an item before each of its cutoffs; a word at a cutoff's time counts."""

    def __init__(self, n: int, step_ms: int, keep_ms: int, names: tuple[str, str]):
        super().__init__(["ms", "us", "cutoff", "word"], ["long", "long", "boolean", "string"], ["us", "cutoff", "word"], step_ms, keep_ms, "array<string>")
        self.n, self.out = n, [*names, "text"]

    def take(self, key, kept, row, out):
        _, us, cutoff, word = row
        if cutoff:
            out.append((key[0], us, " ".join(kept or [])))
            return kept
        return [*(kept or []), word][-self.n :]


class FirstSeen(InSteps):
    """A key's first row, and the first one that comes more than the horizon after the last row that was given out."""

    def __init__(self, keys: list[str], step_ms: int, horizon_ms: int):
        super().__init__(["ms"], ["long"], ["ms"], step_ms, horizon_ms + 1, "long")
        self.out, self.horizon_ms = [*keys, "ms"], horizon_ms

    def take(self, key, kept, row, out):
        if kept is not None and row[0] <= kept + self.horizon_ms:
            return kept
        out.append((*key, row[0]))
        return row[0]


def last_words(stream: DataFrame, n: int, ts: str = "ts", item: str = "item", word: str = "word", cutoff: str = "is_cutoff", late: str = "1 hour", step_ms: int = 60_000, keep_ms: int = 86_400_000) -> DataFrame:
    """(item, ts, text): the last n words of the item at each cutoff row, given out when the watermark has passed the cutoff's step.

    Rows later than ``late`` are dropped. Words are forgotten ``keep_ms`` after the item's last row.
    """
    kind = stream.schema[item].dataType
    at = F.col(ts).cast("timestamp")
    rows = stream.filter(at.isNotNull()).select(F.col(item), at.alias(ts), F.unix_millis(at).alias("ms"), F.unix_micros(at).alias("us"), F.col(cutoff).alias("cutoff"), F.col(word).alias("word")).withWatermark(ts, late)
    schema = T.StructType([T.StructField(item, kind), T.StructField("us", T.LongType()), T.StructField("text", T.StringType())])
    out = rows.groupBy(item).transformWithState(LastWords(n, step_ms, keep_ms, (item, "us")), schema, "Append", "EventTime")
    return out.select(item, F.timestamp_micros("us").alias(ts), "text")


def first_seen(stream: DataFrame, keys: list[str], ts: str = "ts", late: str = "1 hour", step_ms: int = 60_000, horizon_ms: int = 86_400_000) -> DataFrame:
    """(keys..., ts) of rows whose keys were not given out within the horizon before; null keys are keys like others.

    A key's state leaves when the watermark is past its last row and the horizon.
    """
    at = F.col(ts).cast("timestamp")
    rows = stream.filter(at.isNotNull()).select(*keys, at.alias(ts), F.unix_millis(at).alias("ms")).withWatermark(ts, late)
    schema = T.StructType([*[stream.schema[k] for k in keys], T.StructField("ms", T.LongType())])
    out = rows.groupBy(*keys).transformWithState(FirstSeen(keys, step_ms, horizon_ms), schema, "Append", "EventTime")
    return out.select(*keys, F.timestamp_millis("ms").alias(ts))
