"""Running sums, ranks, medians and neighbouring rows within keys, where no task holds a large key.

Where the largest key has more than TASK_ROWS rows, rows are dealt by ranges of key
and order, so a key of any size is spread over many tasks; what a range adds to the
next ones is one row for each range and key. Below that, plain windows give the same.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridwise.functions.session import checkpointed


#: Rows of one key that a task may hold in order (its window spills beyond memory).
TASK_ROWS = 1_000_000


def settled(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, bool]:
    """df written out, so that its lineage is read once, and whether every key of it has at most TASK_ROWS rows."""
    rows = checkpointed(df)
    return rows, fits(rows, keys)


def load(df: DataFrame, keys: Sequence[str], n: Column | None = None) -> tuple[int, int]:
    """(rows of the largest key, all rows), by counting the rows, which should be written out or cheap to make; n: rows that a row stands for."""
    c = df.groupBy(*keys).agg((F.count(F.lit(1)) if n is None else F.sum(n)).alias("__c")).agg(F.max("__c"), F.sum("__c")).first()
    return c[0] or 0, c[1] or 0


def fits(df: DataFrame, keys: Sequence[str]) -> bool:
    """Whether every key has at most TASK_ROWS rows, by counting the rows, which should be written out."""
    return load(df, keys)[0] <= TASK_ROWS


#: Rows of a task that takes many windows one after another.
CHAIN_ROWS = 250_000


def dealt(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """df by keys, so that windows over these and further columns need no other shuffle; rows: how many there are."""
    n = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // CHAIN_ROWS))
    return df.repartition(n, *keys)


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: dict[str, Column], totals: dict[str, str] | None = None, small: bool | None = None) -> DataFrame:
    """df with the sums of columns over a key's rows so far, the row itself included; nulls add nothing, and null keys are a key.

    totals (name of a sum -> name of a column) adds the sum over the whole key. small: what fits(df, keys) gives, where that is known.
    """
    new = [*sums, *(totals or {}).values()]
    if small is None:
        df, small = settled(df, keys)
    if small:
        whole, by = W.partitionBy(*keys), W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        values = {n: F.coalesce(F.sum(c).over(by), F.lit(0)) for n, c in sums.items()}
        return df.withColumns({**values, **{out: F.coalesce(F.sum(sums[n]).over(whole), F.lit(0)) for n, out in (totals or {}).items()}})
    parts = {n: (f"__s{i}", f"__t{i}", f"__o{i}") for i, n in enumerate(sums)}
    rows = df.withColumns({"__k": F.struct(*keys), **{parts[n][0]: c for n, c in sums.items()}})
    rows = checkpointed(rows.repartitionByRange("__k", *order)).withColumn("__p", F.spark_partition_id())  # its partitions stay as they are
    each = rows.groupBy("__p", "__k").agg(*[F.coalesce(F.sum(s), F.lit(0)).alias(t) for s, t, _ in parts.values()])
    before = W.partitionBy("__k").orderBy("__p").rowsBetween(W.unboundedPreceding, -1)  # at most one row a range
    carried = each.select("__p", "__k", *[F.coalesce(F.sum(t).over(before), F.lit(0)).alias(o) for _, t, o in parts.values()], *[F.sum(parts[n][1]).over(W.partitionBy("__k")).alias(out) for n, out in (totals or {}).items()])
    so_far = W.partitionBy("__p", "__k").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = rows.withColumns({n: F.coalesce(F.sum(s).over(so_far), F.lit(0)) for n, (s, _, _) in parts.items()})
    both = local.hint("merge").join(carried, ["__p", "__k"])
    return both.withColumns({n: F.col(n) + F.col(o) for n, (_, _, o) in parts.items()}).select(*[c for c in df.columns if c not in new], *new)


def blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str], back: int = 0, ahead: int = 0, size: int = 1 << 16, small: bool | None = None) -> DataFrame:
    """df with __n (number of the row in its key, from 0), __block and __own: every block has ``size`` rows of its key.

    Rows at the edges are also given to the next or the last block, so that a window over (keys, __block) by __n sees ``back`` rows
    before and ``ahead`` rows after each row of its own; keep the rows with __own afterwards. small: as for running.
    """
    if small is None:
        df, small = settled(df, keys)
    if small:
        number = F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("long") - 1
        return df.withColumns({"__n": number, "__block": F.lit(0).cast("long"), "__own": F.lit(True)})
    size = max(size, back, ahead)
    rows = running(df, keys, order, {"__n": F.lit(1).cast("long")}, small=False).withColumn("__n", F.col("__n") - 1)
    at = F.col("__n") % size
    to = F.array_compact(F.array(F.lit(0), F.when(at >= size - back, F.lit(1)), F.when(at < ahead, F.lit(-1))))
    moved = rows.withColumn("__to", F.explode(to))
    return moved.withColumns({"__block": F.floor(F.col("__n") / size) + F.col("__to"), "__own": F.col("__to") == 0}).drop("__to")


def counted_values(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys..., value, __c, __upto, __all): rows of each distinct value, rows up to it in order, rows of the key."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"))
    return running(counts, keys, [value], {"__upto": F.col("__c")}, {"__upto": "__all"})


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, out: str, small: bool | None = None) -> DataFrame:
    """df with 0-based ranks, ties averaged; nulls come first and are ties. small: as for running."""
    if small is None:
        df, small = settled(df, keys)
    if small:
        by = W.partitionBy(*keys)
        return df.withColumn(out, F.rank().over(by.orderBy(value)) - 1 + (F.count(F.lit(1)).over(W.partitionBy(*keys, value)) - 1) / 2.0)
    at = F.struct(*keys, value)
    ranks = counted_values(df, keys, value).select(at.alias("__at"), (F.col("__upto") - F.col("__c") + (F.col("__c") - 1) / 2.0).alias(out))
    return df.withColumn("__at", at).hint("merge").join(ranks, "__at").drop("__at")


def medians(df: DataFrame, keys: Sequence[str], value: str, out: str, small: bool | None = None) -> DataFrame:
    """(keys..., out): median of each key's values that are not null, the mean of the two middle ones of an even number; NULL where all are null."""
    if small is None:
        df, small = settled(df, keys)
    if small:
        return df.groupBy(*keys).agg(F.median(value).alias(out))
    known = counted_values(df.filter(F.col(value).isNotNull()), keys, value)
    low, high = F.floor((F.col("__all") + 1) / 2), F.floor(F.col("__all") / 2) + 1  # places of the middle values, from 1
    holds = lambda place: (F.col("__upto") - F.col("__c") < place) & (place <= F.col("__upto"))
    middle = known.filter(holds(low) | holds(high))  # two rows of a key at most
    every = df.select(*keys, F.lit(None).cast("double").alias("__v")).distinct()
    return every.unionByName(middle.select(*keys, F.col(value).cast("double").alias("__v"))).groupBy(*keys).agg(F.avg("__v").alias(out))
