"""Digest of a table: a tree of SHA-256 over its rows' digests in their order.

A row is written so that it can be read back: columns by name, each value behind its
length, NULL by a mark of its own. Equal rows are one digest with a count. The sorted
digests are leaves of a tree: those that share their first hexadecimal digits are one
node, and so on up to the root, which also covers the columns' names. Nothing depends on
the order or the partitions of the rows, and no node has more than some thousand entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hexadecimal digits by which a level of the tree parts its node, and the entries of a leaf that are looked for.
DIGITS, LEAF = 3, 1024


def written(value: Column) -> Column:
    """A value as its length and its text; NULL as a minus sign."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(df: DataFrame) -> Column:
    return F.sha2(F.concat_ws(",", *[written(F.col(f"`{c}`")) for c in sorted(df.columns)]).cast("binary"), 256)


def tree_levels(rows: int) -> int:
    """Levels between the leaves and the root for so many different rows."""
    levels = 0
    while rows > LEAF << 4 * DIGITS * levels:
        levels += 1
    return levels


def table_digest(df: DataFrame, levels: int | None = None) -> DataFrame:
    """One row (n, hash): rows and digest of a table of any size. levels None: as many as the number of rows asks for."""
    header = "".join(f"{len(c.encode())}:{c}" for c in sorted(df.columns))
    rows = df.select(row_digest(df).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    if levels is None:
        levels = tree_levels(df.count())
    nodes = rows.select("h", F.concat_ws("x", "h", F.col("n").cast("string")).alias("e"), "n")
    for level in range(levels, -1, -1):
        key = F.substring("h", 1, DIGITS * level)
        entries = F.array_join(F.array_sort(F.collect_list("e")), ",")  # a leaf's rows, or the children of a node
        nodes = nodes.groupBy(key.alias("h")).agg(F.sha2(F.concat(F.lit(f"{header}," if level == 0 else ""), entries).cast("binary"), 256).alias("e"), F.sum("n").alias("n"))
        nodes = nodes.select("h", F.concat_ws("x", "h", "e").alias("e") if level else F.col("e"), "n")
    found = nodes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.max("e").alias("hash"))  # one root, or none of an empty table
    return found.withColumn("hash", F.coalesce("hash", F.sha2(F.lit(f"{header},").cast("binary"), 256)))
