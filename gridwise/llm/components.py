"""Connected components of a link table, wholly on Spark.

Alternates the large-star and small-star steps until the links no longer
change. Each step is a minimum by node and an equi-join; nothing is gathered
per node, so one node may have any number of links. Each round is written to
the shared checkpoint folder, which cuts lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwise.llm._common import checkpointed


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").hint("merge").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.hint("merge").join(least, "a")
    kept = moved.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return kept.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): for every node with a link, the smallest node that it reaches.

    Self-links and repeated links change nothing; links with a null end are left out; no links, no rows.
    """
    links = links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null and a <> b")
    now = checkpointed(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    sign = None
    while True:
        now = checkpointed(_small_star(_large_star(now)))
        new = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if new == sign:
            break
        sign = new
    found = now.groupBy("a").agg(F.min("b").alias("root"))
    roots = found.select(F.col("root").alias("a")).distinct().withColumn("root", F.col("a"))
    return found.union(roots).select(F.col("a").alias("node"), "root")
