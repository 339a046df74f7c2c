"""Merkle fixity audit of WARC archives.

Pages become WARC response records; ``FANOUT`` to the power of ``LEVELS`` page
numbers share an archive, in which a record's offset is the sum of the lengths
before it. A record's SHA-256 is a leaf; every node above covers the ordered
offset range of ``FANOUT`` children and hashes their hashes. Two replicas are
compared at their roots, and only the children of mismatching nodes are looked
at on the way down, so an intact archive costs one comparison.

Defined results: null urls and html are empty; records without a page number
are an archive of their own, dealt over its leaves by their content; records of
one leaf are hashed together (sums of the parts of their hashes, summed length,
smallest number), in no order; negative numbers have archives below zero; an
empty replica makes all leaves of the other missing or extra; extra columns are
ignored; records of any length are hashed whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridwise.llm._common import checkpointed

FANOUT, LEVELS = 16, 3
#: The archive of records without a page number; no page number leads to it.
NO_ID = -(1 << 63)


def records(pages: DataFrame) -> DataFrame:
    """(page_id, record binary): each page as a WARC/1.0 response record."""
    body = F.coalesce("html", F.lit(""))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce("url", F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return pages.select("page_id", F.concat(head, body, F.lit("\r\n\r\n")).cast("binary").alias("record"))


def leaves(archive: DataFrame) -> DataFrame:
    """(shard, slot, page_id, hash, offset, length) of (page_id, record)."""
    size = FANOUT**LEVELS
    hashed = archive.select("page_id", F.sha2("record", 256).alias("hash"), F.octet_length("record").cast("long").alias("length"))
    nameless = F.col("page_id").isNull()
    hashed = hashed.withColumns({
        "shard": F.when(nameless, F.lit(NO_ID)).otherwise(F.shiftright("page_id", size.bit_length() - 1)),  # floor of a division by a power of two
        "slot": F.pmod(F.when(nameless, F.conv(F.substring("hash", 1, 8), 16, 10).cast("long")).otherwise(F.col("page_id")), F.lit(size)),
    })
    # a leaf of several records: sums of the parts of their hashes, which need no order and no list
    parts = [F.sum(F.conv(F.substring("hash", 1 + 13 * i, 13), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(5)]
    slots = hashed.groupBy("shard", "slot").agg(
        F.min("page_id").alias("page_id"), F.sum("length").alias("length"), F.sha2(F.concat_ws(",", F.count(F.lit(1)).cast("string"), *parts).cast("binary"), 256).alias("hash")
    )
    before = F.sum("length").over(W.partitionBy("shard").orderBy("slot")) - F.col("length")
    return slots.withColumn("offset", before)


def nodes(leaf: DataFrame, level: int) -> DataFrame:
    """(shard, node, hash, start, stop) at a level of the tree; level 0 are the leaves, LEVELS the root.

    A node's hash covers its children's places, the bytes of their ranges and their hashes, in the order of the ranges.
    """
    out = leaf.select("shard", F.col("slot").cast("long").alias("node"), "hash", F.col("offset").alias("start"), (F.col("offset") + F.col("length")).alias("stop"))
    for _ in range(level):
        child = F.struct("node", (F.col("stop") - F.col("start")).alias("bytes"), "hash")
        children = F.transform(F.sort_array(F.collect_list(child)), lambda x: F.concat_ws(":", x["node"].cast("string"), x["bytes"].cast("string"), x["hash"]))  # FANOUT at most
        out = out.groupBy("shard", F.floor(F.col("node") / FANOUT).alias("up")).agg(
            F.sha2(F.array_join(children, ",").cast("binary"), 256).alias("hash"), F.min("start").alias("start"), F.max("stop").alias("stop")
        ).withColumnRenamed("up", "node")
    return out


def _differ(a: DataFrame, b: DataFrame) -> DataFrame:
    """(shard, node) whose hashes are not the same on both sides."""
    x = a.select("shard", "node", F.col("hash").alias("x"))
    y = b.select("shard", "node", F.col("hash").alias("y"))
    return x.hint("merge").join(y, ["shard", "node"], "full").filter("not (x <=> y)").select("shard", "node")


def audit(reference: DataFrame, replica: DataFrame) -> DataFrame:
    """(page_id, kind, shard, offset, length): damaged records; kind is changed, missing or extra.

    Both sides are leaves() of an archive. offset and length are the reference's (the replica's for extra records).
    """
    a, b = checkpointed(reference), checkpointed(replica)
    suspect = _differ(nodes(a, LEVELS), nodes(b, LEVELS))
    for level in range(LEVELS - 1, -1, -1):
        suspect = checkpointed(suspect)  # a node above keeps its children only
        up = suspect.select("shard", F.col("node").alias("up"))
        mine, theirs = (
            side.withColumn("up", F.floor(F.col("slot") / FANOUT ** (level + 1))).hint("merge").join(up, ["shard", "up"], "left_semi") for side in (a, b)
        )
        suspect = _differ(nodes(mine, level), nodes(theirs, level))
    x = a.select("shard", F.col("slot").cast("long").alias("node"), F.col("page_id").alias("p1"), F.col("offset").alias("o1"), F.col("length").alias("l1"))
    y = b.select("shard", F.col("slot").cast("long").alias("node"), F.col("page_id").alias("p2"), F.col("offset").alias("o2"), F.col("length").alias("l2"))
    both = suspect.hint("merge").join(x, ["shard", "node"], "left").hint("merge").join(y, ["shard", "node"], "left")
    kind = F.when(F.col("o2").isNull(), "missing").when(F.col("o1").isNull(), "extra").otherwise("changed")
    return both.select(F.coalesce("p1", "p2").alias("page_id"), kind.alias("kind"), "shard", F.coalesce("o1", "o2").alias("offset"), F.coalesce("l1", "l2").alias("length"))
