"""Line deduplication with a log-template tree.

Each line with a word is split into tokens; tokens with a digit are variable
fields. The tree has a fixed depth: token count, then the leading ``DEPTH``
tokens, whose hash is the leaf. Inside a leaf, variable fields are found by how
many of its different lines have a token at its place: a token is a field of its
line if at most half as many lines have it there as have the line's middle token
(by that count) at its own. A line's template is its leaf and its other tokens
with their places, if they are ``SIMILAR`` of its constant tokens beyond the
leading ones, else the line itself. So two lines of one template agree in every
constant place, a template does not drift, and no task holds a leaf: all is
counted by (leaf, place, token), whatever the leaf's size.

Copies are told apart first: documents of equal or near-equal texts
(``nearcopies``) count as one. A template that occurs in ``MIN_DOCS`` such
documents or more, or in ``MIN_PASSAGE`` if it has over ``PASSAGE`` tokens,
recurs, and its lines are dropped in every document, whatever share of it they
are.

Only hashes travel; texts are joined once, at the end. Sides that were
aggregated are written before they are joined, so that a hot leaf, line or text
is split over tasks.

Defined results: null text has no lines; blank lines are kept and never count;
repeated rows count as one document; null ids are allowed; an empty table
gives no rows; long lines and texts are whole; other columns pass through, and
columns named ``n_lines`` or ``n_dropped`` are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwise.llm import _vector as v
from gridwise.llm._common import let, sized, stored
from gridwise.llm.nearcopies import near_copies

DEPTH, SIMILAR = 3, 0.7
MIN_DOCS, MIN_PASSAGE, PASSAGE = 3, 2, 50
_OFTEN = f"n >= if(size > {PASSAGE}, {MIN_PASSAGE}, {MIN_DOCS})"


def _lines(docs: DataFrame) -> DataFrame:
    """One row for each line with a word: its text's key, number, leaf, hash, size and token codes (zero: a field)."""

    def run(batches):
        for batch in batches:
            for at, data, bounds in v.pieces(batch.column(1)):
                yield _line_batch(batch.slice(at, len(bounds) - 1), data, bounds)

    return docs.mapInArrow(run, "rk long, number int, leaf long, line long, size int, codes array<int>")


def _line_batch(rows: pa.RecordBatch, data: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
    h, at, digit, first = v.words(data, bounds)
    h = np.where(digit, np.uint64(0), h | np.uint64(1))
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    breaks = np.flatnonzero(data == 10)
    number = np.searchsorted(breaks, at) - np.searchsorted(breaks, bounds[:-1])[owner]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (number[1:] != number[:-1])
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(h)) if len(starts) else starts
    size = ends - starts
    leaf = v.mix(size.astype(np.uint64) * v.P1)
    for j in range(DEPTH):
        leaf = v.mix(leaf * v.P1 + np.where(j < size, h[np.minimum(starts + j, max(0, len(h) - 1))] if len(h) else h, np.uint64(0)))
    line = v.sequence_hashes(h, np.append(starts, len(h)))
    who = pa.array(owner[starts])
    # 31 bits and a one: zero is kept for fields
    codes = ((h >> np.uint64(32)) | (h != 0)).astype(np.uint32).view(np.int32)
    return pa.RecordBatch.from_arrays(
        [
            rows.column(0).take(who), pa.array(number[starts].astype(np.int32)), pa.array(leaf.view(np.int64)), pa.array(line.view(np.int64)),
            pa.array(size.astype(np.int32)), pa.ListArray.from_arrays(pa.array(np.append(starts, len(h)).astype(np.int32)), pa.array(codes)),
        ],
        ["rk", "number", "leaf", "line", "size", "codes"],
    )


def templates(kinds: DataFrame) -> DataFrame:
    """(leaf, line, template) of the different lines (leaf, line, codes) of some leaves; lines of fields only are left out."""
    tokens = kinds.select("leaf", "line", F.posexplode("codes").alias("place", "code")).filter(f"place >= {DEPTH} and code <> 0")
    counts = stored(tokens.groupBy("leaf", "place", "code").agg(F.count(F.lit(1)).alias("n")))
    counted = tokens.hint("merge").join(counts, ["leaf", "place", "code"])
    held = counted.groupBy("leaf", "line").agg(F.sort_array(F.collect_list(F.struct("place", "code", "n"))).alias("t"))  # of one line
    middle = let(F.sort_array(F.transform("t", lambda x: x["n"])), lambda n: F.get(n, F.floor(F.size(n) / 2).cast("int")))
    fixed = let(middle, lambda m: F.filter("t", lambda x: 2 * x["n"] > m))
    held = held.withColumn("fixed", F.transform(fixed, lambda x: F.struct(x["place"], x["code"])))
    enough = F.size("fixed") >= SIMILAR * F.size("t")
    return held.select("leaf", "line", F.when(enough, F.xxhash64("leaf", "fixed")).otherwise(F.col("line")).alias("template"))


def dropped(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(rk, lines array<int>): the numbers of the lines of recurring templates, by the hash of the text (equal texts lose equal lines)."""
    keyed = docs.select(F.xxhash64(F.col(text_col)).alias("rk"), F.col(text_col).alias("text"))
    lines = stored(_lines(keyed))
    counts = stored(lines.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size")).filter(_OFTEN).select("leaf"))
    some = lines.drop("codes").join(sized(counts), "leaf", "left_semi")
    copies = stored(near_copies(keyed, "rk").distinct())
    some = stored(some.hint("merge").join(copies, "rk"))
    by_class = some.groupBy("leaf", "component").agg(F.min("line").alias("low"), F.max("line").alias("high"), F.max("size").alias("size"))
    leaves = by_class.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("size").alias("size"))
    leaves = stored(leaves.filter(_OFTEN).select("leaf", (F.col("low") < F.col("high")).alias("many")))
    kinds = lines.select("leaf", "line", "codes").join(sized(leaves.filter("many").select("leaf")), "leaf", "left_semi")
    made = stored(templates(stored(kinds.groupBy("leaf", "line").agg(F.first("codes").alias("codes")))))
    named = some.join(sized(leaves.select("leaf")), "leaf", "left_semi").hint("merge").join(made, ["leaf", "line"], "left")
    named = stored(named.select("rk", "number", "size", "component", F.coalesce("template", "line").alias("template")))
    seen = named.groupBy("template", "component").agg(F.max("size").alias("size"))
    often = stored(seen.groupBy("template").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size")).filter(_OFTEN).select("template"))
    gone = named.select("rk", "number", "template").join(sized(often), "template", "left_semi")
    return gone.groupBy("rk").agg(F.collect_set("number").alias("lines"))


def drop_recurring(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without their recurring lines, and two columns more: n_lines (lines with a word) and n_dropped."""
    docs = docs.drop("n_lines", "n_dropped")
    gone = stored(dropped(docs, text_col).select(F.col("rk").alias("__rk"), F.col("lines").alias("__lines")))
    joined = docs.withColumn("__rk", F.xxhash64(F.col(text_col))).hint("merge").join(gone, "__rk", "left")
    all_lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    has_word = lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != ""
    rest = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__lines"))
    kept = let(all_lines, lambda lines: F.array_join(F.transform(rest(lines), lambda i: lines[i]), "\n"))
    decided = joined.withColumn("__drops", F.col("__lines").isNotNull())
    return decided.select(
        *[F.when(F.col("__drops"), kept).otherwise(F.col(text_col)).alias(text_col) if c == text_col else F.col(f"`{c}`") for c in docs.columns],
        F.size(F.filter(all_lines, has_word)).cast("long").alias("n_lines"),
        F.when(F.col("__drops"), F.size("__lines")).otherwise(0).cast("long").alias("n_dropped"),
    )
