"""Filter interaction audit: what every order of the filters removes, from one count of failure masks.

A document fails a set of filters, which is a mask. Masks are counted by part
(a source), quality and toxicity; no order is run over documents. For each part
the subsets of the filters are walked in Gray-code order: one filter is switched
on or off at a time, each mask cell keeps the number of active filters that it
fails, and a cell enters or leaves the running survivors when its number leaves
or reaches zero. The states of all subsets are stored; a step of an order is the
difference of two of them.

The filters: A few words, B few different words, C many capitals, D markup
signs, E a text that a smaller doc_id has, too (whether removed or not).

Defined results: null text is the empty text, a null part is the empty string; a
document without an id has no smaller one and is no copy of one with an id; rows
that repeat an id and a text are counted each, none is a copy of the other; an
id with several labels is good (toxic) if one of them says so, ids without labels
and null labels are neither; an empty table has no parts and gives no rows; very
long texts are read once in the row; only the named columns are read, so extra
columns may have any name.

Rows that repeat an id, a text and a part are counted before anything is joined,
and no join has the text's hash alone as its key: a text that a third of all
documents share is spread by their ids.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwise.llm._common import let, stored, words

FILTERS = "ABCDE"
#: Least words, least per cent of different words, most per cent of capitals, and the signs.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, SIGNS = 200, 50, 2, "#$%&*|"


def text_mask(text: Column) -> Column:
    """Bits of the filters that look at the text alone: A 1, B 2, C 4, D 8."""
    text = F.coalesce(text, F.lit(""))
    n = let(words(text), lambda w: F.struct(F.size(w).alias("all"), F.size(F.array_distinct(w)).alias("own")))
    counted = let(n, lambda n: F.when(n["all"] < MIN_WORDS, 1).otherwise(0) + F.when(100 * n["own"].cast("long") < MIN_DISTINCT * n["all"].cast("long"), 2).otherwise(0))
    size = F.length(text).cast("long")
    capitals = size - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return counted + F.when(100 * capitals > MAX_CAPITALS * size, 4).otherwise(0) + F.when(text.rlike(f"[{SIGNS}]"), 8).otherwise(0)


def mask_cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, good, toxic, n): documents by failure mask and labels."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.sha2(text.cast("binary"), 256).alias("h"), text_mask(F.col(text_col)).alias("mask"),
    )
    rows = stored(rows.groupBy("id", "part", "h", "mask").agg(F.count(F.lit(1)).alias("n")))
    named = rows.filter("id is not null")
    first = named.groupBy("h").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    said = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    mask = F.col("mask") + F.when(F.col("first").isNull(), 16).otherwise(0)
    flag = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    joined = named.hint("merge").join(first, ["h", "id"], "left").hint("merge").join(said, "id", "left").select("part", mask.alias("mask"), flag("good"), flag("toxic"), "n")
    nameless = rows.filter("id is null").select("part", "mask", F.lit(0).alias("good"), F.lit(0).alias("toxic"), "n")
    return joined.union(nameless).groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def gray_toggles(n: int) -> list[tuple[int, bool, int]]:
    """(bit, switched on or off, the subset reached) of each step of the Gray code over n bits."""
    code = [i ^ (i >> 1) for i in range(1 << n)]
    return [((a ^ b).bit_length() - 1, b > a, b) for a, b in zip(code, code[1:], strict=False)]


def survivors(cells: np.ndarray, n: int) -> np.ndarray:
    """Of counts (..., 2^n masks), the counts that survive each subset of active filters (..., 2^n subsets), by a Gray-code walk."""
    masks, fails = np.arange(1 << n), np.zeros(1 << n, dtype=np.int64)
    run = cells.sum(axis=-1)
    states = np.empty_like(cells)
    states[..., 0] = run
    for bit, on, subset in gray_toggles(n):
        passed = fails == 0
        fails += ((masks >> bit) & 1) * (1 if on else -1)
        run = run + cells @ ((fails == 0).astype(np.int64) - passed)
        states[..., subset] = run
    return states


def states(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part; kept, good, toxic by subset; failing, alone, shapley by filter) of (part, mask, good, toxic, n), one row a part."""
    n = len(filters)
    own = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "good", "toxic", "n")).alias("cells"))  # 4 x 2^n at most
    names = ("kept", "good", "toxic", "failing", "alone", "shapley")
    masks = np.arange(1 << n)
    members = np.array([(masks >> f) & 1 for f in range(n)])
    weights = np.array([factorial(s.bit_count()) * factorial(n - 1 - s.bit_count()) if s.bit_count() < n else 0 for s in range(1 << n)])

    def run(batches):
        for batch in batches:
            counts = np.zeros((batch.num_rows, 3, 1 << n), dtype=np.int64)
            for i, held in enumerate(batch.column(1).to_pylist()):
                for c in held:
                    counts[i, :, c["mask"]] += np.array([1, c["good"], c["toxic"]]) * c["n"]
            kept = survivors(counts, n)
            gains = [[(weights[s], kept[:, 0, s] - kept[:, 0, s | 1 << f]) for s in range(1 << n) if not s >> f & 1] for f in range(n)]
            shapley = np.stack([sum(w * g for w, g in gain) for gain in gains], axis=1)
            values = [kept[:, 0], kept[:, 1], kept[:, 2], counts[:, 0] @ members.T, counts[:, 0][:, [1 << f for f in range(n)]], shapley]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(v.tolist(), pa.list_(pa.int64())) for v in values]], ["part", *names])

    return own.mapInArrow(run, "part string, " + ", ".join(f"{c} array<bigint>" for c in names))


def audit(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row for each part, order of the filters and step: what the step keeps, removes and loses."""
    steps = []
    for order in permutations(range(len(filters))):
        before = 0
        for k, f in enumerate(order, 1):
            steps.append(("".join(filters[i] for i in order), k, f, before, before | 1 << f))
            before |= 1 << f
    kinds = "array<struct<filter_order:string,step:int,f:int,before:int,after:int>>"
    listed = F.from_json(F.lit("[" + ",".join(f'{{"filter_order":"{o}","step":{k},"f":{f},"before":{a},"after":{b}}}' for o, k, f, a, b in steps) + "]"), kinds)
    rows = states(cells, filters).select("*", F.inline(listed))
    at = lambda c, i: F.get(c, F.col(i))
    lost = lambda c: at(c, "before") - at(c, "after")
    return rows.select(
        "part", "filter_order", "step", at("kept", "after").alias("kept"), lost("kept").alias("removed"), (at("failing", "f") - lost("kept")).alias("redundant"),
        at("alone", "f").alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), at("shapley", "f").alias("shapley"),
    )
