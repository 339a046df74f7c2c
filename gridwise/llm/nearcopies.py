"""Near copies by exact Jaccard similarity of word shingles, found through SimHash and MinHash keys.

A text's shingles are its runs of ``K`` words (the whole text, if shorter); two
texts are near copies if their shingle sets have a Jaccard similarity of
``SIMILAR`` or more. Candidates come from two searches: SimHash fingerprints of
the shingles that the Golay keys of ``simhash`` bring within two bits, and
``BANDS`` bands of ``ROWS`` MinHash values. At a similarity of 0.8 fingerprints
lie some ten bits apart, which no choice of a few Golay keys reaches, so the
bands find the farther pairs: a pair at similarity s shares one with probability
1 - (1 - s^ROWS)^BANDS, which is 0.99997 at 0.8 and more above. Every candidate
is verified on its whole shingle sets, as 32-bit hashes (two different shingles
of texts with m and n of them agree by chance once in 2^32 / mn pairs, which
moves the similarity by some 1 / (m + n)), so no link is false.

Texts of equal words are one class before any of this. Candidates are verified in
two rounds: each class of a key against the least class of the key, which settles
a large group of close copies; then, for keys of three classes or more that it
did not settle, all classes of the key with one another. There no pair is a row:
the classes of a key are dealt to blocks of some ``BLOCK``, two blocks meet in a
task, their overlaps are a product of matrices, and only a spanning forest of
the links leaves it. So every pair of every key is verified, and a task holds
two blocks, however large the group.

Defined results: null text is the empty text; texts without words are one class;
repeated rows give repeated results; an empty table gives no rows; texts of any
length are taken whole.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwise.llm import _vector as v
from gridwise.llm import simhash
from gridwise.llm._common import checkpointed, sized, stored
from gridwise.llm.components import components

K, SIMILAR, BANDS, ROWS = 5, 0.8, 20, 4
BLOCK = 256  # classes of a key that are dealt to one block
_RNG = np.random.default_rng(42)
_XOR, _TIMES = (_RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) for _ in range(2))
_TIMES |= np.uint32(1)


def shingles(text: str | None, k: int = K) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of a text; A-Z are lower-cased."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    h, _, _, first = v.words(data, np.array([0, len(data)]), lower=True)
    return np.unique(v.shingles(h, first, k)[0])


def sketch(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Keys of the bands (rows x BANDS) of the shingle sets hashes[bounds[i]:bounds[i + 1]], none of them empty."""
    h = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.empty((BANDS, ROWS, len(bounds) - 1), dtype=np.uint32)
    x, y = np.empty_like(h), np.empty_like(h)
    for p in range(BANDS * ROWS):
        np.multiply(np.bitwise_xor(h, _XOR[p], out=x), _TIMES[p], out=x)
        np.bitwise_xor(x, np.right_shift(x, np.uint32(15), out=y), out=x)
        np.minimum.reduceat(x, bounds[:-1], out=least[p // ROWS, p % ROWS])
    out = np.repeat(np.arange(BANDS, dtype=np.uint64)[:, None], len(bounds) - 1, axis=1)
    for j in range(ROWS):
        out = v.mix(out * v.P1 + least[:, j])
    return out.T


def majority(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """SimHash fingerprints of the shingle sets hashes[bounds[i]:bounds[i + 1]], none of them empty."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).view(np.uint64)  # eight counters of a byte each in a number
    cuts = np.union1d(bounds[:-1], np.arange(0, bounds[-1], 255))  # few enough rows that no counter overflows
    some = np.add.reduceat(bits, cuts, axis=0).view(np.uint8)
    ones = np.add.reduceat(some, np.searchsorted(cuts, bounds[:-1]), axis=0, dtype=np.int64)
    return np.packbits(2 * ones > np.diff(bounds)[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def _sketches(docs: DataFrame, id_col: str, text_col: str, k: int, golay: bool) -> DataFrame:
    """(k, cls, bands, fp): class (hash of the word sequence), band keys and fingerprint of each row of docs."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for at, data, bounds in v.pieces(batch.column(1)):
                h, _, _, first = v.words(data, bounds, lower=True)
                cls = v.sequence_hashes(h, first)
                s, ends = v.shingles(h, first, k)
                some = np.flatnonzero(np.diff(ends))
                filled = np.append(ends[:-1][some], ends[-1])
                bands, fp = np.empty((0, BANDS), np.uint64), np.zeros(len(cls), dtype=np.uint64)
                if len(some):
                    bands = sketch(s, filled)
                    if golay:
                        fp[some] = majority(s, filled)
                size = np.concatenate([[0], np.cumsum(np.where(np.diff(ends) > 0, BANDS, 0))]).astype(np.int32)
                held = pa.ListArray.from_arrays(pa.array(size), pa.array(np.ascontiguousarray(bands).view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(cls)), pa.array(cls.view(np.int64)), held, pa.array(fp.view(np.int64))], ["k", "cls", "bands", "fp"]
                )

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"k {kind}, cls long, bands array<long>, fp long")


def _sets(texts: DataFrame, k: int) -> DataFrame:
    """(cls, s array<int>): the distinct 32-bit shingle hashes of (cls, text)."""

    def run(batches):
        for batch in batches:
            for at, data, bounds in v.pieces(batch.column(1)):
                h, _, _, first = v.words(data, bounds, lower=True)
                s, ends = v.shingles(h, first, k)
                s = (s >> np.uint64(32)).astype(np.uint32).view(np.int32)
                sets = [np.unique(s[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                size = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
                held = pa.ListArray.from_arrays(pa.array(size), pa.array(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(sets)), held], ["cls", "s"])

    return texts.select("cls", "text").mapInArrow(run, "cls long, s array<int>")


def _bound(similar: float) -> tuple[int, int]:
    """(p, q): sets of m and n elements with i in common are similar enough if p * i >= q * (m + n)."""
    f = Fraction(similar).limit_denominator(10_000)
    return f.numerator + f.denominator, f.numerator


def _similar(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """The pairs (a, b) of classes whose sets are similar enough."""
    p, q = _bound(similar)
    left = sets.select(F.col("cls").alias("a"), F.col("s").alias("x"))
    right = sets.select(F.col("cls").alias("b"), F.col("s").alias("y"))
    both = pairs.hint("merge").join(left, "a").hint("merge").join(right, "b")
    return both.filter(p * F.size(F.array_intersect("x", "y")) >= q * (F.size("x") + F.size("y"))).select("a", "b")


def forest(sets: list[np.ndarray], similar: float, width: int = 2048) -> np.ndarray:
    """Root of each set: the first that it reaches by links of similarity ``similar``."""
    p, q = _bound(similar)
    n = np.array([len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), n)
    shared = count[column] > 1  # the others overlap with none
    number = np.cumsum(count > 1) - 1
    owner, column = owner[shared], number[column[shared]]
    by = np.argsort(column, kind="stable")
    owner, column = owner[by], column[by]
    overlap = np.zeros((len(sets), len(sets)), dtype=np.float64)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        part = slice(*np.searchsorted(column, [at, at + width]))
        held = np.zeros((len(sets), width), dtype=np.float32)
        held[owner[part], column[part] - at] = 1
        overlap += held @ held.T
    a, b = np.nonzero(np.triu(p * overlap >= q * (n[:, None] + n[None, :]), 1))
    root = np.arange(len(sets))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _in_blocks(members: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """Links (a, b) of a spanning forest of each key's classes; members are (band, cls, n), n the classes of the key."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("cls"), blocks).cast("int")
    others = F.filter(F.sequence(F.lit(0), blocks - 1), lambda j: (j != mine) | (blocks == 1))
    dealt = members.withColumn("other", F.explode(others)).select("band", F.least(mine, "other").alias("i"), F.greatest(mine, "other").alias("j"), "cls")
    dealt = dealt.hint("merge").join(sets, "cls").repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "cls").select("band", "i", "j", "cls", "s")

    def run(batches):
        key, cls, held = None, [], []

        def links():
            root = forest(held, similar) if len(held) > 1 else np.zeros(len(held), dtype=int)
            own = np.array(cls, dtype=np.int64)
            x = np.flatnonzero(root != np.arange(len(root)))
            return pa.RecordBatch.from_arrays([pa.array(own[x]), pa.array(own[root[x]])], ["a", "b"])

        for batch in batches:
            for *at, c, s in zip(*(x.to_pylist() for x in batch.columns[:4]), batch.column(4), strict=True):
                if at != key:
                    if held:
                        yield links()
                    key, cls, held = at, [], []
                cls.append(c)
                held.append(s.values.to_numpy())
        if held:
            yield links()

    return dealt.mapInArrow(run, "a long, b long")


def _golay_links(classes: DataFrame) -> DataFrame:
    """(key, cls): classes under a common key whose fingerprints link by the Golay keys of op8."""
    prints = checkpointed(classes.groupBy("fp").agg(F.count(F.lit(1)).alias("n")))
    found = checkpointed(simhash.components_of(prints))  # (fp, root)
    rooted = classes.select("cls", "fp").hint("merge").join(found, "fp", "left")
    return rooted.select(F.xxhash64(F.lit("golay"), F.coalesce("root", "fp")).alias("band"), "cls")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, similar: float = SIMILAR, golay: bool = False) -> DataFrame:
    """(id_col, component): component is the smallest id reachable through links of similarity ``similar`` or more.

    With golay, the SimHash search serves beside the bands.
    """
    made = stored(_sketches(docs, id_col, text_col, k, golay))
    classes = stored(made.groupBy("cls").agg(F.min("k").alias("least"), F.first("bands").alias("bands"), F.first("fp").alias("fp")))
    bands = classes.select("cls", F.explode("bands").alias("band")).select("band", "cls")
    if golay:
        bands = bands.union(_golay_links(classes.filter("size(bands) > 0")))
    counts = stored(bands.groupBy("band").agg(F.min("cls").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    met = stored(bands.join(sized(counts), "band").select("band", "cls", "b", "n"))
    owners = checkpointed(classes.hint("merge").join(met.select("cls").distinct(), "cls").select("cls", F.col("least").alias("of")))
    text = docs.select(F.col(id_col).alias("least"), F.col(text_col).alias("text"))
    sets = stored(_sets(text.join(sized(owners), F.col("least").eqNullSafe(F.col("of"))).select("cls", "text").dropDuplicates(["cls"]), k))
    linked = checkpointed(_similar(met.filter("cls <> b").select(F.col("cls").alias("a"), "b").distinct(), sets, similar))
    settled = linked.select(F.col("a").alias("cls"), "b")
    left = checkpointed(met.filter("n > 2 and cls <> b").hint("merge").join(settled, ["cls", "b"], "left_anti").select("band").distinct())
    more = checkpointed(_in_blocks(met.select("band", "cls", "n").hint("merge").join(left, "band", "left_semi"), sets, similar))
    roots = checkpointed(components(linked.union(more)).select(F.col("node").alias("cls"), "root"))
    rooted = classes.select("cls", "least").hint("merge").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    heads = rooted.groupBy("root").agg(F.min("least").alias("component"))
    whole = checkpointed(rooted.hint("merge").join(heads, "root").select("cls", "component"))
    return made.select("cls", F.col("k").alias(id_col)).hint("merge").join(whole, "cls").select(id_col, "component")
