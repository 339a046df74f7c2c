"""SimHash near-duplicates by Golay-code fuzzy hashing.

A document's 64-bit fingerprint is cut into three segments of 22, 21 and 21
bits, each padded to a word of the perfect binary Golay code [23, 12, 7]. A
word decodes to the index of its nearest codeword and, if that is three bits
away, also to the five codewords four bits away; two words that differ in at
most two bits share an index. Of two fingerprints within two bits, one of the
three segments has no error (pigeonhole) and the following one has at most two,
so a key (exact segment, index of the next segment) is common to both: three
times one or six keys a fingerprint. Fingerprints that share a key are
compared; those within ``max_bits`` link. Equal fingerprints are one class
before any of this, so copies cost nothing.

Within a key, only a spanning forest of the links is passed on, and a key with
more than ``CAP`` fingerprints is not compared in one task: its fingerprints
link through one-bit neighbours instead (two fingerprints are within two bits
if and only if they share a neighbour within one bit), which is exact and
linear.

Defined results: null text is the empty text; texts without words have
fingerprint zero and link like any other; repeated rows give repeated results;
an empty table gives no rows. A null id takes part and is no component's id
unless all its members have none.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridwise.llm._common import checkpointed
from gridwise.llm.components import components

SEGMENTS = ((42, 22), (21, 21), (0, 21))  # (shift, bits)
CAP = 2048  # fingerprints of one key that a task compares with one another
_GENERATOR = 0b101011100011  # x^11+x^9+x^7+x^6+x^5+x+1


def _remainder(words: np.ndarray) -> np.ndarray:
    out = words.copy()
    for shift in range(11, -1, -1):
        out = np.where((out >> (shift + 11)) & 1, out ^ (_GENERATOR << shift), out)
    return out


@lru_cache(maxsize=1)
def golay_patterns() -> np.ndarray:
    """(2048, 6) error patterns by syndrome: the coset leader, then the weight-4 ones (or -1)."""
    table = np.full((2048, 6), -1, dtype=np.int64)
    filled = np.zeros(2048, dtype=np.int64)
    for weight in range(5):
        patterns = np.array([sum(1 << i for i in c) for c in combinations(range(23), weight)], dtype=np.int64)
        for p, s in zip(patterns.tolist(), _remainder(patterns).tolist(), strict=True):
            table[s, filled[s]] = p
            filled[s] += 1
    return table


def golay_indices(words: np.ndarray) -> np.ndarray:
    """(n, 6) codeword indices of 23-bit words; -1 where a word has one index only."""
    words = words.astype(np.int64)
    patterns = golay_patterns()[_remainder(words)]
    return np.where(patterns < 0, -1, (words[:, None] ^ patterns) >> 11)


def keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): the pigeonhole keys of uint64 fingerprints."""
    rows, out = [], []
    segments = [((fingerprints >> np.uint64(s)) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in SEGMENTS]
    for i, exact in enumerate(segments):
        index = golay_indices(segments[(i + 1) % 3])
        row, col = np.nonzero(index >= 0)
        rows.append(row)
        out.append((np.int64(i) << 40) | (exact[row] << 12) | index[row, col])
    return np.concatenate(rows), np.concatenate(out)


def fingerprint(text: str | None, k: int = 3, block: int = 65536) -> int:
    """Bit by bit majority of the XXH64 values (seed 42) of the k-word shingles, repeats included."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, ASCII white space only
    if not w:
        return 0
    if len(w) <= k:
        return xxhash.xxh64_intdigest(b" ".join(w), 42)
    flat = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w))) + np.arange(len(w))
    starts = np.concatenate([[0], ends[:-1] + 1])
    n, ones, h = len(w) - k + 1, np.zeros(64, dtype=np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, block):
        a, b = starts[at : min(n, at + block)].tolist(), ends[at + k - 1 : min(n, at + block) + k - 1].tolist()
        values = np.array([h(flat[x:y], 42) for x, y in zip(a, b, strict=True)], dtype=">u8")
        ones += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3) -> DataFrame:
    """(id_col, fp long): one row for each row of docs."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), k) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["k", "fp"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, fp long")


def _forest(fp: np.ndarray, max_bits: int) -> np.ndarray:
    """Root of each fingerprint within one key: the first that it reaches by links of up to max_bits."""
    n = len(fp)
    root = np.arange(n)
    near = [np.flatnonzero(np.bitwise_count(fp[i + 1 :] ^ fp[i]) <= max_bits) + i + 1 for i in range(n - 1)]
    a = np.repeat(np.arange(n - 1), [len(x) for x in near]) if n > 1 else np.empty(0, int)
    b = np.concatenate(near) if n > 1 else np.empty(0, int)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def links(prints: DataFrame, max_bits: int = 2) -> DataFrame:
    """(a, b) fingerprints of a spanning forest of the links; prints has distinct fingerprints fp."""

    def make(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            row, key = keys(fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row])], ["key", "fp"])

    def compare(batches):
        """Rows come sorted by key: links of each key, or all its fingerprints (b null) if they are many."""
        held_key, held, hot = None, [], False
        a, b = [], []

        def close():
            nonlocal held
            if held and not hot:
                fp = np.concatenate(held)
                if len(fp) > 1:
                    root = _forest(fp.view(np.uint64), max_bits)
                    x = np.flatnonzero(root != np.arange(len(fp)))
                    a.append(fp[x])
                    b.append(fp[root[x]])
            held = []

        def flush():
            x = np.concatenate(a) if a else np.empty(0, np.int64)
            y = [np.concatenate(b)] if b else []
            out = pa.RecordBatch.from_arrays([pa.array(x), pa.concat_arrays([pa.array(y[0]) if y else pa.array([], pa.int64())])], ["a", "b"])
            a.clear(), b.clear()
            return out

        for batch in batches:
            key, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            if not len(key):
                continue
            cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            stops = np.append(cuts[1:], len(key))
            crowded = []
            for s, e in zip(cuts.tolist(), stops.tolist(), strict=True):
                if key[s] != held_key:
                    close()
                    held_key, hot = key[s], False
                if not hot:
                    held.append(fp[s:e])
                    if sum(map(len, held)) > CAP:
                        crowded += held
                        held, hot = [], True
                else:
                    crowded.append(fp[s:e])
            yield flush()
            if crowded:
                x = np.concatenate(crowded)
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.nulls(len(x), pa.int64())], ["a", "b"])
        close()
        yield flush()

    dealt = prints.select("fp").mapInArrow(make, "key long, fp long").repartition("key").sortWithinPartitions("key", "fp")
    found = dealt.mapInArrow(compare, "a long, b long").distinct()
    return found


def _through_neighbours(crowded: DataFrame, max_bits: int) -> DataFrame:
    """Links of the fingerprints of crowded keys: star links among those that share a one-bit neighbour (max_bits 2)."""
    flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << i) - (1 << 64) * (i == 63)).cast("long") for i in range(64)])
    near = crowded.select("fp", F.explode(F.transform(flips, lambda x: x.bitwiseXOR(F.col("fp")))).alias("near"))
    least = near.groupBy("near").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return near.hint("merge").join(least, "near").filter("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


def components_of(prints: DataFrame) -> DataFrame:
    """(fp, root) of the distinct fingerprints fp that link to others, at most two bits away."""
    found = checkpointed(links(prints))
    crowded = found.filter("b is null").select(F.col("a").alias("fp")).distinct()
    pairs = found.filter("b is not null").union(_through_neighbours(crowded, 2))
    return components(pairs).select(F.col("node").alias("fp"), "root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3) -> DataFrame:
    """(id_col, fp long, component): component is the smallest id reachable through links of at most two bits."""
    prints = checkpointed(fingerprints(docs, id_col, text_col, k))
    classes = prints.groupBy("fp").agg(F.min(id_col).alias("least"))
    rooted = classes.hint("merge").join(components_of(classes), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    named = rooted.hint("merge").join(least, "root").select("fp", "component")
    return prints.hint("merge").join(named, "fp").select(F.col(id_col), "fp", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes=near_duplicates) -> DataFrame:
    """One row of each component of ``classes`` (smallest id, then text hash), all columns as they are."""
    keyed = docs.withColumn("__key", F.struct(F.col(id_col), F.xxhash64(F.col(text_col))))
    found = classes(keyed.select("__key", text_col), "__key", text_col)
    heads = found.filter("__key <=> component").select(F.col("__key").alias("__head")).distinct()
    kept = keyed.hint("merge").join(heads, F.expr("__key <=> __head"), "left_semi")
    first = kept.withColumn("__n", F.row_number().over(W.partitionBy("__key").orderBy("__key"))).filter("__n = 1")
    return first.select(*[f"`{c}`" for c in docs.columns])
