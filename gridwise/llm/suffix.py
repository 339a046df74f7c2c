"""Suffix-array deduplication of long byte strings.

Finds every byte that lies in a ``length``-byte string which also starts
somewhere else in the corpus, and removes it.

1. Every ``length``-byte window names its anchor: the place of the least hash
   among its k-byte grams. Equal windows have equal anchors, so only windows
   whose anchor hash occurs twice can repeat. Consecutive windows with one
   anchor are a run, which is a slice of run + length - 1 bytes.
2. Equal slices with one anchor hash are one class with its multiplicity, and
   one text of each class is fetched (hot passages and copies shrink here, by
   partial aggregation).
3. Classes are dealt to shards by anchor hash; an anchor hash with very many
   classes is salted over several shards. Each shard builds a suffix array of
   its slices by Larsson-Sadakane refinement (ranks of 8 bytes, doubled; only
   groups that are not yet singletons are sorted again) and Kasai's common
   prefixes, in numpy; neighbours in suffix order that share ``length`` bytes
   are repeats.
4. Shards of one salted anchor hash are merged: each hands on its sorted window
   digests, cut into digest ranges; each range looks up every shard's digests
   in the merged order by binary search, so no task sees the whole group.
5. Repeats go back to all members of their class, and to the texts.

Defined results: null text is empty; texts under ``length`` bytes lose nothing;
repeated rows are separate texts (so a repeated long row loses all its bytes);
null ids are allowed; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwise.llm._common import partitions, sized, stored

LENGTH = 400  # bytes of a string that counts as a repeat
GRAM = 96  # bytes whose hash places the anchor
CLASSES_PER_SHARD = 2000  # of one anchor hash, before it is salted
SHARD_BYTES = 2_000_000  # slices that one suffix array holds (whole anchor hashes, so it may be more)
RANGES = 16  # digest ranges over which the shards of a salted anchor hash are merged
_BASE = 0x9E3779B97F4A7C15
_LONG = 4_000_000  # longer texts are hashed in overlapping pieces of so many bytes


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class _Hashes:
    """Polynomial hashes (modulo 2^64) of all substrings of texts of up to n bytes."""

    def __init__(self):
        self.n = 0

    def grow(self, n: int) -> None:
        if n > self.n:
            self.n = max(n, 2 * self.n, 1 << 16)
            self.up, self.down = _powers(_BASE, self.n), _powers(pow(_BASE, -1, 1 << 64), self.n)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self.grow(len(data) + 1)
        out = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_mix(data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=out[1:])
        return out

    def of(self, prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mix((prefix[stop] - prefix[start]) * self.down[start])


def runs(data: np.ndarray, hashes: _Hashes, length: int = LENGTH, gram: int = GRAM):
    """(start, stop, anchor hash, slice hash) of the runs of windows with one anchor; stop is past the last window's start."""
    n = len(data) - length + 1
    if n < 1:
        return tuple(np.empty(0, dtype=t) for t in (np.int64, np.int64, np.uint64, np.uint64))
    prefix = hashes.prefix(data)
    at = np.arange(len(data) - gram + 1)
    h = _mix((prefix[gram:] - prefix[:-gram]) * hashes.down[: len(at)])
    w = length - gram + 1
    v = (h & np.uint64(0xFFFFFFFFFF000000)) | at.astype(np.uint64)  # least hash, leftmost place
    x = np.concatenate([v, np.full(-len(v) % w, 2**64 - 1, dtype=np.uint64)]).reshape(-1, w)
    before = np.minimum.accumulate(x, axis=1).ravel()
    after = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(after[:n], before[w - 1 : w - 1 + n])
    start = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    stop = np.append(start[1:], n)
    place = (least[start] & np.uint64(0xFFFFFF)).astype(np.int64)
    # the slice hash also tells where the anchor lies in the slice
    whole = hashes.of(prefix, start, stop + length - 1)
    return start, stop, h[place], _mix(whole + (place - start).astype(np.uint64) * np.uint64(_BASE))


def _anchors(docs: DataFrame, length: int) -> DataFrame:
    def run(batches):
        hashes = _Hashes()
        for batch in batches:
            held, size = [], 0
            for i in range(batch.num_rows):
                data = batch.column(2)[i].as_buffer()
                data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
                for piece in range(0, max(1, len(data) - length + 1), _LONG):
                    a, b, fp, sd = runs(data[piece : piece + _LONG + length - 1], hashes, length)
                    held.append((np.full(len(a), i), a + piece, b - a, fp, sd))
                    size += len(a)
                if size > 100_000:
                    yield _anchor_batch(batch, held)
                    held, size = [], 0
            yield _anchor_batch(batch, held)

    return docs.mapInArrow(run, "did long, rk long, at int, n int, fp long, sd long")


def _anchor_batch(batch, held):
    row, at, n, fp, sd = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (list(zip(*held, strict=True)) or [[]] * 5))
    row = pa.array(row.astype(np.int64))
    return pa.RecordBatch.from_arrays(
        [batch.column(0).take(row), batch.column(1).take(row), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(fp.astype(np.uint64).view(np.int64)), pa.array(sd.astype(np.uint64).view(np.int64))],
        ["did", "rk", "at", "n", "fp", "sd"],
    )


def _eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one number (zeros past the end)."""
    d = np.concatenate([data, np.zeros(8, np.uint8)])
    out = d[: len(data)].astype(np.uint64)
    for i in range(1, 8):
        out = (out << np.uint64(8)) | d[i : i + len(data)]
    return out


def suffix_array(data: np.ndarray, depth: int, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes with depth bytes left, in the order of those bytes; which share their rank; the 8-byte words. Larsson-Sadakane refinement.

    left has the bytes that each suffix has to the end of its own slice; one that has fewer than the depth
    reached is not refined any more (no longer suffix asks for its rank).
    """
    words = _eights(data)
    order = np.flatnonzero(left >= 8)
    order = order[np.argsort(words[order])]
    rank = np.zeros(len(data), dtype=np.uint32)
    w = words[order]
    heads = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
    sizes = np.diff(np.append(heads, len(order)))
    rank[order] = np.repeat(heads, sizes)
    todo = np.flatnonzero(np.repeat(sizes > 1, sizes))  # places of the order in groups of two or more
    h = 8
    while h < depth and len(todo):
        step = min(h, depth - h)
        h += step
        at = order[todo]
        deep = left[at] >= h
        todo, at = todo[deep], at[deep]
        if not len(todo):
            break
        key = (rank[at].astype(np.uint64) << np.uint64(32)) | rank[at + step]
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[todo] = at
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(heads, len(at)))
        rank[at] = np.repeat(todo[heads], sizes)
        todo = todo[np.repeat(sizes > 1, sizes)]
    shared = np.zeros(len(data), dtype=bool)
    shared[order[todo]] = True
    return order[left[order] >= depth], shared, words


def _common(words: np.ndarray, a: np.ndarray, b: np.ndarray, known: np.ndarray, depth: int) -> np.ndarray:
    """Common prefixes, up to depth and a few bytes more, of the suffixes at a and b that share known bytes."""
    out, live, n = known.copy(), np.arange(len(a)), len(words)
    while len(live):
        live = live[(out[live] < depth) & (a[live] + out[live] < n) & (b[live] + out[live] < n)]
        x = words[a[live] + out[live]] ^ words[b[live] + out[live]]
        same = x == 0
        if not same.all():
            left = x[~same]
            zero = np.zeros(len(left), dtype=np.int64)
            for i in range(1, 8):
                zero += left < (np.uint64(1) << np.uint64(8 * (8 - i)))
            out[live[~same]] += zero
        live = live[same]
        out[live] += 8
    return out


def repeats(slices: list[bytes], windows: list[int], weights: np.ndarray, length: int = LENGTH):
    """Per slice, whether each of its first ``windows`` strings of length bytes occurs twice: (flags, offsets of the slices in flags, order).

    order has the places (in flags) of all windows in suffix order. A slice of weight two or more stands for as many equal texts.
    """
    data = np.frombuffer(b"".join(slices), dtype=np.uint8)
    sizes = np.array([len(s) for s in slices])
    base = np.concatenate([[0], np.cumsum(sizes)])
    order, shared, words = suffix_array(data, length, np.repeat(base[1:], sizes) - np.arange(len(data)))
    counts = np.asarray(windows)
    offset = np.concatenate([[0], np.cumsum(counts)])
    flag_at = np.full(len(data), -1, dtype=np.int64)  # place in flags of a window's start
    starts = np.repeat(base[:-1], counts) + np.arange(offset[-1]) - np.repeat(offset[:-1], counts)
    flag_at[starts] = np.arange(offset[-1])
    order = order[flag_at[order] >= 0]
    n = len(order)
    place = np.empty(len(data), dtype=np.int64)
    place[order] = np.arange(n)
    flags = np.repeat(np.asarray(weights) > 1, counts)
    # Kasai, in step over all slices: a window shares at least one byte less with its predecessor than the window before it
    known = np.zeros(len(slices), dtype=np.int64)
    lanes = np.arange(len(slices))
    for t in range(int(counts.max(initial=0))):
        lanes = lanes[counts[lanes] > t]
        a = base[lanes] + t
        alone = ~shared[a]  # of its rank, so that nothing is left to compare
        known[lanes[alone]] = 0
        own, a = lanes[~alone], a[~alone]
        p = place[a]
        b = order[np.maximum(p - 1, 0)]
        l = np.where(p > 0, _common(words, a, b, np.where(p > 0, known[own], 0), length), 0)
        hit = l >= length
        flags[flag_at[a[hit]]] = True
        flags[flag_at[b[hit]]] = True
        # only if what follows both is a window, in the same order (equal to the depth of the order, it need not be)
        x, y = np.minimum(a + 1, len(data) - 1), np.minimum(b + 1, len(data) - 1)
        follows = (p > 0) & (flag_at[x] == flag_at[a] + 1) & (flag_at[y] == flag_at[b] + 1)
        follows &= np.where(follows, place[y], 1) < np.where(follows, place[x], 0)
        known[own] = np.where(follows, np.clip(l - 1, 0, length), 0)
    return flags, offset, flag_at[order], starts, data


def _spans(flags: np.ndarray, offset: np.ndarray):
    """Runs of true flags: (slice, first, past the last) within each slice."""
    f = np.concatenate([[0], flags.astype(np.int8), [0]])
    inner = np.zeros(len(flags) + 1, dtype=bool)
    inner[offset[:-1]] = True  # a run ends where its slice ends
    rise = np.flatnonzero((f[1:-1] == 1) & ((f[:-2] == 0) | inner[:-1]))
    fall = np.flatnonzero((f[1:-1] == 1) & ((f[2:] == 0) | inner[1:] | (np.arange(len(flags)) == len(flags) - 1))) + 1
    owner = np.searchsorted(offset, rise, side="right") - 1
    return owner, rise - offset[owner], fall - offset[owner]


def _search(length: int):
    """Shards of the rows (fp, salt, salts, sd, weight, n, slice), sorted by fp and salt: spans, and digests of salted anchors."""

    def shard(rows):
        fp, salt, salts, sd, weight, n, texts = (list(x) for x in zip(*rows, strict=True))
        flags, offset, order, starts, data = repeats(texts, n, np.array(weight), length)
        sd = np.array(sd, dtype=np.int64)
        fp = np.array(fp, dtype=np.int64)
        owner, lo, hi = _spans(flags, offset)
        out = [(fp[owner], sd[owner], lo, hi, None, None)]
        for f in {x for x, s in zip(fp.tolist(), salts, strict=True) if s > 1}:
            mine = np.flatnonzero(fp == f)
            where = np.repeat(np.arange(len(texts)), np.diff(offset))
            held = order[np.isin(where[order], mine)]  # in suffix order
            hashes = _Hashes()
            prefix = hashes.prefix(data)
            digest = hashes.of(prefix, starts[held], starts[held] + length)
            digest, held = digest[by := np.argsort(digest, kind="stable")], held[by]
            new = np.concatenate([[True], digest[1:] != digest[:-1]])  # one of each string
            digest, held = digest[new], held[new]
            cut = (digest >> np.uint64(60)).astype(np.int64)
            for r in range(RANGES):
                at = slice(*np.searchsorted(cut, [r, r + 1]))
                if at.start < at.stop:
                    h = held[at]
                    packed = (digest[at].tobytes(), sd[where[h]].tobytes() + (h - offset[where[h]]).astype(np.int64).tobytes() + flags[h].astype(np.int8).tobytes())
                    out.append(([f], [0], [r], [0], [packed[0]], [packed[1]]))
        return out

    def batch(parts):
        cols = [np.concatenate([np.asarray(p[i], dtype=np.int64) for p in parts]) for i in range(4)]
        blobs = [[y for p in parts for y in (p[i] if p[i] is not None else [None] * len(p[0]))] for i in (4, 5)]
        return pa.RecordBatch.from_arrays([*map(pa.array, cols), *(pa.array(b, pa.binary()) for b in blobs)], ["fp", "sd", "lo", "hi", "digests", "places"])

    def run(batches):
        rows, size, last = [], 0, None
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if rows and row[:2] != last and size > SHARD_BYTES:
                    yield batch(shard(rows))
                    rows, size = [], 0
                last = row[:2]
                rows.append(row)
                size += len(row[6])
        if rows:
            yield batch(shard(rows))

    return run


def _merge(batches_of_one_range):
    """One digest range of one salted anchor hash: strings that are in several shards, or repeated in another one."""
    import pandas as pd

    pdf = batches_of_one_range
    digests = [np.frombuffer(x, dtype=np.uint64) for x in pdf["digests"]]
    merged = np.sort(np.concatenate(digests))
    out = []
    for d, blob in zip(digests, pdf["places"], strict=True):
        n = len(d)
        sd, at = np.frombuffer(blob, np.int64, 2 * n).reshape(2, n)
        known = np.frombuffer(blob, np.int8, n, 16 * n).astype(bool)
        found = np.searchsorted(merged, d, side="right") - np.searchsorted(merged, d, side="left") > 1
        x = np.flatnonzero(found & ~known)
        x = x[np.lexsort((at[x], sd[x]))]
        if len(x):
            s, p = sd[x], at[x]
            new = np.concatenate([[True], (s[1:] != s[:-1]) | (p[1:] != p[:-1] + 1)])
            head = np.flatnonzero(new)
            tail = np.append(head[1:], len(x)) - 1
            out.append(pd.DataFrame({"fp": int(pdf["fp"].iloc[0]), "sd": s[head], "lo": p[head], "hi": p[tail] + 1}))
    return pd.concat(out) if out else pd.DataFrame({c: np.empty(0, np.int64) for c in ("fp", "sd", "lo", "hi")})


def _cut(length: int):
    """(did, kept bytes, spans) from (did, data, ranges of window starts)."""

    def run(batches):
        for whole, i in ((b, i) for b in batches for i in range(0, max(1, b.num_rows), 512)):
            batch = whole.slice(i, 512)
            kept, spans, sizes = [], [], []
            for data, found in zip(batch.column(1), batch.column(2), strict=True):
                data = data.as_py() or b""
                cover: list[list[int]] = []
                for r in sorted((r["lo"], r["hi"] + length - 1) for r in found.as_py() or ()):
                    if cover and r[0] <= cover[-1][1]:
                        cover[-1][1] = max(cover[-1][1], r[1])
                    else:
                        cover.append(list(r))
                ends = [0, *(x for c in cover for x in c), len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)) if cover else data)
                spans.append([{"start": a, "stop": b} for a, b in cover])
                sizes.append(len(data))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], ["k", "n_bytes", "spans", "kept"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(id_col, n_bytes, spans array<struct<start, stop>>, kept binary): each text with its repeated bytes removed."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    # a row's key: a hash of its id and one of its text; rows that share both are equal texts and share their result
    keyed = docs.select(F.xxhash64(F.col(id_col)).alias("did"), F.xxhash64(F.col(text_col)).alias("rk"), data.alias("data"), F.col(id_col).alias("id"))
    anchors = stored(_anchors(keyed.select("did", "rk", "data"), length))
    # sides that were aggregated are written first, so that a hot anchor hash is broadcast against or split over tasks
    often = stored(anchors.groupBy("fp").count().filter("count > 1").select("fp"))
    found = stored(anchors.join(sized(often), "fp", "left_semi"))
    classes = stored(found.groupBy("fp", "sd").agg(F.count(F.lit(1)).alias("weight"), F.min(F.struct("did", "rk", "at", "n")).alias("r")))
    salts = stored(classes.groupBy("fp").agg(F.ceil(F.count(F.lit(1)) / CLASSES_PER_SHARD).cast("int").alias("salts")))
    classes = classes.join(sized(salts), "fp").select("fp", F.pmod("sd", "salts").cast("int").alias("salt"), "salts", "sd", "weight", "r.*")
    texts = keyed.select("did", "rk", "data").join(classes.select("did", "rk").distinct().hint("shuffle_hash"), ["did", "rk"], "left_semi")
    texts = texts.dropDuplicates(["did", "rk"])
    slices = classes.hint("merge").join(texts, ["did", "rk"]).select("fp", "salt", "salts", "sd", "weight", "n", F.expr(f"substring(data, at + 1, n + {length - 1})").alias("slice"))
    dealt = slices.repartition(partitions(spark), "fp", "salt").sortWithinPartitions("fp", "salt")
    searched = stored(dealt.mapInArrow(_search(length), "fp long, sd long, lo long, hi long, digests binary, places binary"))
    crossed = searched.filter("digests is not null").groupBy("fp", F.col("lo").alias("range")).applyInPandas(_merge, "fp long, sd long, lo long, hi long")
    spans = searched.filter("digests is null").select("fp", "sd", "lo", "hi").union(crossed)
    spans = stored(spans.groupBy("fp", "sd").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")))  # at most one for each window of a slice
    once = found.select("did", "rk", "at", "fp", "sd").distinct()  # repeated rows have their places once
    hits = once.hint("merge").join(spans, ["fp", "sd"]).select("did", "rk", F.expr("transform(spans, s -> struct(int(s.lo + at) as lo, int(s.hi + at) as hi))").alias("r"))
    hits = hits.groupBy("did", "rk").agg(F.array_distinct(F.flatten(F.collect_list("r"))).alias("r"))
    done = keyed.hint("merge").join(hits, ["did", "rk"], "left").select("id", "data", "r")
    return done.mapInArrow(_cut(length), f"`{id_col}` {kind}, n_bytes long, spans array<struct<start: long, stop: long>>, kept binary")
