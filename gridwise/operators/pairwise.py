"""Pairs of rows within groups: dissimilarities, representational similarity, kernel alignment.

Matrices are (group, i, vec array<double>) with i from 0. Pairs are made block by
block: rows of one block meet rows of an equal or later block in one task, by an
equi-join of block keys, so no task holds more than two blocks of a group. There,
pairs are worked out tile by tile. Blocks are as wide as it takes to send a row to
some SPREAD pairs of blocks, so what is shuffled grows with the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridwise.functions.num import finite, half_away
from gridwise.functions.session import checkpointed, sized
from gridwise.operators.ordered import average_ranks

#: Rows of a tile, whose pairs are held at once.
BLOCK = 512
#: Blocks of a group, as long as that takes no more than TILES tiles a block.
SPREAD, TILES = 16, 32
#: Pairs that a task should work out.
TASK_PAIRS = 2_000_000
EPS = 1e-8


def _distances(a: np.ndarray, b: np.ndarray, kind: str) -> np.ndarray:
    if kind == "dot":
        return a @ b.T
    if kind == "euclidean":
        d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
        return np.sqrt(np.maximum(d, 0))
    if kind == "correlation":
        a, b = a - a.mean(1, keepdims=True), b - b.mean(1, keepdims=True)
    elif kind != "cosine":
        raise ValueError(f"unknown dissimilarity {kind!r}")
    na, nb = (np.maximum(np.linalg.norm(x, axis=1), EPS) for x in (a, b))
    return 1 - (a / na[:, None]) @ (b / nb[:, None]).T


def _placed(rows: DataFrame, block: int = BLOCK, tiles: int = TILES, spread: int = SPREAD) -> tuple[DataFrame, int]:
    """rows with their block __b and the last block __top of their group, and the number of tasks that the pairs are worth.

    A block has up to ``tiles`` tiles of ``block`` rows; a group has ``spread`` blocks as long as that is enough.
    """
    n = F.col("__n")
    width = F.greatest(F.lit(1), F.least(F.lit(tiles), F.ceil(n / (block * spread)))) * block
    sizes = rows.groupBy("group").agg((F.max("i") + 1).alias("__n")).select("group", n, width.alias("__w"), F.floor((n - 1) / width).cast("int").alias("__top"))
    sizes = checkpointed(sizes)
    met, pairs = sizes.agg(F.sum((F.col("__top") + 1.0) * (F.col("__top") + 2) / 2), F.sum(n.cast("double") * n / 2)).first()
    at = rows.join(sized(sizes.drop("__n")), "group").withColumn("__b", F.floor(F.col("i") / F.col("__w")).cast("int")).drop("__w")
    return at, int(min(met or 0, (pairs or 0) / TASK_PAIRS, 10_000))


def _spread(rows: DataFrame, columns: list[str], tasks: int) -> DataFrame:
    """Every placed row once for each pair of blocks (__x, __y) that its block __b is part of."""
    spread = rows.select("group", "i", *columns, "__b", F.explode(F.sequence(F.lit(0), F.col("__top"))).alias("__o"))
    spread = spread.withColumns({"__x": F.least("__b", "__o"), "__y": F.greatest("__b", "__o")})
    # few bytes make many pairs, so that partitions that are cut by bytes would be few and uneven
    return spread.repartition(tasks, "group", "__x", "__y") if tasks > 1 else spread


def _low_high(pdf: pd.DataFrame) -> list[pd.DataFrame]:
    return [pdf[pdf["__b"] == pdf[c].iloc[0]].sort_values("i") for c in ("__x", "__y")]


def _blocks(placed: tuple[DataFrame, int], columns: list[str], task, schema: str) -> DataFrame:
    """task(frame, low, high) for every pair of blocks of a group; the frame holds the rows of both, low and high the rows of each in order."""
    return _spread(placed[0], columns, placed[1]).groupBy("group", "__x", "__y").applyInPandas(lambda pdf: task(pdf, *_low_high(pdf)), schema)


def _blocks_told(placed: tuple[DataFrame, int], columns: list[str], told: DataFrame, task, schema: str) -> DataFrame:
    """task(frame, low, high, own) as for _blocks: own are the rows of told with the keys (group, __x, __y) of the pair of blocks."""
    by = ("group", "__x", "__y")
    return _spread(placed[0], columns, placed[1]).groupBy(*by).cogroup(told.groupBy(*by)).applyInPandas(lambda pdf, own: task(pdf, *_low_high(pdf), own), schema)


def _to_blocks(placed: tuple[DataFrame, int], told: DataFrame) -> DataFrame:
    """A row of a group once for each pair of its blocks (__x, __y), not for each row of these."""
    tops = placed[0].select("group", "__top").distinct()
    first = tops.select(F.col("group").alias("group"), "__top", F.explode(F.sequence(F.lit(0), F.col("__top"))).alias("__x"))  # another column than that of the rows
    return first.select("group", "__x", F.explode(F.sequence("__x", "__top")).alias("__y")).join(told, "group")


def _cuts(i: np.ndarray, block: int) -> list[slice]:
    at = [0, *(np.flatnonzero(np.diff(i // block)) + 1).tolist(), len(i)]
    return [slice(a, b) for a, b in zip(at, at[1:], strict=False)]


def _tiles(low: pd.DataFrame, high: pd.DataFrame, vectors: dict[str, str], diagonal: bool = False, block: int = BLOCK):
    """(rows of low, rows of high, pairs to keep, dissimilarities by column) of the tiles of two blocks, as matrices; None keeps all."""
    i, j = low["i"].to_numpy(), high["i"].to_numpy()
    if not len(i) or not len(j):  # numbers may leave out a block
        return
    sides = {c: (np.stack(low[c]).astype(float), np.stack(high[c]).astype(float)) for c in vectors}
    for p in _cuts(i, block):
        for q in _cuts(j, block):
            a, b = i[p], j[q]
            if a[0] > b[-1]:
                continue
            keep = None if a[-1] < b[0] else a[:, None] <= b[None, :] if diagonal else a[:, None] < b[None, :]
            yield p, q, keep, {c: _distances(x[p], y[q], vectors[c]) for c, (x, y) in sides.items()}


def _met(low: pd.DataFrame, high: pd.DataFrame, vectors: dict[str, str], diagonal: bool = False, block: int = BLOCK):
    """(i, j, dissimilarities by column) of the pairs of each tile of two blocks, each pair once."""
    i, j = low["i"].to_numpy(), high["i"].to_numpy()
    for p, q, keep, d in _tiles(low, high, vectors, diagonal, block):
        a, b = np.repeat(i[p], len(j[q])), np.tile(j[q], len(i[p]))
        if keep is None:
            yield a, b, {c: v.ravel() for c, v in d.items()}
        else:
            yield a[keep.ravel()], b[keep.ravel()], {c: v[keep] for c, v in d.items()}


def pairs(rows: DataFrame, vectors: dict[str, str], diagonal: bool = False, block: int = BLOCK, digits: int | None = None) -> DataFrame:
    """(group, i, j, name...) for i < j (i <= j with diagonal): vectors is column -> kind of dissimilarity, rounded to ``digits`` (halves go up).

    Rows are packed into blocks; each block goes to every pair of blocks that it is part of, and its pairs leave it tile by tile.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(list(batches))
        group, pdf = whole["group"][0], whole.drop_columns(["group"]).to_pandas()
        for i, j, d in _met(*_low_high(pdf), vectors, diagonal, block):
            if len(i):
                found = [v if digits is None else half_away(v, digits) for v in d.values()]
                yield pa.RecordBatch.from_arrays([pa.repeat(group, len(i)), pa.array(i, pa.int64()), pa.array(j, pa.int64()), *map(pa.array, found)], ["group", "i", "j", *d])

    kind = rows.schema["group"].dataType.simpleString()
    placed, tasks = _placed(rows, block)
    return _spread(placed, list(vectors), tasks).groupBy("group", "__x", "__y").applyInArrow(task, f"group {kind}, i long, j long, " + ", ".join(f"`{c}` double" for c in vectors))


def _keyed(**columns) -> pd.DataFrame:
    """A frame whose keys are plain objects: pandas' own strings can't be handed on where there are no rows."""
    return pd.DataFrame({c: pd.Series(list(v), dtype=object) if c in ("group", "side") else v for c, v in columns.items()})


#: Numbers of a range that are put in order in one task, and tiles of a block that sends it its numbers.
RANGE, RANK_TILES = 1_000_000, 4
_BIN = 40  # bits of a number below its bin: 4,096 bins for each power of two


def _ordered(bits: np.ndarray) -> np.ndarray:
    """What numbers are stored as, as integers in the order of the numbers; and back again."""
    return bits ^ ((bits >> 63) & np.int64((1 << 63) - 1))


def _bins(v: np.ndarray) -> np.ndarray:
    """Bins of numbers, in the order of the numbers: the first bits of what they are stored as."""
    return _ordered((v + 0.0).view(np.int64)) >> _BIN


def _packed(v: np.ndarray) -> bytes:
    """Rising integers: the first, and the steps to the next ones by as many bytes as the largest step has, the lowest bytes of all first."""
    step = np.diff(v).astype("<u8")
    width = (int(step.max()).bit_length() + 7) // 8 if step.size else 0
    return np.array([v[0], width], "<i8").tobytes() + np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unpacked(b: bytes, n: int) -> np.ndarray:
    first, width = np.frombuffer(b, "<i8", 2)
    step = np.zeros((n - 1, 8), np.uint8)
    step[:, :width] = np.frombuffer(b, np.uint8, offset=16).reshape(width, n - 1).T
    return np.cumsum(np.concatenate([[first], step.reshape(-1).view("<i8")]), dtype=np.int64)


def _counted(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(v, return_counts=True)


def _added(v: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of equal numbers, added up."""
    values, at = np.unique(v, return_inverse=True)
    sums = np.zeros(len(values), np.int64)
    np.add.at(sums, at, n)
    return values, sums


def _histogram(placed: tuple[DataFrame, int], vectors: dict[str, str], block: int = BLOCK) -> DataFrame:
    """(group, side, bin, n, upto, total): pairs by bin of their dissimilarity, of each vector column; bins alone leave the blocks."""
    kind = placed[0].schema["group"].dataType.simpleString()

    def task(pdf, low, high):
        found = {c: ([], []) for c in vectors}
        for _, _, d in _met(low, high, vectors, block=block):
            for c, v in d.items():
                for held, new in zip(found[c], _counted(_bins(v)), strict=True):
                    held.append(new)
        merged = [(c, *_added(*map(np.concatenate, parts))) for c, parts in found.items()]
        side = [c for c, b, _ in merged for _ in b]
        return _keyed(group=[pdf["group"].iloc[0]] * len(side), side=side, bin=np.concatenate([b for _, b, _ in merged]), n=np.concatenate([n for _, _, n in merged]))

    parts = _blocks(placed, list(vectors), task, f"group {kind}, side string, bin long, n long")
    sums = parts.groupBy("group", "side", "bin").agg(F.sum("n").alias("n"))
    by = W.partitionBy("group", "side")
    return sums.withColumns({"upto": F.sum("n").over(by.orderBy("bin")), "total": F.sum("n").over(by)})


def median_distance(rows: DataFrame, x: str = "x", kind: str = "euclidean", block: int = BLOCK) -> DataFrame:
    """(group, sigma): exact median of the dissimilarities of a group's pairs, the mean of the two middle ones of an even number.

    A histogram tells the bins of the middle ones; a second pass over the blocks gives out what falls into those.
    """
    return _median(_placed(rows, block), x, kind, block)


def _median(placed: tuple[DataFrame, int], x: str, kind: str, block: int = BLOCK) -> DataFrame:
    rows, tasks = placed
    name = rows.schema["group"].dataType.simpleString()
    low, high = F.floor((F.col("total") + 1) / 2), F.floor(F.col("total") / 2) + 1  # places of the middle ones, from 1
    holds = lambda place: (F.col("upto") - F.col("n") < place) & (place <= F.col("upto"))
    first = lambda place, v: F.max(F.when(holds(place), v))
    bins = _histogram(placed, {x: kind}, block).groupBy("group").agg(
        first(low, F.col("bin")).alias("low"), first(high, F.col("bin")).alias("high"),
        first(low, low - F.col("upto") + F.col("n") - 1).alias("low_at"), first(high, high - F.col("upto") + F.col("n") - 1).alias("high_at"),
    )
    bins = sized(checkpointed(bins))

    def task(pdf, lows, highs):
        kept, wanted = [_counted(np.zeros(0))], {pdf["low"].iloc[0], pdf["high"].iloc[0]}
        for _, _, d in _met(lows, highs, {x: kind}, block=block):
            at = _bins(d[x])
            kept += [_counted(d[x][at == b]) for b in wanted]
        return pd.DataFrame({"group": pdf["group"].iloc[0], "v": [np.concatenate([v for v, _ in kept])], "n": [np.concatenate([n for _, n in kept])]})

    def middle(pdf: pd.DataFrame) -> pd.DataFrame:
        v, n = np.concatenate([np.asarray(a, dtype=float) for a in pdf["v"]]), np.concatenate([np.asarray(a, dtype=np.int64) for a in pdf["n"]])
        order = np.argsort(v, kind="stable")
        v, n = v[order], n[order]
        found = []
        for b, at in (("low", "low_at"), ("high", "high_at")):
            own = _bins(v) == pdf[b].iloc[0]
            found.append(v[own][np.searchsorted(np.cumsum(n[own]), pdf[at].iloc[0], side="right")])
        return pd.DataFrame({"group": pdf["group"].iloc[:1].tolist(), "sigma": [(found[0] + found[1]) / 2]})

    parts = _blocks((rows.join(bins, "group"), tasks), [x, "low", "high"], task, f"group {name}, v array<double>, n array<long>")
    return parts.join(bins, "group").groupBy("group").applyInPandas(middle, f"group {name}, sigma double")


def _values(low: pd.DataFrame, high: pd.DataFrame, vectors: dict[str, str], block: int = BLOCK) -> Iterator[dict[str, np.ndarray]]:
    """Dissimilarities by column of the pairs of each tile of two blocks, each pair once."""
    for _, _, keep, d in _tiles(low, high, vectors, block=block):
        yield {c: v.ravel() if keep is None else v[keep] for c, v in d.items()}


def _all_values(low: pd.DataFrame, high: pd.DataFrame, vectors: dict[str, str], block: int = BLOCK) -> dict[str, np.ndarray]:
    found = list(_values(low, high, vectors, block))
    return {c: np.concatenate([np.zeros(0), *[d[c] for d in found]]) for c in vectors}


def _rank_moments(rows: DataFrame, x: str, y: str, dissimilarity: str, block: int = BLOCK) -> DataFrame:
    """Moments of the 0-based ranks (ties averaged) of both dissimilarities of a group's pairs, by pair of blocks.

    The histogram cuts the numbers into ranges; each block sends a range its distinct numbers, packed, with their counts where these
    are not all one, and gets their ranks back, packed and in the same order.
    """
    kind, (rows, tasks) = rows.schema["group"].dataType.simpleString(), _placed(rows, block, tiles=RANK_TILES)  # a block sends its ranks at once
    vectors = {x: dissimilarity, y: dissimilarity}
    before = F.col("upto") - F.col("n")
    ranges = _histogram((rows, tasks), vectors, block).withColumns({"range": F.floor(before / RANGE), "before": before})
    ranges = ranges.groupBy("group", "side", "range").agg(F.min("bin").alias("bin"), F.min("before").alias("before"))
    cuts = ranges.groupBy("group").agg(*[F.array_sort(F.collect_list(F.when(F.col("side") == c, F.struct("bin", "range", "before")))).alias(f"cut_{k}") for k, c in (("a", x), ("b", y))])  # an entry for each RANGE of pairs
    cuts = sized(checkpointed(cuts.select("group", *[F.col(f"cut_{k}")[f].alias(f"{k}_{f}") for k in "ab" for f in ("bin", "range", "before")])))

    def give(pdf, low, high, own):
        d = _all_values(low, high, vectors, block)
        if not len(d[x]):  # a block of one row has no pairs
            return _keyed(**{c: [] for c in ("group", "side", "range", "before", "__x", "__y", "size", "v", "n")})
        names = ("group", "side", "range", "before", "__x", "__y", "size", "v", "n")
        out = []
        for k, c in (("a", x), ("b", y)):
            v, n = _counted(d[c])
            first, number, start = (np.asarray(own[f"{k}_{f}"].iloc[0]) for f in ("bin", "range", "before"))
            at = np.searchsorted(first, _bins(v), side="right") - 1
            found, low, size = np.unique(at, return_index=True, return_counts=True)
            for r, a, b in zip(found, low, low + size, strict=True):
                times = b"" if (n[a:b] == 1).all() else n[a:b].astype("<i8").tobytes()
                out.append((pdf["group"].iloc[0], k, number[r], start[r], pdf["__x"].iloc[0], pdf["__y"].iloc[0], b - a, _packed(_ordered((v[a:b] + 0.0).view(np.int64))), times))
        return _keyed(**{c: [row[i] for row in out] for i, c in enumerate(names)})

    def rank(pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = pdf["size"].tolist()
        v, at = np.unique(np.concatenate([_unpacked(b, c) for b, c in zip(pdf["v"], sizes, strict=True)]), return_inverse=True)
        n = np.bincount(at, np.concatenate([np.frombuffer(b, "<i8") if b else np.ones(c) for b, c in zip(pdf["n"], sizes, strict=True)]), len(v)).astype(np.int64)
        twice = (2 * (int(pdf["before"].iloc[0]) + np.cumsum(n) - n) + n - 1)[at]  # ranks end in a half at most
        own = {c: pdf[c].tolist() for c in ("group", "side", "range", "__x", "__y", "size")}
        return pd.DataFrame({**own, "r": [_packed(r) for r in np.split(twice, np.cumsum(sizes)[:-1])]})

    def moments(pdf, low, high, ranked):
        d = _all_values(low, high, vectors, block)
        if ranked.empty:  # a block of one row has no pairs
            return _keyed(**{c: [] for c in ("group", "n", "ma", "mb", "ab", "aa", "bb")})
        found = []
        for k, c in (("a", x), ("b", y)):
            own = ranked[ranked["side"] == k].sort_values("range")
            r = np.concatenate([_unpacked(b, n) for b, n in zip(own["r"], own["size"], strict=True)]) / 2
            v, at = np.unique(d[c], return_inverse=True)
            if len(v) != len(r):
                raise ValueError("dissimilarities differ from those that were ranked")
            found.append(r[at])
        a, b = found
        ma, mb = a.mean(), b.mean()
        return pd.DataFrame({"group": pdf["group"].iloc[:1].tolist(), "n": len(a), "ma": ma, "mb": mb, "ab": (a - ma) @ (b - mb), "aa": (a - ma) @ (a - ma), "bb": (b - mb) @ (b - mb)})

    sent = _blocks_told((rows, tasks), [x, y], _to_blocks((rows, tasks), cuts), give, f"group {kind}, side string, range long, before long, __x int, __y int, size long, v binary, n binary")
    ranked = sent.groupBy("group", "side", "range").applyInPandas(rank, f"group {kind}, side string, range long, __x int, __y int, size long, r binary")
    return _blocks_told((rows, tasks), [x, y], ranked, moments, f"group {kind}, n long, ma double, mb double, ab double, aa double, bb double")


#: Pairs of a group whose ranks are worked out in one task.
WHOLE = 1 << 21
#: What sums in another order may differ by.
ROUNDED = 1e-11
#: Beyond: even cells for a first count of a side's pairs, bins for the second, and counts that travel in a row.
CELLS, FINE, PART = 1 << 12, 1 << 24, 1 << 18


class _Bins:
    """Rising bins of a group's dissimilarities: each of ``cells`` even cells has as many of some ``fine`` bins as it has of the pairs.

    Where they are cut decides how close the bounds come, not whether they hold.
    """

    def __init__(self, kind: str, length: float, cells: int, fine: int):
        """length: that of the longest vector."""
        self.low, high = {"dot": (-length * length, length * length), "euclidean": (0.0, 2 * length)}.get(kind, (0.0, 2.0))
        self.cells, self.fine, self.scale = cells, fine, cells / (high - self.low)

    def _at(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        u = (v - self.low) * self.scale
        np.clip(u, 0, np.nextafter(self.cells, 0), out=u)
        return u, u.astype(np.int32)

    def counted(self, values: Iterator[np.ndarray]) -> np.ndarray:
        """Pairs of each cell."""
        return sum((np.bincount(self._at(v)[1], minlength=self.cells) for v in values), np.zeros(self.cells, np.int64))

    def cut(self, counts: np.ndarray) -> _Bins:
        self.total = int(counts.sum())
        self.n = np.floor(np.maximum(1, counts * (self.fine / max(self.total, 1))))
        self.start = np.cumsum(self.n) - self.n
        return self

    def bins(self, v: np.ndarray) -> np.ndarray:
        u, cell = self._at(v)
        u -= cell
        u *= self.n.take(cell)
        u += self.start.take(cell)  # rounded, at most the first bin of the next cell
        return u.astype(np.int32)

    def filled(self, values: Iterator[np.ndarray]) -> np.ndarray:
        """Pairs of each bin."""
        found = np.zeros(int(self.n.sum()) + 1, np.int32)
        for v in values:
            np.add.at(found, self.bins(v), np.int32(1))
        return found


def _mean_ranks(parts: list[np.ndarray]) -> tuple[np.ndarray, list[float]]:
    """Mean rank of the pairs of each bin, less that of all pairs, from the bins' counts; and what bounds the rest of a rank.

    The bounds: the sum of the squared mean ranks over all pairs; the most that the rests' squares add up to, and the rests themselves;
    the squares without the fullest bins, and the rests of these alone.
    """
    total, size = sum(int(c.sum()) for c in parts), sum(map(len, parts))
    ranks, sums, before, at = np.empty(size), np.zeros(5), 0, 0
    for part in parts:
        c = part.astype(np.int64)
        upto, f = before + np.cumsum(c), c.astype(float)
        rank = ranks[at : at + len(c)] = upto - c + (c - 1) / 2 - (total - 1) / 2
        squares, rests, full = (f * f - 1) * f / 12, (c * c // 4).astype(float), c > 32 * total / size + 1
        sums += [f @ (rank * rank), squares.sum(), rests.sum(), squares[~full].sum(), rests[full].sum()]
        before, at = int(upto[-1]), at + len(c)
    return ranks, sums.tolist()


def _exact_ranks(v: np.ndarray) -> np.ndarray:
    """Ranks, ties averaged, less their mean."""
    _, at, n = np.unique(v, return_inverse=True, return_counts=True)
    return (np.cumsum(n) - n + (n - 1) / 2 - (len(v) - 1) / 2)[at]


def _slices(counts: np.ndarray, size: int) -> Iterator[tuple[int, int, bytes]]:
    """(number, length, bytes) of slices of counts, by as few bytes a count as the largest of a slice takes."""
    for k in range(0, len(counts), size):
        c = counts[k : k + size]
        yield k // size, len(c), c.astype(np.min_scalar_type(int(c.max())).newbyteorder("<")).tobytes()


def _unsliced(sizes, parts) -> list[np.ndarray]:
    return [np.frombuffer(b, f"<u{len(b) // n}") for n, b in zip(sizes, parts, strict=True)]


_BOUNDS = [f"{f}_{k}" for k in "ab" for f in ("squares", "rest_squares", "rests", "even_squares", "full_rests")]


def _bracketed(
    rows: DataFrame, x: str, y: str, dissimilarity: str, digits: int, block: int = BLOCK // 2, tiles: int = 2 * TILES, whole: int = WHOLE, cells: int = CELLS, fine: int = FINE, part: int = PART
) -> DataFrame:
    """(group, n, rsa, sure): rank correlation of both dissimilarities over all n pairs of a group; sure where its first ``digits`` digits are proven.

    All pairs are counted by fine bins of their dissimilarities, and the mean ranks of the bins are multiplied pair by pair, so counts of bins
    are all that leaves a block. A rank is the mean r of its bin and a rest e; the rests of a bin add up to nothing and are bounded by its count.
    So the sum of products is that of the mean ranks within sqrt(sum e_a^2 * sum r_b^2) + sqrt(sum r_a^2 * sum e_b^2) + sqrt(sum e_a^2 * sum e_b^2),
    or, of the first two, the sum of |e| times the largest rank. Groups of up to ``whole`` pairs have their ranks themselves.
    """
    kind = rows.schema["group"].dataType.simpleString()
    vectors, ends = {x: dissimilarity, y: dissimilarity}, {"a": x, "b": y}
    length = lambda c: F.max(F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, v: s + v * v)))
    longest = rows.groupBy("group").agg(length(x).alias("long_a"), length(y).alias("long_b"))
    at, tasks = _placed(rows, block, tiles, spread=1)
    at = at.join(sized(checkpointed(longest)), "group")
    columns = [x, y, "long_a", "long_b"]

    def made(pdf: pd.DataFrame) -> dict[str, _Bins] | None:
        """Bins of both sides; none where vectors have no finite length."""
        longs = {k: float(pdf[f"long_{k}"].iloc[0]) for k in "ab"}
        return {k: _Bins(dissimilarity, v, cells, fine) for k, v in longs.items()} if all(1e-100 < v < 1e100 for v in longs.values()) else None

    def side(low, high, k):
        return (d[ends[k]] for d in _values(low, high, {ends[k]: dissimilarity}, block))

    def products(low, high, bins, ranks) -> float:
        return sum(float(ranks["a"].take(bins["a"].bins(d[x])) @ ranks["b"].take(bins["b"].bins(d[y]))) for d in _values(low, high, vectors, block))

    def scored(pdf, n, ab, bounds):
        return _keyed(group=pdf["group"].iloc[:1].tolist(), n=n, ab=ab, **dict(zip(_BOUNDS, bounds, strict=True)))

    def alone(pdf: pd.DataFrame) -> pd.DataFrame:
        """A group of one block."""
        pdf = pdf.sort_values("i")
        n = len(pdf) * (len(pdf) - 1) // 2
        if n <= whole:
            d = _all_values(pdf, pdf, vectors, block)
            a, b = (_exact_ranks(d[c]) for c in (x, y))
            return scored(pdf, n, float(a @ b), [v for r in (a, b) for v in (float(r @ r), 0.0, 0.0, 0.0, 0.0)])
        bins, ranks, bounds = made(pdf), {}, []
        if not bins:
            return scored(pdf, n, 0.0, [float("nan")] * len(_BOUNDS))
        for k in "ab":
            bins[k].cut(bins[k].counted(side(pdf, pdf, k)))
            found = bins[k].filled(side(pdf, pdf, k))
            ranks[k], own = _mean_ranks([found[j : j + part] for j in range(0, len(found), part)])
            bounds += own
        return scored(pdf, n, products(pdf, pdf, bins, ranks), bounds)

    def sent(pdf, counts: dict[str, np.ndarray], size: int) -> pd.DataFrame:
        out = [(k, *s) for k, c in counts.items() for s in _slices(c, size)]
        key = {c: [pdf[c].iloc[0]] * len(out) for c in ("group", "__x", "__y")}
        return _keyed(**key, **{c: [row[j] for row in out] for j, c in enumerate(("side", "part", "size", "counts"))})

    def first(pdf, low, high):
        bins = made(pdf)
        return sent(pdf, {k: bins[k].counted(side(low, high, k)) for k in "ab"} if bins else {}, max(1, cells // 8))

    def counts_of(own: pd.DataFrame, k: str) -> list[np.ndarray]:
        own = own[own["side"] == k].sort_values("part")
        return _unsliced(own["size"], own["counts"])

    def cut(pdf, own) -> dict[str, _Bins] | None:
        bins = made(pdf)
        return bins and {k: bins[k].cut(np.concatenate(counts_of(own, k)).astype(np.int64)) for k in "ab"}

    def second(pdf, low, high, own):
        bins = cut(pdf, own)
        return sent(pdf, {k: bins[k].filled(side(low, high, k)) for k in "ab"} if bins else {}, part)

    def third(pdf, low, high, own):
        bins, ranks, bounds = cut(pdf, own[~own["fine"]]), {}, []
        if not bins:
            return scored(pdf, 0, 0.0, [float("nan")] * len(_BOUNDS))
        for k in "ab":
            ranks[k], found = _mean_ranks(counts_of(own[own["fine"]], k))
            bounds += found
        return scored(pdf, bins["a"].total, products(low, high, bins, ranks), bounds)

    counts_schema, score_schema = f"group {kind}, __x int, __y int, side string, part long, size long, counts binary", f"group {kind}, n long, ab double, " + ", ".join(f"{c} double" for c in _BOUNDS)
    spare = 8 * tasks if 1 < tasks < 1000 else tasks  # partitions that hold a key or none: few keys would meet in some
    one, more = at.filter("__top = 0"), (at.filter("__top > 0"), spare)
    one = one.repartition(spare, "group") if tasks > 1 else one
    of_cells = checkpointed(_summed(_blocks(more, columns, first, counts_schema)).withColumn("fine", F.lit(False)))
    of_bins = _summed(_blocks_told(more, columns, of_cells, second, counts_schema)).withColumn("fine", F.lit(True))
    parts = one.groupBy("group").applyInPandas(alone, score_schema).unionByName(_blocks_told(more, columns, of_cells.unionByName(of_bins), third, score_schema))
    s = parts.groupBy("group").agg(F.max("n").alias("n"), F.sum("ab").alias("ab"), *[F.max(c).alias(c) for c in _BOUNDS])  # the bounds are those of the group

    far = (F.col("n") - 1) / 2
    least = lambda k, other: F.least(
        F.sqrt(F.col(f"rest_squares_{k}") * F.col(f"squares_{other}")),
        F.col(f"rests_{k}") * far,
        F.sqrt(F.col(f"even_squares_{k}") * F.col(f"squares_{other}")) + F.col(f"full_rests_{k}") * far,
    )
    off = least("a", "b") + least("b", "a") + F.sqrt(F.col("rest_squares_a") * F.col("rest_squares_b"))
    whole_squares = lambda k: F.col(f"squares_{k}") + F.col(f"rest_squares_{k}")
    small, large = F.sqrt("squares_a") * F.sqrt("squares_b"), F.sqrt(whole_squares("a")) * F.sqrt(whole_squares("b"))
    s = s.withColumns({"rsa": F.col("ab") / F.greatest(large, F.lit(EPS)), "low": F.col("ab") - off, "high": F.col("ab") + off, "off": off})
    low = F.try_divide("low", F.when(F.col("low") < 0, small).otherwise(large)) - ROUNDED
    high = F.try_divide("high", F.when(F.col("high") > 0, small).otherwise(large)) + ROUNDED
    sure = (F.col("off") == 0) | ((high - low < 10.0**-digits) & (F.round(low, digits) == F.round(high, digits)))
    return s.select("group", "n", "rsa", F.coalesce(sure, F.lit(False)).alias("sure"))


def _summed(sent: DataFrame) -> DataFrame:
    """Counts of all pairs of blocks of a group, slice by slice, for each of those that sent some."""

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = sum((c.astype(np.int64) for c in _unsliced(pdf["size"], pdf["counts"])), np.int64(0))
        (_, _, packed), *_ = _slices(counts, len(counts))
        return pdf.assign(counts=[packed] * len(pdf))

    return sent.groupBy("group", "side", "part").applyInPandas(total, sent.schema)


def rsa(rows: DataFrame, x: str = "x", y: str = "y", dissimilarity: str = "correlation", similarity: str = "pearson", digits: int | None = None) -> DataFrame:
    """(group, rsa, loss): agreement of the two dissimilarity matrices' upper triangles, and 1 - rsa.

    With ``digits``, a rank correlation is right to that many digits: counts of bins prove those of most groups, and only the pairs of
    the other groups are put in order.
    """
    kind = rows.schema["group"].dataType.simpleString()
    if similarity == "spearman" and digits is not None:
        scored = checkpointed(_bracketed(rows, x, y, dissimilarity, digits))
        found = scored.filter((F.col("n") > 0) & F.col("sure")).select("group", "rsa", (1 - F.col("rsa")).alias("loss"))
        rest = rows.join(sized(scored.filter("sure").select("group")), "group", "left_anti").filter(F.col("group").isNotNull())
        return found if rest.isEmpty() else found.unionByName(rsa(rest, x, y, dissimilarity, similarity))
    if similarity == "spearman":
        part = _rank_moments(rows, x, y, dissimilarity)
    elif similarity == "pearson":  # only the moments of a pair of tiles leave its task

        def task(pdf, low, high):
            found = []
            for _, _, d in _met(low, high, {x: dissimilarity, y: dissimilarity}):
                a, b = d[x], d[y]
                if len(a):
                    ma, mb = a.mean(), b.mean()
                    found.append((pdf["group"].iloc[0], len(a), ma, mb, (a - ma) @ (b - mb), (a - ma) @ (a - ma), (b - mb) @ (b - mb)))
            return _keyed(**{c: [row[k] for row in found] for k, c in enumerate(("group", "n", "ma", "mb", "ab", "aa", "bb"))})

        part = _blocks(_placed(rows), [x, y], task, f"group {kind}, n long, ma double, mb double, ab double, aa double, bb double")
    else:
        raise ValueError(f"unknown similarity {similarity!r}")
    n = F.col("n")
    part = checkpointed(part)  # a row for each pair of tiles
    means = part.groupBy("group").agg(*[(F.sum(n * F.col(f"m{c}")) / F.sum(n)).alias(f"t{c}") for c in "ab"])
    c = part.join(sized(checkpointed(means)), "group").withColumns({"a": F.col("ma") - F.col("ta"), "b": F.col("mb") - F.col("tb")})
    s = c.groupBy("group").agg(*[F.sum(F.col(p + q) + n * F.col(p) * F.col(q)).alias(p + q) for p, q in ("ab", "aa", "bb")])
    r = F.col("ab") / F.greatest(F.sqrt("aa") * F.sqrt("bb"), F.lit(EPS))
    return s.select("group", r.alias("rsa"), (1 - r).alias("loss"))


def _products(rows: DataFrame, x: str, y: str, finish) -> DataFrame:
    """(group, cka): finish(products) of z'z summed over a group's rows, z = (1, |x|^2, |y|^2, x, y), with the width of x.

    Each task adds up the products of its rows in Arrow batches (a fixed state), so the rows are never paired.
    """
    kind = rows.schema["group"].dataType.simpleString()

    def partial(frames):
        for pdf in frames:
            for g, p in pdf.groupby("group", sort=False):
                a, b = np.stack(p[x]).astype(float), np.stack(p[y]).astype(float)
                z = np.hstack([np.ones((len(a), 1)), (a * a).sum(1)[:, None], (b * b).sum(1)[:, None], a, b])
                yield pd.DataFrame({"group": [g], "dx": [a.shape[1]], "state": [(z.T @ z).ravel()]})

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        s = np.asarray(pdf["state"].iloc[0], dtype=float)
        value = finish(s.reshape(int(np.sqrt(s.size)), -1), int(pdf["dx"].iloc[0]))
        return pd.DataFrame({"group": pdf["group"].iloc[:1].tolist() if value is not None else [], "cka": [value] if value is not None else []})

    states = rows.select("group", x, y).mapInPandas(partial, f"group {kind}, dx int, state array<double>")
    summed = states.select("group", "dx", F.posexplode("state").alias("p", "v")).groupBy("group", "dx", "p").agg(F.sum("v").alias("v"))
    packed = summed.groupBy("group", "dx").agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "v"))), lambda q: q["v"]).alias("state"))  # a fixed number
    return packed.groupBy("group").applyInPandas(whole, f"group {kind}, cka double")


def _linear(s: np.ndarray, dx: int) -> float:
    c = s[3:, 3:] - np.outer(s[0, 3:], s[0, 3:]) / s[0, 0]
    xx, xy, yy = c[:dx, :dx], c[:dx, dx:], c[dx:, dx:]
    denom = np.linalg.norm(xx) * np.linalg.norm(yy)
    return (xy**2).sum() / denom if denom > EPS else 0.0


def _unbiased(s: np.ndarray, dx: int) -> float | None:
    n = s[0, 0]
    if n < 4:
        return None
    at = {"a": slice(3, 3 + dx), "b": slice(3 + dx, None)}
    norm = {"a": 1, "b": 2}  # kernels have no diagonal: the squared lengths are taken off

    def hsic(p: str, q: str) -> float:
        u, v, c = s[0, at[p]], s[0, at[q]], s[at[p], at[q]]
        own = s[norm[p], norm[q]]
        whole = (c**2).sum() - own
        rows = u @ c @ v - s[norm[p], at[q]] @ v - s[norm[q], at[p]] @ u + own
        totals = (u @ u - s[0, norm[p]]) * (v @ v - s[0, norm[q]])
        return (whole + totals / ((n - 1) * (n - 2)) - 2 * rows / (n - 2)) / (n * (n - 3))

    product = hsic("a", "a") * hsic("b", "b")
    return hsic("a", "b") / (np.sqrt(product) + EPS) if product > 0 else 0.0


def cka_linear(rows: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """(group, cka): linear kernel alignment from cross products of centred columns."""
    return _products(rows, x, y, _linear)


def cka_unbiased(rows: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """(group, cka): unbiased linear kernel alignment; groups under four rows have none; 0 where the product of norms is not positive."""
    return _products(rows, x, y, _unbiased)


def cka_rbf(rows: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """(group, cka): alignment of centred Gaussian kernels; sigma is the median pairwise distance of x, for both sides."""
    kind = rows.schema["group"].dataType.simpleString()
    placed, tasks = _placed(rows)
    sigma = sized(checkpointed(_median((placed, tasks), x, "euclidean")))
    names = ("a", "b", "ab", "aa", "bb")

    def task(pdf, low, high):
        sums, width = [np.zeros((len(names), len(side))) for side in (low, high)], 2 * pdf["sigma"].iloc[0] ** 2
        for p, q, keep, d in _tiles(low, high, {x: "euclidean", y: "euclidean"}, diagonal=True):
            a, b = (np.exp(-(d[c] ** 2) / width) for c in (x, y))
            for k, v in enumerate((a, b, a * b, a * a, b * b)):
                v = v if keep is None else np.where(keep, v, 0.0)
                sums[0][k, p] += v.sum(1)
                sums[1][k, q] += v.sum(0) if keep is None else np.triu(v, 1).sum(0)  # a row with itself counts once
        out = pd.DataFrame(np.hstack(sums).T, columns=names)
        out["i"] = np.concatenate([low["i"], high["i"]])
        return out.assign(group=pdf["group"].iloc[0])[["group", "i", *names]]

    part = _blocks((placed.join(sigma, "group"), tasks), [x, y, "sigma"], task, f"group {kind}, i long, " + ", ".join(f"{c} double" for c in names))
    r = part.groupBy("group", "i").agg(*[F.sum(c).alias(c) for c in names])
    s = r.groupBy("group").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum("a").alias("ta"), F.sum("b").alias("tb"),
        *[F.sum(F.col(p) * F.col(q)).alias(f"r{p}{q}") for p, q in ("ab", "aa", "bb")], *[F.sum(p + q).alias(f"p{p}{q}") for p, q in ("ab", "aa", "bb")],
    )
    # sum of products of doubly centred kernels, from row sums and totals
    hsic = lambda p, q: F.col(f"p{p}{q}") - 2 * F.col(f"r{p}{q}") / F.col("n") + F.col(f"t{p}") * F.col(f"t{q}") / (F.col("n") * F.col("n"))
    denom = F.sqrt(hsic("a", "a") * hsic("b", "b"))
    return s.select("group", F.when(denom <= EPS, 0.0).otherwise(hsic("a", "b") / denom).alias("cka"))


def subject_representation(rows: DataFrame, metric, least: int = 2) -> DataFrame:
    """(subject, value): metric(rows) by (batch_id, subject), averaged with the groups' rows as weights; small groups are left out.

    rows: (batch_id, subject, x, y); metric takes (group, i, x, y) and gives (group, value).
    """
    by = W.partitionBy("batch_id", "subject").orderBy("order_id")
    keyed = rows.withColumns({"group": F.struct("batch_id", "subject"), "i": (F.row_number().over(by) - 1).cast("long")})
    keyed = keyed.withColumn("group", F.concat_ws("|", F.col("group.batch_id").cast("string"), F.col("group.subject").cast("string")))
    n = keyed.groupBy("group", "subject").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    scored = metric(keyed.join(n.select("group"), "group", "left_semi").select("group", "i", "x", "y")).hint("merge").join(n, "group")
    v = finite(F.col("value"))
    return scored.groupBy("subject").agg((F.sum(v * F.col("n")) / F.sum(F.when(v.isNotNull(), F.col("n")))).alias("value"))
