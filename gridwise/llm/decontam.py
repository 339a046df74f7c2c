"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Numbers, names (capitalised words, wherever they stand) and units after numbers
become typed placeholders, on both sides; the rest is lower-cased words. An item
is looked up twice, with its names as placeholders and as words, so that texts
in capitals or in lower case match too. Windows of ``WINDOW`` template tokens
(whole items, if shorter) are joined by hash, and matches of one document, item
and alignment (difference of places) are held together: their slots must
correspond one to one, and they must hold ``MIN_WORDS`` words or equal slot
values, so that a re-parameterised question matches and unrelated text of the
same shape does not. A document leaks an item if its consistent matches cover
half of the item's windows, or ``MIN_RUN`` of them.

A text is canonicalised once. Seeds (some tokens of a window, looked up at every
few places, which no window can miss) tell the places whose windows are hashed,
and such a place carries its own few tokens along, so texts are neither read
again nor shuffled.

Defined results: null texts match nothing; items under ``SHORTEST`` tokens are
too short to tell and match nothing; empty tables give no rows; repeated rows of
documents count as one document with its id, repeated benchmark rows as one, and
an item id with several texts is several items; extra columns are ignored; any
place in a very long text counts, and runs of names or numbers may have any length.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwise.llm._common import checkpointed, let, sized

WINDOW, SHORTEST, STRIDE = 8, 5, 4
MIN_COVER, MIN_RUN, MIN_WORDS = 0.5, 6, 4
UNITS = "km|cm|mm|kg|mg|ml|lb|lbs|oz|ft|mph|kmh|km/h|kW|MW|GB|MB|Hz|m|g|l|s|h|min|meters|metres|miles|inches|feet|pounds|grams|liters|litres|hours|minutes|seconds|days|weeks|months|years|dollars|euros|percent|degrees"
#: Possessive repeats: the others of a group take stack for every turn, so a long run of names or numbers would overflow it.
NAME = r"(^|[^\p{L}\p{N}])(\p{Lu}\p{Ll}[\p{L}'’-]*+(?: \p{Lu}\p{Ll}[\p{L}'’-]*+)*+)"
NUMBER = r"([0-9]++(?:[.,:/-][0-9]++)*+)"
UNIT = rf"(\x02z[^\x03]*+\x03 ?)((?i:{UNITS}))([^\p{{L}}]|$)"
TOKEN = r"\x02[a-z][^\x03]*+\x03|[\p{L}\p{N}]++"
_SLOT = "\x02"


def marked(text: Column, names: bool = True) -> Column:
    """text with its slots wrapped as \\x02 type value \\x03."""
    text = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\x02"), F.lit("")), F.lit("\x03"), F.lit(""))
    if names:
        text = F.regexp_replace(text, NAME, "$1\x02n$2\x03")
    text = F.regexp_replace(text, NUMBER, "\x02z$1\x03")
    return F.when(F.contains(text, F.lit("\x02z")), F.regexp_replace(text, UNIT, "$1\x02u$2\x03$3")).otherwise(text)


def tokens(text: Column, names: bool = True) -> Column:
    """Tokens of a text: words as they are, and slots with their marks."""
    return F.regexp_extract_all(marked(text, names), F.lit(TOKEN), F.lit(0))


def _is_slot(token: Column) -> Column:
    return F.startswith(token, F.lit(_SLOT))


def _hash(token: Column) -> Column:
    """Hash of a token's template: a slot's type, a word in lower case."""
    return F.xxhash64(F.when(_is_slot(token), F.substring(token, 1, 2)).otherwise(F.lower(token)))


def _values(window: Column) -> Column:
    return F.filter(window, _is_slot)


def _stride(n: int) -> int:
    """Seeds of n-token windows stand this far apart; each has n - _stride(n) + 1 tokens, four or more."""
    return min(STRIDE, n - SHORTEST + 2)


def _seed_of(hashes: Column, at: Column, n: int) -> Column:
    return F.xxhash64(F.lit(n), *[F.get(hashes, at + k) for k in range(n - _stride(n) + 1)])


def _places(hashes: Column, sizes: list[int]) -> Column:
    """Array of (n, i, seed) at every _stride(n)-th place i, for each window size n."""

    def of(n: int) -> Column:
        last = F.greatest(F.size(hashes) - (n - _stride(n) + 1), F.lit(0))
        made = F.transform(
            F.sequence(F.lit(0), last, F.lit(_stride(n))), lambda i: F.struct(F.lit(n).alias("n"), i.alias("i"), _seed_of(hashes, i, n).alias("seed"))
        )
        return F.when(F.size(hashes) >= n, made).otherwise(F.array().cast("array<struct<n:int,i:int,seed:bigint>>"))

    parts = [of(n) for n in sizes]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def _window_hash(window: Column, n: Column, sizes: list[int]) -> Column:
    one = lambda k: F.xxhash64(F.lit(k), *[_hash(F.get(window, i)) for i in range(k)])
    return reduce(lambda acc, k: F.when(n == k, one(k)).otherwise(acc), sizes[:-1], one(sizes[-1]))


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, tid, names, t, n): the tokens of each item that is long enough, with names as slots and as words."""
    one = benchmark.select(F.col(id_col).alias("item"), F.xxhash64(text_col).alias("tid"), F.col(text_col).alias("text")).dropDuplicates(["item", "tid"])
    forms = [one.select("item", "tid", F.lit(names).alias("names"), tokens(F.col("text"), names).alias("t")) for names in (True, False)]
    return forms[0].union(forms[1]).filter(F.size("t") >= SHORTEST).withColumn("n", F.least(F.size("t"), F.lit(WINDOW)))


def _index(items: DataFrame, sizes: list[int]) -> DataFrame:
    """(hash, item, tid, names, at, n_windows, b, words): every window of every item, its slot values and the places of its words."""
    at = F.explode(F.sequence(F.lit(0), F.size("t") - F.col("n"))).alias("at")
    w = items.select("item", "tid", "names", "n", (F.size("t") - F.col("n") + 1).cast("long").alias("n_windows"), at, "t")
    w = w.withColumn("w", F.slice("t", F.col("at") + 1, F.col("n")))
    words = F.filter(F.transform("w", lambda x, i: F.when(~_is_slot(x), i + F.col("at"))), lambda i: i.isNotNull())
    return w.select(_window_hash(F.col("w"), F.col("n"), sizes).alias("hash"), "item", "tid", "names", "at", "n_windows", _values(F.col("w")).alias("b"), words.alias("words"))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc, rk, item, n_windows, n_matched): leaked items of each document; rk is the hash of its text."""
    items = checkpointed(_items(benchmark, item_id, item_text))
    sizes = sorted(r[0] for r in items.select("n").distinct().collect()) or [WINDOW]  # at most WINDOW numbers
    index = sized(checkpointed(_index(items, sizes)))
    own = let(F.transform("t", _hash), lambda h: _places(h, sizes))
    seeds = checkpointed(items.select(F.explode(let(F.transform("t", _hash), lambda h: _every_place(h, F.col("n"), sizes))).alias("seed")).distinct())

    texts = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("rk"), tokens(F.col(text_col)).alias("t"))
    stride = reduce(lambda acc, k: F.when(F.col("p.n") == k, F.lit(_stride(k))).otherwise(acc), sizes[:-1], F.lit(_stride(sizes[-1])))
    seeded = texts.select("doc", "rk", "t", F.explode(own).alias("p")).withColumn("low", F.greatest(F.col("p.i") - stride + 1, F.lit(0)))
    piece = F.slice("t", F.col("low") + 1, F.col("p.i") - F.col("low") + F.col("p.n"))  # of every window that holds the seed
    seeded = seeded.select("doc", "rk", "p.n", "low", (F.col("p.i") - F.col("low")).alias("more"), piece.alias("piece"), "p.seed")
    met = seeded.join(sized(seeds), "seed", "left_semi")
    windows = met.select("doc", "rk", "n", "low", "piece", F.explode(F.sequence(F.lit(0), "more")).alias("k"))
    windows = windows.select("doc", "rk", "n", (F.col("low") + F.col("k")).alias("d_at"), F.slice("piece", F.col("k") + 1, F.col("n")).alias("w")).filter(F.size("w") == F.col("n"))
    hashed = windows.select("doc", "rk", "d_at", _values(F.col("w")).alias("d"), _window_hash(F.col("w"), F.col("n"), sizes).alias("hash"))
    pairs = hashed.join(index, "hash")

    group = ["doc", "rk", "item", "tid", "names", "n_windows"]
    held = pairs.groupBy(*group, (F.col("d_at") - F.col("at")).alias("shift")).agg(
        F.collect_set("at").alias("ats"),  # of one alignment: no more than the item has windows, as the other two
        F.array_distinct(F.flatten(F.collect_set(F.arrays_zip("b", "d")))).alias("slots"),
        F.size(F.array_distinct(F.flatten(F.collect_set("words")))).alias("n_words"),
    )
    values = lambda part: F.size(F.array_distinct(F.transform("slots", lambda x: x[part])))
    one_to_one = (F.size("slots") == values("b")) & (F.size("slots") == values("d"))
    held = held.filter(one_to_one & ((F.col("n_words") >= MIN_WORDS) | F.forall("slots", lambda x: x["b"] == x["d"])))
    found = held.groupBy(*group).agg(F.size(F.array_distinct(F.flatten(F.collect_set("ats")))).cast("long").alias("n_matched"))
    found = found.filter((F.col("n_matched") >= MIN_COVER * F.col("n_windows")) | (F.col("n_matched") >= MIN_RUN))
    best = found.groupBy("doc", "rk", "item", "tid").agg(F.max(F.struct("n_matched", "n_windows")).alias("m"))  # of names as slots and as words
    return best.select("doc", "rk", "item", "m.n_windows", "m.n_matched")


def _every_place(hashes: Column, n: Column, sizes: list[int]) -> Column:
    """Seeds at all places of an item of window size n."""

    def of(k: int) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.size(hashes) - (k - _stride(k) + 1), F.lit(0)))
        return F.transform(at, lambda i: _seed_of(hashes, i, k))

    return reduce(lambda acc, k: F.when(n == k, of(k)).otherwise(acc), sizes[:-1], of(sizes[-1]))


def remove_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that leak no item, all columns as they are."""
    found = leaks(docs, benchmark, id_col, text_col).select(F.col("doc").alias("__leak_doc"), F.col("rk").alias("__leak_rk")).distinct()
    same = F.expr(f"xxhash64(`{text_col}`) = __leak_rk and `{id_col}` <=> __leak_doc")
    return docs.join(sized(checkpointed(found)), same, "left_anti")
