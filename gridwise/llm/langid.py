"""Language identification by rank-order profiles of character n-grams.

A profile is the list of a language's most frequent n-grams, most frequent
first. A document has such a list, too; its out-of-place distance to a profile
sums, over its n-grams, how far a rank is from the profile's rank, or ``size``
where the profile lacks the n-gram. The nearest profile is the language.

N-grams are 1 to 3 code points of the lower-cased text (NFC) without those that
cross a word's border: words are runs of letters and marks, with one blank on
either side. Equal counts are ranked in the order of code points.

Profiles are counted over all rows that are given to ``profiles``, as sums by
partition first; what a text needs in memory is its distinct n-grams and a
million code points at a time. The profiles alone go to every task: ``size``
n-grams for each language, and more than ``MAX_LANGUAGES`` are an error.

Defined results: null text, and text without a letter, is ``und`` with a score
of 0; so is every text while no language was learned; rows with a null language
or a null text teach nothing; a tie goes to the language that sorts first;
languages of equal profiles are one tie; repeated rows count as often as they
stand there when learning and give repeated predictions; only the named columns
are read, so extra columns may have any name.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNKNOWN = "und"
SIZE = 300  # n-grams in a profile
#: 20,000 profiles of 300 n-grams are 96 MB in a task; ISO 639-3 has some 8,000 languages.
MAX_LANGUAGES = 20_000
_PIECE = 1_000_000  # code points that are worked on at once
_HELD = 1_000_000  # distinct n-grams that a task holds before it hands counts on
_BLANK = 32


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """By code point: 1 letter, 2 mark, 0 neither."""
    kinds = np.zeros(sys.maxunicode + 1, dtype=np.uint8)
    for i in range(sys.maxunicode + 1):
        c = unicodedata.category(chr(i))[0]
        if c in "LM":
            kinds[i] = 1 if c == "L" else 2
    return kinds


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams as numbers, ascending; their counts) of a text; empty where it has no letter."""
    if not text:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    if not text.isascii() and not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    text = text.lower()
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    found, seen = None, False
    for at in range(0, len(points), _PIECE):
        piece = points[max(0, at - 2) : at + _PIECE]
        kinds = _kinds()[piece]
        seen = seen or bool((kinds == 1).any())
        own = np.where(kinds > 0, piece, np.uint32(_BLANK)).astype(np.int64)
        back = min(at, 2)  # code points of the piece before, for the n-grams over the cut
        if not back:
            own, back = np.concatenate([[_BLANK], own]), 1
        if at + _PIECE >= len(points):
            own = np.concatenate([own, [_BLANK]])
        grams = np.sort(_codes(own, back))
        first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.empty(0, np.int64)
        one = grams[first], np.diff(np.append(first, len(grams)))
        found = one if found is None else merged([found, one])
    return found if seen else (np.empty(0, np.int64), np.empty(0, np.int64))


def _codes(own: np.ndarray, back: int) -> np.ndarray:
    """The n-grams that end at own[back:] or later, each as its code points of 21 bits."""
    letter = own != _BLANK
    end = np.arange(len(own)) >= back
    two = (own[:-1] << 21) | own[1:]
    three = (two[:-1] << 21) | own[2:]
    return np.concatenate([
        own[letter & end],
        two[(letter[:-1] | letter[1:]) & end[1:]],
        three[letter[1:-1] & end[2:]],
    ])


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of several lists as one."""
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([c for _, c in parts]), len(keys)).astype(np.int64)


def most_frequent(keys: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams, most frequent first; equal counts in the order of the n-grams."""
    if len(keys) > size:  # those that can be among them, before they are sorted
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        keys, counts = keys[counts >= least], counts[counts >= least]
    return keys[np.argsort(-counts, kind="stable")][:size]


def profiles(docs: DataFrame, size: int = SIZE, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, gram, rank from 0) of the languages of docs, counted over all of its rows and whole texts."""

    def count(batches):
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            new: dict[str, list] = {}
            size = 0
            for text, lang in zip(batch.column(0), batch.column(1), strict=True):
                one = ngrams(text.as_py())
                new.setdefault(lang.as_py(), []).append(one)
                size += len(one[0])
                if size > _HELD:
                    new, size = {k: [merged(parts)] for k, parts in new.items()}, 0
            for lang, parts in new.items():
                held[lang] = merged([held[lang], *parts] if lang in held else parts)
            if sum(len(k) for k, _ in held.values()) > _HELD:
                yield from _count_batches(held)
                held = {}
        yield from _count_batches(held)

    known = docs.select(F.col(text_col), F.col(lang_col).cast("string").alias("lang")).filter(F.col(text_col).isNotNull() & F.col("lang").isNotNull())
    sums = known.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    by = W.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return sums.withColumn("rank", F.row_number().over(by) - 1).filter(F.col("rank") < size).select("lang", "gram", "rank")


def _count_batches(held):
    for lang, (keys, counts) in held.items():
        for i in range(0, len(keys), 100_000):
            k = keys[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k), pa.array(counts[i : i + 100_000])], ["lang", "gram", "n"])


class Nearest:
    """The languages' profiles, sorted by n-gram: one look-up of a text's n-grams serves all languages."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int):
        self.size, self.langs = size, sorted({r[0] for r in rows})
        place = {lang: i for i, lang in enumerate(self.langs)}
        self.grams, at = np.unique(np.array([r[1] for r in rows], dtype=np.int64), return_inverse=True)
        order = np.argsort(at, kind="stable")
        self.first = np.searchsorted(at[order], np.arange(len(self.grams) + 1))
        self.lang = np.array([place[r[0]] for r in rows], dtype=np.int64)[order]
        self.rank = np.array([r[2] for r in rows], dtype=np.int64)[order]

    def distances(self, top: np.ndarray) -> np.ndarray:
        """Out-of-place distance of a ranked list of n-grams to each language."""
        at = np.searchsorted(self.grams, top)
        rank = np.flatnonzero((at < len(self.grams)) & (self.grams[np.minimum(at, len(self.grams) - 1)] == top))
        at = at[rank]
        n = self.first[at + 1] - self.first[at]
        entry = np.repeat(self.first[at] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        saved = self.size - np.abs(self.rank[entry] - np.repeat(rank, n))
        return len(top) * self.size - np.bincount(self.lang[entry], saved, len(self.langs)).astype(np.int64)

    def predict(self, text: str | None) -> tuple[str, float]:
        keys, counts = ngrams(text)
        if not len(keys) or not self.langs:
            return UNKNOWN, 0.0
        top = most_frequent(keys, counts, self.size)
        far = self.distances(top)
        best = int(far.argmin())
        return self.langs[best], 1.0 - float(far[best]) / (len(top) * self.size)


def predict(docs: DataFrame, learned: DataFrame, size: int = SIZE, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score (1 for a list equal to the profile, 0 for one that shares nothing with it).

    learned holds ``size`` rows a language at most; columns of docs with these two names are replaced.
    """
    n_langs = learned.agg(F.count_distinct("lang")).first()[0]
    if n_langs > MAX_LANGUAGES:
        raise ValueError(f"{n_langs} languages: more than {MAX_LANGUAGES} profiles are not sent to every task")
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast([tuple(r) for r in learned.select("lang", "gram", "rank").collect()])
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])
    at = kept.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        nearest = Nearest(sent.value, size)
        for batch in batches:
            got = [nearest.predict(t.as_py()) for t in batch.column(at)]
            new = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)
