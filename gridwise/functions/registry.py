"""Registries: feature extractors, metrics and benchmarks by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwise.operators import losses, metrics

EXTRACTORS: dict[str, Callable[[Column, int], Column]] = {}


def extractor(name: str):
    """Registers a function of (word, dim) that gives the word's vector as a Column."""

    def put(f):
        EXTRACTORS[name] = f
        return f

    return put


def get_extractor(name: str) -> Callable[[Column, int], Column]:
    if name not in EXTRACTORS:
        raise KeyError(f"unknown extractor {name!r}; there are {sorted(EXTRACTORS)}")
    return EXTRACTORS[name]


@extractor("hashing")
def _hashing(word: Column, dim: int) -> Column:
    """One at the place that the first 32 bits of the word's MD5 tell, zero elsewhere."""
    place = F.conv(F.substring(F.md5(word.cast("binary")), 1, 8), 16, 10).cast("long") % dim
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (i == place).cast("double"))


def extract(words: DataFrame, name: str, dim: int = 8) -> DataFrame:
    """(item, word_idx, vec) of words by the named extractor; distinct words are not assumed."""
    return words.select("item", "word_idx", get_extractor(name)(F.col("word"), dim).alias("vec"))


#: Column expressions over metrics.sums by name.
METRICS = {"pearson": metrics.pearson_of_sums, "ev": metrics.explained_variance_of_sums, "pearson_strict": metrics.strict_pearson_of_sums}


def score_samples(rows: DataFrame, names: list[str], dissimilarity: str = "correlation") -> DataFrame:
    """All named scores of losses.SCORES by group, similarity and kernel alignment included, in one aggregation; rows are (group, i, x, y)."""
    return losses.evaluate(rows, names, dissimilarity)


def score(df: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """All named metrics by keys, in one aggregation."""
    if unknown := [n for n in names if n not in METRICS]:
        raise KeyError(f"unknown metrics {unknown}")
    return metrics.sums(df, keys).select(*keys, *[METRICS[n]().alias(n) for n in names])


#: Benchmarks by name, and their other names.
BENCHMARKS = {"id": {"task": "friends", "season": 7}, "ood": {"task": "ood", "season": None}}
ALIASES = {"id_dist": "id", "in_distribution": "id", "friends": "id", "friends_s7": "id", "ood_dist": "ood", "out_of_distribution": "ood"}


def benchmark(name: str) -> dict:
    key = ALIASES.get(name, name)
    if key not in BENCHMARKS:
        raise KeyError(f"unknown benchmark {name!r}")
    return BENCHMARKS[key]
