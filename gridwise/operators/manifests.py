"""Manifests of stimuli and runs: scans, canonical form, selection, splits, validation.

Strings are never NULL in a manifest ('' means absent); numbers may be.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridwise.functions.session import checkpointed, sized
from gridwise.operators.digests import table_digest

RUN_COLUMNS = (
    "dataset_name", "stimulus_namespace", "subject", "subject_idx", "task", "movie", "stimulus_id", "fmri_item_id", "chunk", "fmri_relpath", "fmri_h5_key",
    "video_relpath", "transcript_relpath", "audio_relpath", "n_parcels", "transcript_duration_s", "video_duration_s", "audio_duration_s", "fmri_duration_s",
)
STIMULUS_COLUMNS = (
    "dataset_name", "stimulus_namespace", "task", "movie", "stimulus_id", "chunk", "video_relpath", "transcript_relpath", "audio_relpath",
    "transcript_duration_s", "video_duration_s", "audio_duration_s",
)


def relativize(path: Column, root: str) -> Column:
    """An absolute path under root becomes relative; '' and relative paths stay; others are an error."""
    base = root.rstrip("/") + "/"
    bad = F.raise_error(F.concat(F.lit(f"path outside {root}: "), path)).cast("string")
    return F.when(~path.startswith("/"), path).when(path.startswith(base), F.substr(path, F.lit(len(base) + 1))).otherwise(bad)


def resolve(path: Column, root: str) -> Column:
    """A relative path under root becomes absolute; '' stays."""
    return F.when((path == "") | path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))


def ensure_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing columns are added: durations 0.0, subject_idx and n_parcels 0, others ''."""
    new = {c: F.lit(0.0) if c.endswith("_duration_s") else F.lit(0).cast("long") if c in ("subject_idx", "n_parcels") else F.lit("") for c in columns if c not in df.columns}
    return df.withColumns(new) if new else df


def canonical(df: DataFrame, columns: Sequence[str], dataset: str, root: str, unique: bool = True) -> DataFrame:
    """Fixed columns, in order; paths relative to root; first row of each stimulus if unique."""
    df = ensure_columns(df.withColumns({"dataset_name": F.lit(dataset), "stimulus_namespace": F.lit(dataset)}), columns)
    df = df.withColumns({c: relativize(F.col(c), root) for c in columns if c.endswith("_relpath")})
    return (distinct_stimuli(df) if unique else df).select(*columns)


def subject_index(df: DataFrame, subject: str = "subject") -> DataFrame:
    """df with subject_idx: 0-based place of the subject among the sorted distinct ones (ranked alone, then joined back)."""
    ranks = df.select(subject).distinct().withColumn("subject_idx", (F.row_number().over(W.orderBy(subject)) - 1).cast("long"))
    return df.join(sized(checkpointed(ranks)), subject)


def item_key(subject: Column, stimulus: Column) -> Column:
    return F.concat_ws("/", subject, stimulus)


def filter_subjects_stimuli(df: DataFrame, subjects: DataFrame | None = None, stimuli: DataFrame | None = None) -> DataFrame:
    if subjects is not None:
        df = df.join(subjects, "subject", "left_semi")
    return df if stimuli is None else df.join(stimuli, "stimulus_id", "left_semi")


def stimulus_index(df: DataFrame) -> DataFrame:
    """(stimulus_id, stimulus_idx): distinct ids, numbered from 0 in their order.

    Range partitions are numbered one by one, after a count of each: no partition holds all ids.
    """
    ids = checkpointed(df.select("stimulus_id").distinct().repartitionByRange("stimulus_id"))  # its partitions stay as they are
    ids = ids.withColumn("__p", F.spark_partition_id())
    counts = ids.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.withColumn("__before", F.sum("__n").over(W.orderBy("__p")) - F.col("__n"))  # one row a partition
    local = ids.withColumn("__k", F.row_number().over(W.partitionBy("__p").orderBy("stimulus_id")))
    return local.join(F.broadcast(before.select("__p", "__before")), "__p").select("stimulus_id", (F.col("__before") + F.col("__k") - 1).alias("stimulus_idx"))


def select_indices(index: DataFrame, wanted: Sequence[int]) -> DataFrame:
    """Rows of stimulus_index for the wanted numbers (repeats collapse, in the order given), and NULL ids for those out of range."""
    order = {w: i for i, w in reversed(list(enumerate(wanted)))}
    want = index.sparkSession.createDataFrame([(int(w), i) for w, i in order.items()], "stimulus_idx long, place int")
    return F.broadcast(want).join(index, "stimulus_idx", "left").select("place", "stimulus_idx", "stimulus_id")


def parse_selectors(selectors: Sequence[str]) -> list[tuple[str, str, str]]:
    """(selector, task, chunk prefix) of names such as s6, s6-18b, s06e18b, friends/s6, figures, figures03."""
    import re

    out = []
    for raw in selectors:
        s = raw.strip().lower().replace("_", "-").removeprefix("friends/")
        if m := re.fullmatch(r"s0*(\d+)", s):
            out.append((raw, "friends", f"s{int(m[1]):02d}"))
        elif m := re.fullmatch(r"s0*(\d+)[-e]0*(\d+)([a-z]?)", s):
            out.append((raw, "friends", f"s{int(m[1]):02d}e{int(m[2]):02d}{m[3]}"))
        elif m := re.fullmatch(r"(?:movie10/)?([a-z]+)0*(\d*)", s):
            out.append((raw, "movie10", m[1] + (f"{int(m[2]):02d}" if m[2] else "")))
        else:
            raise ValueError(f"can't read the selector {raw!r}")
    return out


def holdout(df: DataFrame, selectors: DataFrame, keys: Sequence[str] = ("task",), prefix: str = "chunk") -> DataFrame:
    """df with split: 'val' where a selector (task, prefix) starts the chunk, else 'train'. selectors is a short list."""
    hit = df.join(F.broadcast(selectors.select(*keys, F.col("prefix").alias("__prefix"))), [*keys])
    ids = hit.filter(F.col(prefix).startswith(F.col("__prefix"))).select("stimulus_id").distinct().withColumn("__val", F.lit(True))
    return df.join(ids, "stimulus_id", "left").withColumn("split", F.when(F.col("__val"), "val").otherwise("train")).drop("__val")


def unmatched_selectors(df: DataFrame, selectors: DataFrame) -> DataFrame:
    """Selectors that match no row; each must match one at least."""
    found = df.join(F.broadcast(selectors), "task").filter(F.col("chunk").startswith(F.col("prefix"))).select("selector").distinct()
    return selectors.join(found, "selector", "left_anti").select("selector")


def season_holdout(df: DataFrame, season: int = 6) -> DataFrame:
    if not 1 <= season <= 6:
        raise ValueError("season must be 1 to 6")
    match = (F.col("task") == "friends") & F.col("chunk").startswith(f"s{season:02d}")
    return df.withColumn("split", F.when(match, "val").otherwise("train"))


def native_score(key: Column, seed: int) -> Column:
    """A number in [0, 1) from SHA-256, in SQL functions: 52 bits of the digest of seed and key."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(str(seed)), key), 256), 1, 13), 16, 10).cast("double") / float(1 << 52)


def _generator_score(key: pd.Series, seed: pd.Series) -> pd.Series:
    import hashlib
    import random

    # fixed rule: Python's generator seeded with the digest plus the seed
    return pd.Series([random.Random(int(hashlib.sha256(k.encode()).hexdigest(), 16) + int(s)).random() for k, s in zip(key, seed, strict=True)])


def compat_score(key: Column, seed: int) -> Column:
    return F.pandas_udf(_generator_score, "double")(key, F.lit(seed))


def hash_split(df: DataFrame, ratio: float = 0.1, seed: int = 33, key: str = "chunk", order: str | None = None, compat: bool = False) -> DataFrame:
    """df with split, a function of the key alone: val where the score is at least 1 - ratio.

    If no key is val, the key whose first row comes last by ``order`` (default: the key itself) is. compat scores distinct keys with Python's generator.
    """
    if not 0 < ratio < 1:
        raise ValueError("ratio must lie between 0 and 1")
    order = order or key
    keys = df.groupBy(key).agg(F.min(order).alias("__first"))
    score = compat_score(F.col(key), seed) if compat else native_score(F.col(key), seed)
    keys = keys.withColumn("__val", score >= 1 - ratio)
    last = keys.agg(F.max(F.struct("__first", key))[key].alias("__last"), F.coalesce(F.bool_or("__val"), F.lit(False)).alias("__any"))
    splits = keys.crossJoin(F.broadcast(last))  # one row
    val = F.col("__val") | (~F.col("__any") & (F.col(key) == F.col("__last")))
    return df.join(splits.select(key, F.when(val, "val").otherwise("train").alias("split")), key)


def add_splits(df: DataFrame, strategy: str = "chunk", ratio: float = 0.1, seed: int = 33, season: int = 6, selectors: Sequence[str] = (), order: str | None = None, compat: bool = False) -> DataFrame:
    """split by strategy: chunk, friends_season_holdout or custom_holdout.

    chunk: order is the column by which a key comes last, should none be val; compat scores keys with Python's generator.
    """
    if strategy == "chunk":
        return hash_split(df, ratio, seed, order=order, compat=compat)
    if strategy == "friends_season_holdout":
        return season_holdout(df, season)
    if strategy == "custom_holdout":
        frame = df.sparkSession.createDataFrame(parse_selectors(selectors), "selector string, task string, prefix string")
        return holdout(df, frame)
    raise ValueError(f"unknown split strategy {strategy!r}")


def chunk_key(stimulus: Column) -> Column:
    return F.regexp_replace(stimulus, "^[^/]*/", "")


def slug(text: Column) -> Column:
    out = F.btrim(F.regexp_replace(text, "[^A-Za-z0-9._-]++", "_"), F.lit("_"))
    return F.coalesce(F.nullif(out, F.lit("")), F.when(text.isNotNull(), F.lit("stimulus")))  # nullif works out its argument once


def task_code(task: Column) -> Column:
    return F.when(task == "friends", 0).when(task == "movie10", 1).otherwise(-1)


MODALITIES = ("audio", "text", "vision")


def store_identity(modalities: Column) -> Column:
    """'ctx-a-b' of a list of modalities: distinct, in fixed (alphabetical) order."""
    return F.concat(F.lit("ctx-"), F.array_join(F.array_sort(F.array_distinct(modalities)), "-"))


def distinct_stimuli(df: DataFrame, order: Sequence[str] = (), keys: Sequence[str] = ("stimulus_namespace", "stimulus_id")) -> DataFrame:
    """First row of each key by ``order`` (then by all columns)."""
    by = W.partitionBy(*keys).orderBy(*order, *[c for c in df.columns if c not in keys])
    return df.withColumn("__n", F.row_number().over(by)).filter("__n = 1").drop("__n")


def split_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("stimulus_id").alias("n_stimuli"))


def summary(df: DataFrame) -> DataFrame:
    """One row: runs, runs without a recording key, subjects and tasks."""
    return df.agg(F.count(F.lit(1)).alias("n_runs"), F.count_if(F.col("fmri_h5_key") == "").alias("n_missing"), F.count_distinct("subject").alias("n_subjects"), F.array_join(F.array_sort(F.collect_set("task")), ",").alias("tasks"))


def missing_labels(df: DataFrame, key: str = "fmri_h5_key", shown: int = 5) -> DataFrame:
    """One row: rows without a key, and the first few of their ids in order (a bounded report)."""
    bad = df.filter(F.col(key) == "").select("stimulus_id")
    first = bad.orderBy("stimulus_id").limit(shown).agg(F.array_join(F.array_sort(F.collect_list("stimulus_id")), ",").alias("examples"))
    return bad.agg(F.count(F.lit(1)).alias("n_missing")).crossJoin(F.broadcast(first))  # one row each


def require_labels(df: DataFrame, key: str = "fmri_h5_key") -> DataFrame:
    """df; reading a row without a key is an error."""
    bad = F.raise_error(F.concat(F.lit("no label for "), F.col("stimulus_id"))).cast("string")
    return df.withColumn(key, F.when(F.col(key) == "", bad).otherwise(F.col(key)))


def table_hash(df: DataFrame) -> DataFrame:
    """One row (n, hash): digest of a table's columns and rows, whatever their order (digests.py)."""
    return table_digest(df)


def validate(df: DataFrame, keys: Sequence[str], numbers: Sequence[str]) -> DataFrame:
    """One row: rows, bad numbers (NULL, NaN or infinite) and keys that occur twice."""
    bad = [F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf")) for c in numbers]
    counts = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(b).alias(f"bad_{c}") for b, c in zip(bad, numbers, strict=True)])
    twice = df.groupBy(*keys).count().filter("count > 1").agg(F.count(F.lit(1)).alias("n_repeated_keys"))
    return counts.crossJoin(F.broadcast(twice))  # one row each


def stop_time(*durations: Column) -> Column:
    return F.greatest(*durations)


def union_manifests(*manifests: DataFrame) -> DataFrame:
    out = manifests[0]
    for m in manifests[1:]:
        out = out.unionByName(m, allowMissingColumns=True)
    return out


def extraction_manifest(*manifests: DataFrame) -> DataFrame:
    """First row of each stimulus, manifests before later ones."""
    ranked = [m.withColumn("__rank", F.lit(i)) for i, m in enumerate(manifests)]
    return distinct_stimuli(union_manifests(*ranked), ["__rank"]).drop("__rank")


def key_difference(expected: DataFrame, got: DataFrame) -> DataFrame:
    """Distinct keys with side 'missing' (expected only) or 'extra' (got only)."""
    a, b = expected.subtract(got), got.subtract(expected)
    return a.withColumn("side", F.lit("missing")).union(b.withColumn("side", F.lit("extra")))


def unknown_subjects(asked: DataFrame, known: DataFrame, subject: str = "subject") -> DataFrame:
    """Distinct subjects that are asked for and not known."""
    return asked.select(subject).subtract(known.select(subject))


def apply_split_map(df: DataFrame, splits: DataFrame, key: str = "chunk") -> DataFrame:
    return df.join(splits, key)


def match_unique_key(df: DataFrame, keys: DataFrame, token: str, key: str = "key", contains: bool = False) -> DataFrame:
    """df with key: the one key that holds the row's token, '' if none or several do.

    A token is held between a key's separators, or with ``contains`` anywhere in it (empty tokens are held by none).
    """
    if contains:
        found = _contained(df.select(F.col(token).alias("__t")).filter("__t <> ''").distinct(), keys.select(F.col(key).alias("__key")).distinct())
        parts = found.select(F.col("__t").alias(token), F.col("__key").alias(key))
    else:
        parts = keys.select(key, F.explode(F.array_distinct(F.split(key, "[-_/]"))).alias(token))
    one = parts.groupBy(token).agg(F.min(key).alias("__k"), F.count_distinct(key).alias("__n")).filter("__n = 1")
    return df.hint("merge").join(one.select(token, "__k"), token, "left").withColumn(key, F.coalesce("__k", F.lit(""))).drop("__k")


#: Characters of tokens that one automaton holds.
AUTOMATON_CHARS = 20_000_000


def _contained(tokens: DataFrame, keys: DataFrame) -> DataFrame:
    """(__t, __key): tokens and the keys that they are part of, each pair once.

    An automaton of the tokens runs over every key once. Tokens of more than AUTOMATON_CHARS characters are cut into shards by
    their hash, each of which is built, sent and run by itself.
    """
    tokens, spark = checkpointed(tokens), tokens.sparkSession
    size = tokens.agg(F.sum(F.length("__t"))).first()[0] or 0
    shards = -(-size // AUTOMATON_CHARS)
    found = []
    for shard in range(shards):
        held = spark.sparkContext.broadcast([r[0] for r in tokens.filter(F.pmod(F.xxhash64("__t"), F.lit(shards)) == shard).collect()])

        def run(frames, held=held):
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for t in held.value:
                automaton.add_word(t, t)
            automaton.make_automaton()
            for frame in frames:
                hits = [(t, k) for k in frame["__key"] if k for t in {t for _, t in automaton.iter(k)}]
                yield pd.DataFrame({"__t": pd.Series([t for t, _ in hits], dtype=object), "__key": pd.Series([k for _, k in hits], dtype=object)})

        found.append(keys.mapInPandas(run, "__t string, __key string"))
    if not found:
        return spark.createDataFrame([], "__t string, __key string")
    return reduce(DataFrame.union, found)


def missing_features(df: DataFrame, features: DataFrame) -> DataFrame:
    return df.select("stimulus_id").distinct().join(features, "stimulus_id", "left_anti")


def stimulus_x_subject(df: DataFrame, subjects: DataFrame) -> DataFrame:
    """Every row for every subject of a short list."""
    return df.crossJoin(F.broadcast(subjects.select("subject").distinct()))


def check_key_sets(expected: DataFrame, got: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., side): keys on one side only."""
    e, g = expected.select(*keys).distinct().withColumn("e", F.lit(1)), got.select(*keys).distinct().withColumn("g", F.lit(1))
    return e.join(g, list(keys), "full").filter("e is null or g is null").select(*keys, F.when(F.col("e").isNull(), "extra").otherwise("missing").alias("side"))


def linspace_rows(df: DataFrame, k: int, index: str) -> DataFrame:
    """Rows at int(linspace(0, n-1, min(k, n))) of an index column that counts from 0."""
    n = df.agg((F.max(index) + 1).alias("n"))
    picks = n.withColumn("m", F.least("n", F.lit(k))).select(
        F.explode(F.transform(F.sequence(F.lit(0), (F.col("m") - 1).cast("int")), lambda i: F.when(F.col("m") == 1, F.lit(0).cast("long")).otherwise(F.floor(i * (F.col("n") - 1) / (F.col("m") - 1))))).alias(index)
    )
    return df.join(F.broadcast(picks.distinct()), index, "left_semi")  # k rows at most
