"""Readers and writers of manifests, transcripts and submissions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwise.operators import manifests as M

NUMBERS = {"subject_idx": "long", "n_parcels": "long"}
#: Chunks that have no stimulus although their numbers run through them.
ABSENT_CHUNKS = ()


def scan_run_manifest(listing: DataFrame, subjects: DataFrame, keys: DataFrame, absent: Sequence[str] = ABSENT_CHUNKS) -> DataFrame:
    """One row for each subject and transcript in a listing (path): friends/s<season>/..._s<s>e<e><part>.tsv.

    chunk and task come from the path; fmri_h5_key is the one key (subject, key) that holds the chunk as a token, or ''.
    """
    parts = F.regexp_extract(F.col("path"), r"/(s\d+e\d+[a-z]?)\.tsv$", 1)
    runs = listing.select("path", parts.alias("chunk"), F.regexp_extract("path", r"/(friends|movie10)/", 1).alias("task"))
    runs = runs.filter((F.col("chunk") != "") & (F.col("task") != ""))
    if absent:
        runs = runs.filter(~F.col("chunk").isin(*absent))
    runs = runs.crossJoin(F.broadcast(subjects.select("subject").distinct()))  # a short list
    tokens = keys.select("subject", "key", F.explode(F.array_distinct(F.split("key", "[-_/]"))).alias("chunk"))
    one = tokens.groupBy("subject", "chunk").agg(F.min("key").alias("fmri_h5_key"), F.count_distinct("key").alias("n")).filter("n = 1").drop("n")
    out = runs.hint("merge").join(one, ["subject", "chunk"], "left").withColumn("fmri_h5_key", F.coalesce("fmri_h5_key", F.lit("")))
    return out.select("subject", "task", "chunk", F.concat_ws("/", "task", "chunk").alias("stimulus_id"), F.col("path").alias("transcript_relpath"), "fmri_h5_key")


def scan_heldout(listing: DataFrame, season: int = 7) -> DataFrame:
    """Transcripts of a season without labels: no subject, split test."""
    chunk = F.regexp_extract("path", r"/(s\d+e\d+[a-z]?)\.tsv$", 1)
    rows = listing.select("path", chunk.alias("chunk")).filter(F.col("chunk").startswith(f"s{season:02d}"))
    return rows.select(F.lit("").alias("subject"), F.lit(-1).cast("long").alias("subject_idx"), "chunk", F.col("path").alias("transcript_relpath"), F.lit("test").alias("split"))


def scan_ood(listing: DataFrame, preference: Sequence[str] = ("mkv", "mp4")) -> DataFrame:
    """(stimulus_id, video_relpath, transcript_relpath): stimuli with a video, by preferred suffix; '' without a transcript."""
    rows = listing.select("path", F.regexp_extract("path", r"([^/]+)\.[a-z0-9]+$", 1).alias("stimulus_id"), F.regexp_extract("path", r"\.([a-z0-9]+)$", 1).alias("ext"))
    rank = F.array_position(F.array(*[F.lit(x) for x in preference]), F.col("ext"))
    video = rows.filter(F.col("ext").isin(*preference)).groupBy("stimulus_id").agg(F.min_by("path", F.struct(rank, "path")).alias("video_relpath"))
    text = rows.filter("ext = 'tsv'").groupBy("stimulus_id").agg(F.min("path").alias("transcript_relpath"))
    return video.join(text, "stimulus_id", "left").withColumn("transcript_relpath", F.coalesce("transcript_relpath", F.lit("")))


def read_manifest_tsv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Strings stay '' where empty; durations and counts that can't be read are NULL."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    raw = spark.read.csv(path, sep="\t", header=True, schema=schema)

    def typed(c: str):
        kind = "double" if c.endswith("_duration_s") else NUMBERS.get(c)
        return F.col(c).try_cast(kind) if kind else F.coalesce(c, F.lit(""))

    return raw.select(*[typed(c).alias(c) for c in columns])


def write_tsv(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    df.select(*(columns or df.columns)).write.mode("overwrite").csv(path, sep="\t", header=True)


def read_user_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a user's list of videos, tabs by the names .tsv and .tab, else commas: the two needed columns first, then what else it has.

    A list without them fails when it is read, with the name that Spark can't find.
    """
    rows = spark.read.csv(path, header=True, sep="\t" if path.rsplit(".", 1)[-1].lower() in ("tsv", "tab") else ",")
    return rows.select("stimulus_id", "video_path", *[c for c in rows.columns if c not in ("stimulus_id", "video_path")])


def parse_transcript_per_tr(rows: DataFrame) -> DataFrame:
    """(item, tr, pos, word, onset_s, duration_s) from list literals per TR; blank words and unreadable rows give no words."""
    lists = rows.select(
        "item", "tr", F.from_json("words_per_tr", "array<string>").alias("w"), F.from_json("onsets_per_tr", "array<double>").alias("o"), F.from_json("durations_per_tr", "array<double>").alias("d")
    )
    words = lists.select("item", "tr", F.posexplode(F.arrays_zip("w", "o", "d")).alias("pos", "x"))
    return words.select("item", "tr", "pos", F.col("x.w").alias("word"), F.col("x.o").alias("onset_s"), F.col("x.d").alias("duration_s")).filter("trim(word) <> '' and onset_s is not null")


def read_transcript_flat(rows: DataFrame) -> DataFrame:
    duration = F.col("duration") if "duration" in rows.columns else F.lit(None).cast("double")
    return rows.select("item", "word", F.col("onset").cast("double").alias("onset_s"), F.coalesce(duration.cast("double"), F.lit(0.0)).alias("duration_s"))


def read_transcript_json(spark: SparkSession, path: str) -> DataFrame:
    """One list of {item, word, onset, duration?} a file; rows without a word are dropped."""
    rows = spark.read.schema("item string, word string, onset double, duration double").json(path, multiLine=True)
    return read_transcript_flat(rows).filter("word <> ''")


BUNDLE = ("run_manifest", "stimulus_manifest", "friends_s7_manifest", "ood_manifest")


def save_bundle(tables: dict[str, DataFrame], path: str) -> None:
    """Four Parquet tables and a table of their row counts and hashes."""
    if set(tables) != set(BUNDLE):
        raise ValueError(f"a bundle has the tables {BUNDLE}")
    meta = None
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        one = M.table_hash(df).select(F.lit(name).alias("name"), "n", "hash")
        meta = one if meta is None else meta.union(one)
    meta.coalesce(1).write.mode("overwrite").parquet(f"{path}/metadata")


def bundle_report(spark: SparkSession, path: str, names: Sequence[str] = BUNDLE) -> DataFrame:
    """(name, n, ok): whether each table has the rows and the hash that the metadata say."""
    meta = spark.read.parquet(f"{path}/metadata")
    now = None
    for name in names:
        one = M.table_hash(spark.read.parquet(f"{path}/{name}")).select(F.lit(name).alias("name"), F.col("n").alias("n_now"), F.col("hash").alias("hash_now"))
        now = one if now is None else now.union(one)
    return now.join(meta, "name", "left").select("name", F.col("n_now").alias("n"), F.coalesce((F.col("n") == F.col("n_now")) & (F.col("hash") == F.col("hash_now")), F.lit(False)).alias("ok"))


def load_bundle(spark: SparkSession, path: str, names: Sequence[str] = BUNDLE) -> dict[str, DataFrame]:
    """The tables of a bundle; a table that doesn't agree with the metadata is an error. names can be a part of it."""
    if bad := [r["name"] for r in bundle_report(spark, path, names).collect() if not r["ok"]]:  # one row a table
        raise ValueError(f"bundle tables don't agree with their metadata: {bad}")
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


VAL_ROWS = ("row_index", "subject_id", "subject", "stimulus_id", "fmri_item_id", "task", "movie", "chunk", "segment_id", "segment_idx", "segment_start_s", "segment_duration_s", "tr_idx", "fmri_time_s")


SPLIT_TABLES = ("train_run_manifest", "val_run_manifest", "train_segment_manifest", "val_segment_manifest")


def write_split_artifacts(runs: DataFrame, segments: DataFrame, path: str, split: str = "split", key: str = "stimulus_id") -> None:
    """The four tables of a training split as TSV: runs with a split, and the segments of each split's stimuli."""
    for kind in ("train", "val"):
        own = runs.filter(F.col(split) == kind)
        write_tsv(own, f"{path}/{kind}_run_manifest")
        write_tsv(segments.join(own.select(key).distinct(), key, "left_semi"), f"{path}/{kind}_segment_manifest")


def read_split_artifacts(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.csv(f"{path}/{name}", sep="\t", header=True) for name in SPLIT_TABLES}


def write_val_rows(rows: DataFrame, path: str) -> None:
    """The fourteen fields of validation rows as TSV, in their order; other columns are left out, fields that are missing are empty."""
    have = set(rows.columns)
    fields = [F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in VAL_ROWS]
    rows.select(*fields).write.mode("overwrite").csv(path, sep="\t", header=True)


def write_submission(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("subject").parquet(path)


def read_submission(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def submission_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("subject").agg(F.count_distinct("chunk_key").alias("n_chunks"), F.count(F.lit(1)).alias("n_trs"))


def write_report_json(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.mode("overwrite").json(path)


def inference_index(predictions: DataFrame, root: str = "out") -> DataFrame:
    """(stimulus_id, subject, path, n_trs, n_parcels) of predictions (stimulus_id, subject, tr, vec)."""
    out = predictions.groupBy("stimulus_id", "subject").agg(F.count(F.lit(1)).alias("n_trs"), F.max(F.size("vec")).alias("n_parcels"))
    return out.withColumn("path", F.concat(F.lit(f"{root}/"), M.slug(F.col("stimulus_id").cast("string")), F.lit("_"), F.col("subject").cast("string")))
