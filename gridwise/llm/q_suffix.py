"""Query op4: bytes in 400-byte strings that start twice. SQL can't express it at size: tests hold it against brute force."""

from pyspark.sql import functions as F

from gridwise.llm import suffix
from gridwise.llm._common import table


def op4_suffix_dedup(spark, sf_dir):
    found = suffix.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        (F.size("spans") > 0).alias("has_repeats"),
    )


def queries():
    return {"op4_suffix_dedup": op4_suffix_dedup}


def oracle_sql():
    return {}
