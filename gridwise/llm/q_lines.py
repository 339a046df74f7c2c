"""Query op5: every document with its recurring lines dropped. Clustering is no SQL: tests hold it against brute force."""

from pyspark.sql import functions as F

from gridwise.llm import linetree
from gridwise.llm._common import table


def op5_line_templates(spark, sf_dir):
    found = linetree.drop_recurring(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("kept_chars"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def queries():
    return {"op5_line_templates": op5_line_templates}


def oracle_sql():
    return {}
