"""Query op1: license notices of every document. Alignment is no SQL: tests hold it against brute force."""

from pyspark.sql import functions as F

from gridwise.llm import license as scans
from gridwise.llm._common import table


def op1_license_scan(spark, sf_dir, templates=None):
    found = scans.scan(table(spark, sf_dir, "documents"), templates)
    return found.withColumn("coverage", F.round(F.col("n_matched") / F.col("n_words"), 6))


def queries():
    return {"op1_license_scan": op1_license_scan}


def oracle_sql():
    return {}
