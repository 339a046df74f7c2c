"""Query op8: near-duplicate classes of all documents. SQL has no XXH64, so tests hold it against brute force."""

from pyspark.sql import functions as F

from gridwise.llm import simhash
from gridwise.llm._common import table


def op8_simhash_golay(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def queries():
    return {"op8_simhash_golay": op8_simhash_golay}


def oracle_sql():
    return {}
