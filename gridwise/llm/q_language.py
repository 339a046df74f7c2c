"""Query op13: the language of every document, learned from those that are not held out. SQL can't express it: tests hold it against brute force and held-out accuracy."""

from pyspark.sql import functions as F

from gridwise.llm import langid
from gridwise.llm._common import stored, table

FOLDS, HELD_OUT = 4, 2


def op13_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    learned = stored(langid.profiles(docs.filter(fold != HELD_OUT)))
    held_out = F.coalesce(fold == HELD_OUT, F.lit(False))
    return langid.predict(docs.select("doc_id", "text", held_out.alias("held_out")), learned).select("doc_id", "held_out", "lang_pred", "score")


def queries():
    return {"op13_language_id": op13_language_id}


def oracle_sql():
    return {}
