"""Query op11: tokens of two tokenizers aligned in every document. SQL can't express it: tests hold it against the libraries and brute force."""

from gridwise.llm import tokenalign
from gridwise.llm._common import table

COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op11_token_alignment(spark, sf_dir):
    return tokenalign.alignment(table(spark, sf_dir, "documents")).select(*COLUMNS)


def queries():
    return {"op11_token_alignment": op11_token_alignment}


def oracle_sql():
    return {}
