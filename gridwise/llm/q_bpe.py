"""Query op2: encode and decode every document. SQL can't express it: tests hold it against the tokenizers library."""

from gridwise.llm import bpe
from gridwise.llm._common import table


def op2_bpe_encode_decode(spark, sf_dir):
    return bpe.digests(table(spark, sf_dir, "documents"))


def queries():
    return {"op2_bpe_encode_decode": op2_bpe_encode_decode}


def oracle_sql():
    return {}
