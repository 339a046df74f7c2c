"""Query op7: totals of all documents after an insert batch, a batch of deletes and revisions (committed twice) and a second tokenizer."""

import uuid

from pyspark.sql import functions as F

from gridwise.llm import rollup
from gridwise.llm._common import checkpointed, ensure_checkpoint_dir, table, words


def op7_token_rollup(spark, sf_dir):
    runs = F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", "lang", F.size(words(F.col("text"))).alias("ws"), F.size(F.array_remove(runs, "")).alias("runs")
    )
    docs = checkpointed(docs)
    none = F.lit(None).cast("int")
    insert = lambda version, count: docs.select("source", "lang", F.lit(version).alias("tokenizer"), F.lit("insert").alias("kind"), none.alias("old_tokens"), F.col(count).alias("new_tokens"))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    judged = docs.hint("merge").join(labels, "doc_id").filter("toxic = 1 or quality = 0")
    kind = F.when(F.col("toxic") == 1, "delete").otherwise("revise")  # junk is counted by its runs of letters and digits from now on
    changes = judged.select("source", "lang", F.lit("ws-1").alias("tokenizer"), kind.alias("kind"), F.col("ws").alias("old_tokens"), F.col("runs").alias("new_tokens"))
    store = rollup.Rollup(spark, f"{ensure_checkpoint_dir(spark)}/rollup-{uuid.uuid4().hex}")
    store.commit("0001", insert("ws-1", "ws"))
    store.commit("0002", changes)
    store.commit("0003", insert("runs-1", "runs"))
    store.commit("0002", changes)
    return store.totals()


SQL = r"""WITH c AS (SELECT doc_id, source, lang, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS ws,
    len(list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS runs FROM documents),
x AS (SELECT source, lang, 'ws-1' AS tokenizer, CASE WHEN toxic = 1 THEN 0 ELSE 1 END AS d, CASE WHEN toxic = 1 THEN 0 WHEN quality = 0 THEN runs ELSE ws END AS t
    FROM c LEFT JOIN labels USING (doc_id) UNION ALL SELECT source, lang, 'runs-1', 1, runs FROM c)
SELECT source, lang, tokenizer, CAST(sum(d) AS BIGINT) AS n_docs, CAST(sum(t) AS BIGINT) AS n_tokens FROM x GROUP BY 1, 2, 3 HAVING sum(d) <> 0 OR sum(t) <> 0"""


def queries():
    return {"op7_token_rollup": op7_token_rollup}


def oracle_sql():
    return {"op7_token_rollup": SQL}
