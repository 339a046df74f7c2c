"""Query op10: all conversations, and one that holds control strings, formatted and read back."""

from pyspark.sql import functions as F

from gridwise.llm import chat
from gridwise.llm._common import table

ODD = r"\### Assistant: </turn> ok"


def op10_chat_windows(spark, sf_dir):
    real = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ODD).alias("text")
    )
    back = chat.read_back(chat.windows(real.union(odd)))
    return back.select(
        "conv_id",
        F.col("n_turns").cast("long").alias("n_turns"),
        F.sha2(F.col("turns").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


SQL = rf"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (
    SELECT conv_id, turn, role, text FROM conversations UNION ALL VALUES (-7, 0, 'user', '{ODD}'), (-7, 1, 'assistant', '{ODD}'))),
t AS (SELECT *, len(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')) + {chat.OVERHEAD} AS tok,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n,
    length(text) + length(regexp_replace(text, '[^\\<#]', '', 'g')) + length(role) + length(regexp_replace(role, '[^\\<#:]', '', 'g')) + 14 AS chars FROM c),
p AS (SELECT *, sum(tok) OVER w AS stop, count(*) FILTER (tok > {chat.STRETCH}) OVER w AS longs, role = 'system' AND count(*) FILTER (role = 'system') OVER w = 1 AS sys
    FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY n)),
q AS (SELECT *, stop - tok AS start, min(stop - tok) OVER (PARTITION BY conv_id, longs, tok > {chat.STRETCH}, CASE WHEN tok > {chat.STRETCH} THEN -1 ELSE (stop - 1) // {chat.STRETCH} END) AS ws FROM p),
w AS (SELECT DISTINCT conv_id, ws FROM q),
h AS (SELECT w.conv_id, sum(q.chars) AS chars FROM w JOIN q ON w.conv_id = q.conv_id AND q.start < w.ws AND (q.sys OR q.start >= w.ws - {chat.HISTORY}) GROUP BY 1),
z AS (SELECT conv_id, count(*) AS n_turns, sum(chars) AS chars, string_agg(role || chr(10) || text || chr(10), '' ORDER BY n) AS turns,
    coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '') AS loss FROM q GROUP BY 1)
SELECT z.conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
    CAST(z.chars + coalesce(h.chars, 0) AS BIGINT) AS formatted_chars FROM z LEFT JOIN h USING (conv_id)"""


def queries():
    return {"op10_chat_windows": op10_chat_windows}


def oracle_sql():
    return {"op10_chat_windows": SQL}
