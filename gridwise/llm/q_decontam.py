"""Query op9: the benchmark items that each document leaks, with their coverage; clean documents have no row."""

from pyspark.sql import functions as F

from gridwise.llm import decontam
from gridwise.llm._common import table


def op9_benchmark_leaks(spark, sf_dir):
    found = decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "n_windows", "n_matched")


def _sql(pattern):
    """A pattern of the operator for DuckDB, which has no possessive repeats (and needs none: no pattern goes on after one that it could give back to)."""
    return pattern.replace("*+", "*").replace("++", "+").replace("'", "''")


def _tokens(name, source, names="true"):
    """name_k: the tokens of source's texts t, with all other columns; name_k.p has their templates."""
    return f"""{name}_m AS (SELECT * REPLACE (CASE WHEN {names} THEN regexp_replace(t, '{_sql(decontam.NAME)}', '\\1' || chr(2) || 'n\\2' || chr(3), 'g') ELSE t END AS t)
      FROM (SELECT * REPLACE (replace(replace(t, chr(2), ''), chr(3), '') AS t) FROM ({source}))),
{name}_k AS (SELECT *, list_transform(tok, lambda x: CASE WHEN starts_with(x, chr(2)) THEN x[1:2] ELSE lower(x) END) AS p FROM (
      SELECT * EXCLUDE (t), regexp_extract_all(regexp_replace(regexp_replace(t, '{_sql(decontam.NUMBER)}', chr(2) || 'z\\1' || chr(3), 'g'),
      '{_sql(decontam.UNIT)}', '\\1' || chr(2) || 'u\\2' || chr(3) || '\\3', 'g'), '{_sql(decontam.TOKEN)}') AS tok FROM {name}_m))"""


def _slots(tok):
    return f"list_filter({tok}, lambda x: starts_with(x, chr(2)))"


SQL = f"""WITH {_tokens("b", "SELECT DISTINCT item_id AS id, hash(text) AS tid, v, text AS t FROM benchmark, (VALUES (true), (false)) AS f (v) WHERE text IS NOT NULL", "v")},
{_tokens("d", "SELECT DISTINCT doc_id AS id, hash(text) AS rk, text AS t FROM documents WHERE text IS NOT NULL")},
b_n AS (SELECT *, least(len(tok), {decontam.WINDOW}) AS n FROM b_k WHERE len(tok) >= {decontam.SHORTEST}),
b_w AS (SELECT id, tid, v, n, len(tok) - n + 1 AS n_windows, i - 1 AS at_, array_to_string(p[i:i + n - 1], ' ') AS win, {_slots("tok[i:i + n - 1]")} AS s,
      list_filter(list_transform(range(i, i + n), lambda j: CASE WHEN starts_with(tok[j], chr(2)) THEN -1 ELSE j END), lambda j: j > 0) AS words
      FROM (SELECT *, unnest(range(1, len(tok) - n + 2)) AS i FROM b_n)),
d_w AS (SELECT id, rk, n, i - 1 AS at_, array_to_string(p[i:i + n - 1], ' ') AS win, {_slots("tok[i:i + n - 1]")} AS s
      FROM (SELECT *, unnest(range(1, len(tok) - n + 2)) AS i FROM d_k, (SELECT DISTINCT n FROM b_n) WHERE len(tok) >= n)),
r AS (SELECT d.id AS doc_id, d.rk, b.id AS item_id, b.tid, b.v, b.n_windows, d.at_ - b.at_ AS shift, list(DISTINCT b.at_) AS ats,
      list_distinct(flatten(list(list_zip(b.s, d.s)))) AS s, len(list_distinct(flatten(list(b.words)))) AS n_words
      FROM d_w d JOIN b_w b ON d.win = b.win AND d.n = b.n GROUP BY 1, 2, 3, 4, 5, 6, 7),
ok AS (SELECT * FROM r WHERE len(s) = len(list_distinct(list_transform(s, lambda x: x[1]))) AND len(s) = len(list_distinct(list_transform(s, lambda x: x[2])))
      AND (n_words >= {decontam.MIN_WORDS} OR len(list_filter(s, lambda x: x[1] <> x[2])) = 0)),
g AS (SELECT doc_id, rk, item_id, tid, v, n_windows, len(list_distinct(flatten(list(ats)))) AS n_matched FROM ok GROUP BY ALL),
h AS (SELECT doc_id, rk, item_id, tid, max({{'m': n_matched, 'w': n_windows}}) AS best FROM g WHERE n_matched >= {decontam.MIN_COVER}e0 * n_windows OR n_matched >= {decontam.MIN_RUN} GROUP BY ALL)
SELECT doc_id, item_id, CAST(best.w AS BIGINT) AS n_windows, CAST(best.m AS BIGINT) AS n_matched FROM h"""


def queries():
    return {"op9_benchmark_leaks": op9_benchmark_leaks}


def oracle_sql():
    return {"op9_benchmark_leaks": SQL}
