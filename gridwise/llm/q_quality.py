"""Query op6: base counts and the line-first verdict of every document."""

from pyspark.sql import functions as F

from gridwise.llm import quality
from gridwise.llm._common import table

COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_quality_rules(spark, sf_dir):
    rated = quality.rate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rated.select("doc_id", *[F.col("quality")[c].alias(c) for c in COLUMNS])


#: Common table expressions that end in ``rated`` (doc_id, the base counts, kept, kept lines joined); %s is the table.
RATED = r"""
d AS (SELECT row_number() OVER () AS rid, *, coalesce(text, '') AS t FROM %s),
w AS (SELECT rid, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
g AS (SELECT rid, i, array_to_string(w[i:i + 4], ' ') AS win FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM g) WHERE n > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n_repeat FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM rep) GROUP BY rid),
l AS (SELECT rid, pos, line FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM d)
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
lv AS (SELECT *, NOT (
    length(regexp_replace(line, '[^#*$%%&|<>!]', '', 'g')) * 10 >= length(line)
    OR NOT regexp_matches(line, '[.!?:;…。！？]["''”’»)\]\x20\x09-\x0D]*$')
    OR length(regexp_replace(line, '[^|»›·]', '', 'g')) >= 3
    OR regexp_matches(line, '(?i)(cookie policy|privacy policy|terms of use|terms of service|all rights reserved|accept cookies|accept all cookies|javascript is disabled|javascript is required|subscribe to our newsletter|click here|sign in to|sign up for|lorem ipsum|skip to content|skip to main content)')) AS ok
    FROM l),
la AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup, sum(length(line)) AS chars, coalesce(sum(length(line)) FILTER (ok), 0) AS kept_chars,
    string_agg(line, chr(10) ORDER BY pos) FILTER (ok) AS kept_text FROM lv GROUP BY rid),
b AS (SELECT d.*, len(w.w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(t, '[^#*$%%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup, 0) AS n_dup_lines, coalesce(n_repeat, 0) AS n_repeat_words,
    coalesce(chars, 0) AS chars, coalesce(kept_chars, 0) AS kept_chars, coalesce(kept_text, '') AS kept_text
    FROM d JOIN w USING (rid) LEFT JOIN cov USING (rid) LEFT JOIN la USING (rid)),
rated AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
    NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND kept_chars >= 0.5e0 * chars AS kept FROM b)
"""

SQL = f"""WITH {RATED % "documents"}
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
    CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, kept FROM rated"""


def queries():
    return {"op6_quality_rules": op6_quality_rules}


def oracle_sql():
    return {"op6_quality_rules": SQL}
