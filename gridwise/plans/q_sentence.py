"""Queries of sentences: turns of conversations are transcripts; their words with some left out, put in and replaced are the other side."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridwise.operators import ordered
from gridwise.operators import sentences as S
from gridwise.operators.intervals import sentence_context
from gridwise.operators.ordered import load
from gridwise.plans.catalog import query, table
from gridwise.plans.q_interval import TALK, talk

_LONGEST = 12
_SPLIT = f"""e AS (SELECT *, regexp_matches(word, '[.!?…]["''”’)\\]]*$') AS e FROM t),
rn AS (SELECT *, coalesce(sum(e::INT) OVER (PARTITION BY item ORDER BY word_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM e),
ps AS (SELECT *, row_number() OVER (PARTITION BY item, run ORDER BY word_idx) - 1 AS pos FROM rn),
se AS (SELECT item, word_idx, word, (sum((pos % {_LONGEST} = 0)::INT) OVER (PARTITION BY item ORDER BY word_idx) - 1)::BIGINT AS sentence_idx FROM ps)"""


def most(spark, d):
    """Load of the words by item, from the texts: nothing is written out for it."""
    n = F.size(F.split("text", " "))
    return load(table(spark, d, "conversations").filter("text is not null"), ["conv_id", "turn"], n)


def split(spark, d, largest=None):
    small = (largest or most(spark, d)[0]) <= ordered.TASK_ROWS
    return S.split_sentences(talk(spark, d).select("item", "word_idx", "word"), longest=_LONGEST, small=small or None)


@query("w9_split_sentences", f"WITH {TALK}, {_SPLIT} SELECT item, word_idx, sentence_idx FROM se")
def split_query(spark, d):
    return split(spark, d).select("item", "word_idx", "sentence_idx")


@query(
    "w9_sentence_texts",
    f"WITH {TALK}, {_SPLIT}, j AS (SELECT item, sentence_idx, count(*) AS n_words, string_agg(word, ' ' ORDER BY word_idx) AS x FROM se GROUP BY 1, 2) SELECT item, sentence_idx, n_words, rtrim(CASE WHEN left(x, 1) = 'ß' THEN 'Ss' ELSE upper(left(x, 1)) END || lower(substr(x, 2)), '.') AS text FROM j",
)
def texts_query(spark, d):
    return S.sentence_texts(split(spark, d))


def sides(spark, d):
    """(words, text words with sentence_idx, load of both): each side lacks words that the other one has."""
    largest, n = most(spark, d)
    said = split(spark, d, largest)
    heard = said.filter("word_idx % 11 <> 5").select("item", F.col("word_idx").alias("at"), F.when(F.col("word_idx") % 17 == 4, "zz").otherwise(F.col("word")).alias("word"))
    words = heard.withColumn("word_idx", F.row_number().over(W.partitionBy("item").orderBy("at")) - 1).drop("at")
    music = F.when(F.col("word_idx") % 13 == 3, F.struct(F.lit(0).alias("k"), F.lit("[music]").alias("word")))
    both = said.select("item", "word_idx", "sentence_idx", F.inline(F.array_compact(F.array(music, F.struct(F.lit(1).alias("k"), "word")))))
    text = both.withColumn("text_idx", F.row_number().over(W.partitionBy("item").orderBy("word_idx", "k")) - 1).select("item", "text_idx", "word", "sentence_idx")
    return words, text, (3 * largest, 3 * n)  # no more than the words on one side, and twice as many on the other


_SIDES = """a0 AS (SELECT item, row_number() OVER (PARTITION BY item ORDER BY word_idx) - 1 AS word_idx, CASE WHEN word_idx % 17 = 4 THEN 'zz' ELSE word END AS word FROM t WHERE word_idx % 11 <> 5),
b0 AS (SELECT item, row_number() OVER (PARTITION BY item ORDER BY word_idx, k) - 1 AS text_idx, word, sentence_idx FROM (SELECT item, word_idx, word, sentence_idx, 1 AS k FROM se UNION ALL SELECT item, word_idx, '[music]', sentence_idx, 0 FROM se WHERE word_idx % 13 = 3))"""
_NORMAL = """trim(lower(word), '",. ()?!' || chr(10) || chr(9))"""
_MATCH = f"""a1 AS (SELECT item, word_idx, {_NORMAL} AS n FROM a0), b1 AS (SELECT item, text_idx, {_NORMAL} AS n FROM b0),
a AS (SELECT *, [n, coalesce(lead(n, 1) OVER w, ''), coalesce(lead(n, 2) OVER w, '')] AS g FROM a1 WINDOW w AS (PARTITION BY item ORDER BY word_idx)),
b AS (SELECT *, [n, coalesce(lead(n, 1) OVER w, ''), coalesce(lead(n, 2) OVER w, '')] AS g FROM b1 WINDOW w AS (PARTITION BY item ORDER BY text_idx)),
ua AS (SELECT item, g, min(word_idx) AS i FROM a WHERE n <> '' GROUP BY 1, 2 HAVING count(*) = 1), ub AS (SELECT item, g, min(text_idx) AS j FROM b WHERE n <> '' GROUP BY 1, 2 HAVING count(*) = 1),
an AS (SELECT item, i, j FROM ua JOIN ub USING (item, g)),
ok AS (SELECT item, i, j FROM (SELECT *, max(j) OVER (PARTITION BY item ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p, min(j) OVER (PARTITION BY item ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS q FROM an) WHERE coalesce(p < j, true) AND coalesce(q > j, true)),
ca AS (SELECT a.item, word_idx, n, count(ok.i) OVER (PARTITION BY a.item ORDER BY word_idx) AS seg FROM a LEFT JOIN ok ON ok.item = a.item AND i = word_idx),
cb AS (SELECT b.item, text_idx, n, count(ok.j) OVER (PARTITION BY b.item ORDER BY text_idx) AS seg FROM b LEFT JOIN ok ON ok.item = b.item AND j = text_idx),
ua2 AS (SELECT item, seg, n, min(word_idx) AS i FROM ca WHERE n <> '' GROUP BY 1, 2, 3 HAVING count(*) = 1), ub2 AS (SELECT item, seg, n, min(text_idx) AS j FROM cb WHERE n <> '' GROUP BY 1, 2, 3 HAVING count(*) = 1),
an2 AS (SELECT item, seg, i, j FROM ua2 JOIN ub2 USING (item, seg, n)),
ok2 AS (SELECT item, i, j FROM (SELECT *, max(j) OVER (PARTITION BY item, seg ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p, min(j) OVER (PARTITION BY item, seg ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS q FROM an2) WHERE coalesce(p < j, true) AND coalesce(q > j, true)),
xa AS (SELECT ca.item, word_idx, n, 1000000 * seg + count(ok2.i) OVER (PARTITION BY ca.item, seg ORDER BY word_idx) AS seg FROM ca LEFT JOIN ok2 ON ok2.item = ca.item AND i = word_idx),
xb AS (SELECT cb.item, text_idx, n, 1000000 * seg + count(ok2.j) OVER (PARTITION BY cb.item, seg ORDER BY text_idx) AS seg FROM cb LEFT JOIN ok2 ON ok2.item = cb.item AND j = text_idx),
sa AS (SELECT *, row_number() OVER (PARTITION BY item, seg ORDER BY word_idx) - 1 AS f, row_number() OVER (PARTITION BY item, seg ORDER BY word_idx DESC) - 1 AS e, count(*) OVER (PARTITION BY item, seg) AS m FROM xa),
sb AS (SELECT *, row_number() OVER (PARTITION BY item, seg ORDER BY text_idx) - 1 AS f, row_number() OVER (PARTITION BY item, seg ORDER BY text_idx DESC) - 1 AS e, count(*) OVER (PARTITION BY item, seg) AS m FROM xb),
fw AS (SELECT sa.item, sa.seg, word_idx, text_idx, bool_and(sa.n = sb.n) OVER (PARTITION BY sa.item, sa.seg ORDER BY sa.f) AS good FROM sa JOIN sb ON sa.item = sb.item AND sa.seg = sb.seg AND sa.f = sb.f),
dn AS (SELECT item, seg, count(*) AS done FROM fw WHERE good GROUP BY 1, 2),
bw AS (SELECT sa.item, sa.seg, word_idx, text_idx, sa.e, least(sa.m, sb.m) AS m, bool_and(sa.n = sb.n) OVER (PARTITION BY sa.item, sa.seg ORDER BY sa.e) AS good FROM sa JOIN sb ON sa.item = sb.item AND sa.seg = sb.seg AND sa.e = sb.e),
mt AS (SELECT item, word_idx, text_idx FROM fw WHERE good UNION ALL SELECT bw.item, word_idx, text_idx FROM bw LEFT JOIN dn ON dn.item = bw.item AND dn.seg = bw.seg WHERE good AND e < m - coalesce(done, 0))"""


@query("w9_match_words", f"WITH {TALK}, {_SPLIT}, {_SIDES}, {_MATCH} SELECT item, word_idx, text_idx FROM mt")
def match_query(spark, d):
    words, text, both = sides(spark, d)
    return S.match_words(words, text, most=both)


_KNOWN = """kn AS (SELECT a0.item, a0.word_idx, a0.word, b0.sentence_idx AS s FROM a0 LEFT JOIN mt ON mt.item = a0.item AND mt.word_idx = a0.word_idx LEFT JOIN b0 ON b0.item = mt.item AND b0.text_idx = mt.text_idx),
nx AS (SELECT *, last_value(s IGNORE NULLS) OVER (PARTITION BY item ORDER BY word_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s0, first_value(s IGNORE NULLS) OVER (PARTITION BY item ORDER BY word_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS s1 FROM kn),
ws AS (SELECT item, word_idx, word, coalesce(s, CASE WHEN s0 = s1 THEN s0 END) AS sentence_idx FROM nx)"""


@query("w9_word_sentences", f"WITH {TALK}, {_SPLIT}, {_SIDES}, {_MATCH}, {_KNOWN} SELECT item, word_idx, word, sentence_idx FROM ws")
def sentences_query(spark, d):
    words, text, both = sides(spark, d)
    return S.word_sentences(words, text, most=both).select("item", "word_idx", "word", "sentence_idx")


@query(
    "w9_matched_context",
    f"WITH {TALK}, {_SPLIT}, {_SIDES}, {_MATCH}, {_KNOWN}, x AS (SELECT *, sum((sentence_idx IS NULL)::INT) OVER (PARTITION BY item ORDER BY word_idx) AS run FROM ws) SELECT item, word_idx, CASE WHEN sentence_idx IS NULL THEN '' ELSE coalesce(string_agg(CASE WHEN sentence_idx IS NOT NULL THEN word END, ' ') OVER (PARTITION BY item, run ORDER BY word_idx ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), '') END AS context FROM x",
)
def context_query(spark, d):
    words, text, both = sides(spark, d)
    small = both[0] <= ordered.TASK_ROWS or None
    return sentence_context(S.word_sentences(words, text, most=both), 5, small=small).select("item", "word_idx", "context")
