"""Queries of pairs: the two halves of an embedding are two representations of the vectors of a label."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridwise.functions import registry
from gridwise.operators import losses as T
from gridwise.operators import pairwise as P
from gridwise.plans.catalog import query, table


def rows(spark, d):
    by = W.partitionBy("label").orderBy("vec_id")
    half = lambda a: F.transform(F.slice("embedding", a, 32), lambda x: x.cast("double"))
    return table(spark, d, "embeddings").select(F.col("label").alias("group"), (F.row_number().over(by) - 1).cast("long").alias("i"), half(1).alias("x"), half(33).alias("y"))


ROWS = """r AS (SELECT label AS g, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, list_transform(embedding[1:32], lambda v: v::DOUBLE) AS x, list_transform(embedding[33:64], lambda v: v::DOUBLE) AS y FROM embeddings)"""
_PAIRS = f"WITH {ROWS}, p AS (SELECT a.g, a.i, b.i AS j, {{x}} AS a, {{y}} AS b FROM r a JOIN r b ON a.g = b.g AND a.i {{op}} b.i)"


def _sql(kind, op="<"):
    centre = "list_transform({0}.{1}, lambda v: v - list_avg({0}.{1}))"
    side = {
        "dot": "list_inner_product(a.{c}, b.{c})",
        "euclidean": "list_distance(a.{c}, b.{c})",
        "cosine": "1 - list_cosine_similarity(a.{c}, b.{c})",
        "correlation": f"1 - list_cosine_similarity({centre.format('a', '{c}')}, {centre.format('b', '{c}')})",
    }[kind]
    return _PAIRS.format(x=side.format(c="x"), y=side.format(c="y"), op=op)


for _kind in ("dot", "euclidean", "cosine", "correlation"):

    @query(f"j12_pairwise_{_kind}", f"{_sql(_kind)} SELECT g AS \"group\", i, j, round(a, 5) AS x, round(b, 5) AS y FROM p")
    def j12(spark, d, kind=_kind):
        return P.pairs(rows(spark, d), {"x": kind, "y": kind}, digits=5)


@query("w3_avg_rank", "SELECT l_suppkey, l_orderkey, l_linenumber, l_quantity, rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) - 1 + (count(*) OVER (PARTITION BY l_suppkey, l_quantity) - 1) / 2e0 AS r FROM lineitem")
def w3(spark, d):
    return P.average_ranks(table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity"), ["l_suppkey"], "l_quantity", "r")


_CORR = "round(sum((a-ma)*(b-mb)) / greatest(sqrt(sum((a-ma)*(a-ma))) * sqrt(sum((b-mb)*(b-mb))), 1e-8), 5)"
for _dis, _sim in (("correlation", "pearson"), ("euclidean", "spearman"), ("cosine", "pearson")):
    _vals = (
        "q AS (SELECT g, a, b FROM p)"
        if _sim == "pearson"
        else "q AS (SELECT g, rank() OVER (PARTITION BY g ORDER BY a) + (count(*) OVER (PARTITION BY g, a) - 1) / 2e0 AS a, rank() OVER (PARTITION BY g ORDER BY b) + (count(*) OVER (PARTITION BY g, b) - 1) / 2e0 AS b FROM p)"
    )

    @query(f"a24_rsa_{_dis}_{_sim}", f"{_sql(_dis)}, {_vals}, m AS (SELECT *, avg(a) OVER (PARTITION BY g) AS ma, avg(b) OVER (PARTITION BY g) AS mb FROM q) SELECT g AS \"group\", {_CORR} AS rsa, round(1 - {_CORR}, 5) AS loss FROM m GROUP BY 1")
    def a24(spark, d, dis=_dis, sim=_sim):
        return P.rsa(rows(spark, d), dissimilarity=dis, similarity=sim, digits=5).withColumns({"rsa": F.round("rsa", 5), "loss": F.round(1 - F.round("rsa", 5), 5)})


_CKA = f"""WITH {ROWS}, e AS (SELECT g, i, c, x[c] - avg(x[c]) OVER (PARTITION BY g, c) AS x, y[c] - avg(y[c]) OVER (PARTITION BY g, c) AS y FROM r, range(1, 33) t(c)),
s AS (SELECT a.g, a.c AS c1, b.c AS c2, sum(a.x * b.x) AS xx, sum(a.x * b.y) AS xy, sum(a.y * b.y) AS yy FROM e a JOIN e b ON a.g = b.g AND a.i = b.i GROUP BY 1, 2, 3)
SELECT g AS "group", round(sum(xy * xy) / (sqrt(sum(xx * xx)) * sqrt(sum(yy * yy))), 6) AS cka FROM s GROUP BY 1"""


@query("a25_cka_linear", _CKA)
def a25(spark, d):
    return P.cka_linear(rows(spark, d)).withColumn("cka", F.round("cka", 6))


_ROWSUM = "b2 AS (SELECT g, i, a, b FROM p UNION ALL SELECT g, j, a, b FROM p WHERE i <> j), rs AS (SELECT g, i, sum(a) AS a, sum(b) AS b FROM b2 GROUP BY 1, 2)"


def _unbiased(p, q):
    return f"(2 * p{p}{q} + 4 * s{p} * s{q} / ((n - 1) * (n - 2)) - 2 * r{p}{q} / (n - 2)) / (n * (n - 3))"


@query(
    "a26_cka_unbiased",
    f"""{_sql("dot")}, {_ROWSUM}, u AS (SELECT g, sum(a*b) AS pab, sum(a*a) AS paa, sum(b*b) AS pbb, sum(a) AS sa, sum(b) AS sb FROM p GROUP BY 1), v AS (SELECT g, count(*)::DOUBLE AS n, sum(a*b) AS rab, sum(a*a) AS raa, sum(b*b) AS rbb FROM rs GROUP BY 1),
h AS (SELECT g, {_unbiased("a", "b")} AS xy, {_unbiased("a", "a")} AS xx, {_unbiased("b", "b")} AS yy FROM u JOIN v USING (g) WHERE n >= 4) SELECT g AS "group", round(CASE WHEN xx * yy <= 0 THEN 0 ELSE xy / (sqrt(greatest(xx * yy, 0)) + 1e-8) END, 5) AS cka FROM h""",
)
def a26(spark, d):
    return P.cka_unbiased(rows(spark, d)).withColumn("cka", F.round("cka", 5))


def _hsic(p, q):
    return f"(p{p}{q} - 2 * r{p}{q} / n + t{p} * t{q} / (n * n))"


@query(
    "a27_cka_rbf",
    f"""{_sql("euclidean", "<=").replace("p AS (", "p0 AS (")}, sg AS (SELECT g, median(a) AS s FROM p0 WHERE i <> j GROUP BY 1), p AS (SELECT g, i, j, exp(-a*a / (2*s*s)) AS a, exp(-b*b / (2*s*s)) AS b FROM p0 JOIN sg USING (g)), {_ROWSUM},
u AS (SELECT g, sum(w*a*b) AS pab, sum(w*a*a) AS paa, sum(w*b*b) AS pbb FROM (SELECT *, CASE WHEN i = j THEN 1 ELSE 2 END AS w FROM p) GROUP BY 1),
v AS (SELECT g, count(*)::DOUBLE AS n, sum(a) AS ta, sum(b) AS tb, sum(a*b) AS rab, sum(a*a) AS raa, sum(b*b) AS rbb FROM rs GROUP BY 1) SELECT g AS "group", round({_hsic("a", "b")} / sqrt({_hsic("a", "a")} * {_hsic("b", "b")}), 5) AS cka FROM u JOIN v USING (g)""",
)
def a27(spark, d):
    return P.cka_rbf(rows(spark, d)).withColumn("cka", F.round("cka", 5))


def _batches(spark, d):
    """Uneven batches of a subject: a batch of one row has no score, one of two rows a similarity of 0."""
    half = lambda a: F.transform(F.slice("embedding", a, 32), lambda x: x.cast("double"))
    batch = F.when(F.col("vec_id") % 50 < 12, F.floor(F.col("vec_id") / 12) + 3).otherwise(F.pmod("vec_id", F.lit(3)))
    return table(spark, d, "embeddings").select(batch.alias("batch_id"), F.col("label").alias("subject"), F.col("vec_id").alias("order_id"), half(1).alias("x"), half(33).alias("y"))


_BATCH = "label * 1000000 + CASE WHEN vec_id % 50 < 12 THEN vec_id // 12 + 3 ELSE vec_id % 3 END"
_BY_BATCH = lambda sql: sql.replace("label AS g", f"{_BATCH} AS g").replace("PARTITION BY label ORDER", f"PARTITION BY {_BATCH} ORDER")
_WEIGHTED = "SELECT s.\"group\" // 1000000 AS subject, round(sum({v} * n) / sum(n), 5) AS value FROM ({sql}) s JOIN (SELECT {b} AS g, count(*) AS n FROM embeddings GROUP BY 1) c ON c.g = s.\"group\" WHERE n >= {least} GROUP BY 1"


@query("a28_subject_representation_metrics", _WEIGHTED.format(v="cka", sql=_BY_BATCH(_CKA).replace("round(", "(").replace(", 6) AS cka", ") AS cka"), b=_BATCH, least=2))
def a28(spark, d):
    return P.subject_representation(_batches(spark, d), lambda m: P.cka_linear(m).withColumnRenamed("cka", "value")).withColumn("value", F.round("value", 5))


_RSA = _CORR.removeprefix("round(").removesuffix(", 5)")


@query(
    "a28_subject_representation_rsa",
    _WEIGHTED.format(v="rsa", sql=_BY_BATCH(_sql("correlation")) + f", m AS (SELECT *, avg(a) OVER (PARTITION BY g) AS ma, avg(b) OVER (PARTITION BY g) AS mb FROM p) SELECT g AS \"group\", {_RSA} AS rsa FROM m GROUP BY 1", b=_BATCH, least=2),
)
def a28_rsa(spark, d):
    return P.subject_representation(_batches(spark, d), lambda m: P.rsa(m).select("group", F.col("rsa").alias("value"))).withColumn("value", F.round("value", 5))


# Composites: one aggregation of the states of all terms; the SQL adds up what each term's own definition gives.
_CELLS = f"{ROWS}, e AS (SELECT g, i, c, x[c] AS x, y[c] AS y FROM r, range(1, 33) t(c))"
_MSE = "t_mse AS (SELECT g, avg((x - y) * (x - y)) AS mse FROM e GROUP BY 1)"
_PEARSON = "t_pearson AS (SELECT g, avg(r) AS pearson FROM (SELECT g, c, corr(x, y) AS r FROM e GROUP BY 1, 2) GROUP BY 1)"
_RSA_TERM = f"{_sql('correlation').removeprefix(f'WITH {ROWS}, ')}, pm AS (SELECT *, avg(a) OVER (PARTITION BY g) AS ma, avg(b) OVER (PARTITION BY g) AS mb FROM p), t_rsa AS (SELECT g, {_RSA} AS rsa FROM pm GROUP BY 1)"
_CKA_TERM = f"t_cka AS (SELECT \"group\" AS g, cka FROM ({_CKA.replace('round(', '(').replace(', 6) AS cka', ') AS cka')}))"


@query("a38_composite_mse_rsa_log", f"WITH {_CELLS}, {_MSE}, {_RSA_TERM} SELECT g AS \"group\", round(mse, 5) AS mse, round(ln(1 - rsa + 1e-8), 5) AS rsa_log, round(mse + ln(1 - rsa + 1e-8), 5) AS loss FROM t_mse JOIN t_rsa USING (g)")
def a38_mse_rsa_log(spark, d):
    out = T.composite(rows(spark, d), "mse_rsa_log")
    return out.withColumns({c: F.round(c, 5) for c in ("mse", "rsa_log", "loss")})


@query(
    "a38_composite_pearson_rsa_cka_log",
    f"WITH {_CELLS}, {_PEARSON}, {_RSA_TERM}, {_CKA_TERM} SELECT g AS \"group\", round(1 - pearson, 5) AS pearson, round(1 - rsa, 5) AS rsa, round(ln(1 - cka + 1e-8), 5) AS cka_log, round(0.03e0 * (1 - pearson) + 2 * (1 - rsa) + 0.5e0 * ln(1 - cka + 1e-8), 5) AS loss FROM t_pearson JOIN t_rsa USING (g) JOIN t_cka USING (g)",
)
def a38_pearson_rsa_cka_log(spark, d):
    out = T.composite(rows(spark, d), "pearson_rsa_cka_log", {"pearson": 0.03, "rsa": 2, "cka": 0.5})
    return out.withColumns({c: F.round(c, 5) for c in ("pearson", "rsa", "cka_log", "loss")})


@query("d2_similarity_registry", f"WITH {_CELLS}, {_PEARSON}, {_RSA_TERM}, {_CKA_TERM} SELECT g AS \"group\", round(rsa, 5) AS rsa, round(cka, 5) AS cka, round(pearson, 5) AS pearson FROM t_pearson JOIN t_rsa USING (g) JOIN t_cka USING (g)")
def d2_similarity(spark, d):
    out = registry.score_samples(rows(spark, d), ["rsa", "cka", "pearson"])
    return out.withColumns({c: F.round(c, 5) for c in ("rsa", "cka", "pearson")})
