"""Queries of layers and linear heads: an embedding of 64 numbers is 8 layers of 8 channels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridwise.operators import layers as L
from gridwise.plans.catalog import query, table


def features(spark, d):
    by = W.partitionBy("label").orderBy("vec_id")
    e = table(spark, d, "embeddings").withColumn("frame", F.row_number().over(by) - 1)
    cut = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, 8))).alias("layer", "vec")
    return e.select(F.col("label").alias("item"), "frame", cut)


FEATURES = "e AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame FROM embeddings), f AS (SELECT label AS item, frame, layer, embedding[layer * 8 + 1:layer * 8 + 8] AS vec FROM e, range(8) t(layer)), x AS (SELECT item, frame, layer, ch, vec[ch + 1]::DOUBLE AS v FROM f, range(8) c(ch))"


def flat(df, *keys, places=5):
    return df.select(*keys, F.posexplode("vec").alias("ch", "v")).select(*keys, "ch", F.round(F.col("v").cast("double"), places).alias("v"))


@query("p12_select_layers", f"WITH {FEATURES} SELECT item, frame, layer, round(layer / 7e0, 6) AS layer_frac FROM f WHERE layer IN (3, 5, 7)")
def p12(spark, d):
    return L.select_layers(features(spark, d), 8, [0.5, 0.75, 1.0]).select("item", "frame", "layer", F.round("layer_frac", 6).alias("layer_frac"))


@query("p13_select_all_layers", f"WITH {FEATURES} SELECT item, frame, ch, round(avg(v), 4) AS v FROM x GROUP BY 1, 2, 3")
def p13(spark, d):
    return flat(L.Pooling("all", aggregation="mean").apply(features(spark, d), 8), "item", "frame", places=4)


@query("p14_cast_save_dtype", f"WITH {FEATURES} SELECT item, frame, layer, ch, round(v, 5) AS v FROM x")
def p14(spark, d):
    return flat(L.cast_saved(features(spark, d), "double"), "item", "frame", "layer")


#: Half precision by its definition: 11 binary digits, halves to even; no value here is subnormal beyond 2^-24 or too large.
_HALF = "sign(v) * round_even(abs(v) / pow(2e0, greatest(floor(log2(abs(v))), -14) - 10), 0) * pow(2e0, greatest(floor(log2(abs(v))), -14) - 10)"


@query("p14_cast_half_precision", f"WITH {FEATURES} SELECT item, frame, layer, ch, CASE WHEN v = 0 THEN 0e0 ELSE {_HALF} END AS v FROM x")
def p14_half(spark, d):
    return L.cast_saved(features(spark, d), "half").select("item", "frame", "layer", F.posexplode("vec").alias("ch", "v")).withColumn("v", F.col("v").cast("double"))


@query("a8_layer_pool_mean", f"WITH {FEATURES} SELECT item, frame, ch, round(avg(v), 4) AS v FROM x WHERE layer IN (3, 5, 7) GROUP BY 1, 2, 3")
def a8(spark, d):
    return flat(L.Pooling(aggregation="mean").apply(features(spark, d), 8), "item", "frame", places=4)


@query("a9_layer_pool_group_mean", f"WITH {FEATURES} SELECT item, frame, CASE WHEN layer < 5 THEN 0 ELSE 1 END AS layer, CASE WHEN layer < 5 THEN 0.75e0 ELSE 1e0 END AS layer_frac, ch, round(avg(v), 4) AS v FROM x WHERE layer >= 3 GROUP BY 1, 2, 3, 4, 5")
def a9(spark, d):
    return flat(L.group_mean(features(spark, d), 8, [0.5, 0.75, 1.0]), "item", "frame", "layer", "layer_frac", places=4)


@query("a10_group_mean_equal", f"WITH {FEATURES} SELECT item, frame, (layer // 2)::INTEGER AS layer, ch, round(avg(v), 4) AS v FROM x GROUP BY 1, 2, 3, 4")
def a10(spark, d):
    return flat(L.group_mean_equal(features(spark, d), 8, 4), "item", "frame", "layer", places=4)


@query("a11_layer_cat", "WITH e AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame FROM embeddings) SELECT label AS item, frame, ch, round(embedding[ch + 1]::DOUBLE, 5) AS v FROM e, range(64) c(ch)")
def a11(spark, d):
    return flat(L.layer_cat(features(spark, d)), "item", "frame")


def _weights(subject=0):
    """Parameters of the heads: W[c, o] = ((c + 2 o + s) mod 5 - 2) / 4, b[o] = o / 10."""
    c, o = np.meshgrid(np.arange(8), np.arange(3), indexing="ij")
    return ((c + 2 * o + subject) % 5 - 2) / 4.0, np.arange(3) / 10.0


def _scored(df, places=4):
    return df.select("item", "frame", "layer", F.posexplode("pred").alias("out", "p")).select("item", "frame", "layer", "out", F.round("p", places).alias("pred"))


_W = "((ch + 2 * o + {s}) % 5 - 2) / 4e0"
_HEAD = f"WITH {FEATURES} SELECT item, frame, layer, o AS out, round({{expr}}, 4) AS pred FROM x, range(3) t(o) GROUP BY 1, 2, 3, 4"


@query("l1_subject_linear", _HEAD.format(expr=f"sum(v * {_W.format(s='item')}) + o / 10e0"))
def l1(spark, d):
    return _scored(L.subject_linear(features(spark, d), {s: _weights(s) for s in range(10)}, "item"))


@query("l1_subject_linear_long", _HEAD.format(expr=f"sum(v * {_W.format(s='item')})"))
def l1_long(spark, d):
    f = features(spark, d)
    w = f.select("item").distinct().select("item", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("ch")).select("item", "ch", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("out"))
    w = w.withColumn("w", (F.pmod(F.col("ch") + 2 * F.col("out") + F.col("item"), F.lit(5)) - 2) / 4)
    return L.subject_linear_long(f, w, ["frame", "layer"], "item").withColumn("pred", F.round("pred", 4))


@query("l2_group_linear", _HEAD.format(expr=f"sum(v * {_W.format(s=0)}) + o / 10e0"))
def l2(spark, d):
    return _scored(L.group_linear(features(spark, d), *_weights()))


@query("l3_group_residual", _HEAD.format(expr=f"sum(v * ({_W.format(s=0)} + {_W.format(s='item')})) + 2 * (o / 10e0)"))
def l3(spark, d):
    return _scored(L.group_residual(features(spark, d), *_weights(), {s: _weights(s) for s in range(10)}, subject="item"))


@query("l3_group_only", _HEAD.format(expr=f"sum(v * {_W.format(s=0)}) + o / 10e0"))
def l3_group(spark, d):
    return _scored(L.group_residual(features(spark, d), *_weights(), {}, "group_only", "item"))


@query(
    "l4_project",
    f"""WITH {FEATURES}, p AS (SELECT item, frame, layer, o, sum(v * {_W.format(s=0)}) + o / 10e0 AS p FROM x, range(3) t(o) GROUP BY 1, 2, 3, 4), m AS (SELECT *, avg(p) OVER w AS m, sqrt(var_pop(p) OVER w + 1e-5) AS s FROM p WINDOW w AS (PARTITION BY item, frame, layer)),
z AS (SELECT *, (p - m) / s AS z FROM m), g AS (SELECT *, coalesce(sign(z) * (SELECT sum(exp((2 * n + 1) * ln(abs(z) / sqrt(2e0)) - lgamma(n + 1.5e0) - z * z / 2)) FROM range(120) t(n)), 0e0) AS e FROM z)
SELECT item, frame, layer, o AS out, round(0.5e0 * z * (1 + e), 7) AS pred FROM g""",
)
def l4(spark, d):
    return _scored(L.project(features(spark, d), *_weights(), layer_norm=True, gelu=True), 7)


def _two(spark, d):
    f = features(spark, d)
    return f.select("item", "frame", "layer", F.col("vec").alias("audio"), F.transform("vec", lambda x: x * 2).alias("text"))


@query("l5_fuse_cat", f"WITH {FEATURES} SELECT item, frame, layer, ch, round(v, 5) AS v FROM x UNION ALL SELECT item, frame, layer, ch + 8, round(2 * v, 5) FROM x")
def l5(spark, d):
    return flat(L.fuse(_two(spark, d), ["text", "audio"]), "item", "frame", "layer")


@query("l5_fuse_mean", f"WITH {FEATURES} SELECT item, frame, layer, ch, round(1.5e0 * v, 4) AS v FROM x")
def l5_mean(spark, d):
    return flat(L.fuse(_two(spark, d), ["text", "audio"], "mean"), "item", "frame", "layer", places=4)


@query("l5_fuse_sum", f"WITH {FEATURES} SELECT item, frame, layer, ch, round(3 * v, 4) AS v FROM x")
def l5_sum(spark, d):
    return flat(L.fuse(_two(spark, d), ["text", "audio"], "sum"), "item", "frame", "layer", places=4)


@query("l6_layer_identity", f"WITH {FEATURES} SELECT item, frame, layer, ch, round(v, 5) AS v FROM x WHERE layer = 0")
def l6(spark, d):
    return flat(L.identity_layer(features(spark, d).filter("layer = 0")), "item", "frame", "layer")


@query("l7_static_expand", "SELECT vec_id, frame FROM embeddings, range(5) t(frame)")
def l7(spark, d):
    return L.static_expand(table(spark, d, "embeddings").select("vec_id"), 5)


@query("j19_subject_weights", f"WITH {FEATURES} SELECT item, frame, layer, round((item % 5 - 2) / 4e0, 6) AS w FROM f")
def j19(spark, d):
    f = features(spark, d).select("item", "frame", "layer")
    weights = f.select("item").distinct().withColumn("w", (F.pmod("item", F.lit(5)) - 2) / 4)
    return L.with_subject_weights(f, weights, "item").withColumn("w", F.round("w", 6))


@query("d4_prediction_modes", _HEAD.format(expr=f"sum(v * {_W.format(s=0)}) + o / 10e0").replace("SELECT item,", "SELECT 'group_only' AS mode, item,").replace("GROUP BY 1, 2, 3, 4", "GROUP BY 1, 2, 3, 4, 5") + " UNION ALL " + _HEAD.format(expr=f"sum(v * ({_W.format(s=0)} + {_W.format(s='item')})) + 2 * (o / 10e0)").removeprefix(f"WITH {FEATURES} ").replace("SELECT item,", "SELECT 'full' AS mode, item,").replace("GROUP BY 1, 2, 3, 4", "GROUP BY 1, 2, 3, 4, 5"))
def d4(spark, d):
    out = None
    for mode in ("group_only", "full"):
        one = _scored(L.group_residual(features(spark, d), *_weights(), {s: _weights(s) for s in range(10)}, mode, "item")).withColumn("mode", F.lit(mode))
        out = one if out is None else out.union(one)
    return out
