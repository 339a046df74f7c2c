"""Queries of the scores: lineitem rows are predictions (price) and targets (quantity) of parcels (supplier)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridwise.operators import metrics as M
from gridwise.plans.catalog import query, table


def rows(spark, d):
    return table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("parcel"), F.col("l_linenumber").alias("subject"), F.col("l_returnflag").alias("task"), F.col("l_extendedprice").alias("pred"), F.col("l_quantity").alias("target")
    )


def r6(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


ROWS = "l AS (SELECT l_suppkey AS parcel, l_linenumber AS subject, l_returnflag AS task, l_extendedprice AS pred, l_quantity AS target FROM lineitem)"
SUMS = "count(*)::DOUBLE AS n, sum(pred) AS sx, sum(target) AS sy, sum(pred*pred) AS sxx, sum(target*target) AS syy, sum(pred*target) AS sxy, sum(target-pred) AS se, sum((target-pred)*(target-pred)) AS see"
R = "greatest(-1e0, least(1e0, (n*sxy - sx*sy) / greatest(sqrt(greatest(n*sxx - sx*sx, 0e0)) * sqrt(greatest(n*syy - sy*sy, 0e0)), 1e-8)))"
STRICT = "CASE WHEN n*sxx - sx*sx > 0 AND n*syy - sy*sy > 0 THEN (n*sxy - sx*sy) / sqrt((n*sxx - sx*sx) * (n*syy - sy*sy)) END"
EV = "least(1e0, 1 - (n*see - se*se) / greatest(n*syy - sy*sy, 1e-8))"


@query("a12_pearson_per_parcel", f"WITH {ROWS}, s AS (SELECT parcel, {SUMS} FROM l GROUP BY 1) SELECT parcel, CAST(n AS BIGINT) AS n, round({R}, 6) AS r FROM s")
def a12(spark, d):
    return r6(M.pearson_per_parcel(rows(spark, d)), "r")


@query("a13_explained_variance", f"WITH {ROWS}, s AS (SELECT parcel, {SUMS} FROM l GROUP BY 1) SELECT parcel, round({EV}, 4) AS ev FROM s")
def a13(spark, d):
    return M.explained_variance(rows(spark, d)).withColumn("ev", F.round("ev", 4))


_GROUPED = f"""WITH {ROWS}, g AS (SELECT 'all' AS grouping, '' AS value, * FROM l UNION ALL SELECT 'subject', subject::VARCHAR, * FROM l UNION ALL SELECT 'task', task, * FROM l),
s AS (SELECT grouping, value, parcel, {SUMS} FROM g GROUP BY 1, 2, 3), v AS (SELECT grouping, value, avg({R}) AS r, avg({EV}) AS ev FROM s GROUP BY 1, 2)"""


@query("a14_grouped_pearson_ev", f"{_GROUPED} SELECT grouping, value, round(r, 6) AS r, round(ev, 3) AS ev FROM v")
def a14(spark, d):
    return M.grouped_scores(rows(spark, d), ["subject", "task"]).withColumns({"r": F.round("r", 6), "ev": F.round("ev", 3)})


@query("a14_macro_mean", f"{_GROUPED} SELECT grouping, round(avg(r), 6) AS r, round(avg(ev), 3) AS ev FROM v GROUP BY 1")
def a14_macro(spark, d):
    return M.macro_mean(M.grouped_scores(rows(spark, d), ["subject", "task"])).withColumns({"r": F.round("r", 6), "ev": F.round("ev", 3)})


@query(
    "a15_weighted_mean",
    "SELECT l_returnflag, round(coalesce(sum(l_extendedprice*l_discount) FILTER (l_discount > 0) / nullif(sum(l_discount) FILTER (l_discount > 0), 0), 0), 4) AS mean FROM lineitem GROUP BY 1",
)
def a15(spark, d):
    return M.weighted_mean(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_discount").withColumn("mean", F.round("mean", 4))


@query(
    "a16_pearson_twopass",
    f"""WITH {ROWS}, m AS (SELECT parcel, avg(pred) AS mx, avg(target) AS my FROM l GROUP BY 1),
c AS (SELECT parcel, sum((pred-mx)*(target-my)) AS xy, sum((pred-mx)*(pred-mx)) AS xx, sum((target-my)*(target-my)) AS yy FROM l JOIN m USING (parcel) GROUP BY 1)
SELECT parcel, round(xy / nullif(sqrt(xx*yy), 0), 6) AS r FROM c""",
)
def a16(spark, d):
    return r6(M.pearson_two_pass(rows(spark, d)), "r")


_ARRAYS = f"""{ROWS}, s1 AS (SELECT parcel, {SUMS} FROM l GROUP BY 1), s2 AS (SELECT subject, parcel, {SUMS} FROM l GROUP BY 1, 2),
a AS (SELECT NULL::INTEGER AS subject, parcel, {STRICT} AS r FROM s1 UNION ALL SELECT subject, parcel, {STRICT} FROM s2)"""


@query("a18_pearson_report_arrays", f"WITH {_ARRAYS} SELECT subject, parcel, round(r, 6) AS r FROM a")
def a18(spark, d):
    return r6(M.report_arrays(rows(spark, d)), "r")


_REPORT = "round(avg(r), 4) AS mean, round(median(r), 4) AS median, round(quantile_cont(r, 0.1), 4) AS p10, round(quantile_cont(r, 0.9), 4) AS p90, count(*) FILTER (r > 0) AS n_positive"


@query("a19_run_report", f"WITH {_ARRAYS} SELECT subject, {_REPORT} FROM a GROUP BY 1")
def a19(spark, d):
    return M.run_report(M.report_arrays(rows(spark, d)), ["subject"])


@query(
    "a39_acceptance_check",
    f"WITH {_ARRAYS}, p AS (SELECT subject, {_REPORT} FROM a GROUP BY 1) SELECT *, round(abs(mean - 0.5e0), 6) AS gap, CASE WHEN abs(mean - 0.5e0) <= 0.02e0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM p",
)
def a39(spark, d):
    return r6(M.acceptance(M.run_report(M.report_arrays(rows(spark, d)), ["subject"]), 0.5), "gap")


@query("a22_mse", f"WITH {ROWS} SELECT parcel, round(avg((pred-target)*(pred-target)) / 1e6, 4) AS mse FROM l GROUP BY 1")
def a22(spark, d):
    return M.mse(rows(spark, d), ["parcel"]).withColumn("mse", F.round(F.col("mse") / 1e6, 4))


_LOSS = "(sxy - sx*sy/n) / (greatest(sqrt(greatest((n*sxx - sx*sx)/n, 0e0)), 1e-8) * greatest(sqrt(greatest((n*syy - sy*sy)/n, 0e0)), 1e-8))"


@query("a23_pearson_loss", f"WITH {ROWS}, s AS (SELECT parcel, {SUMS} FROM l GROUP BY 1) SELECT round(1 - avg({_LOSS}), 6) AS loss FROM s")
def a23(spark, d):
    return r6(M.pearson_loss(rows(spark, d)), "loss")


@query(
    "a36_signal_stats",
    f"WITH {ROWS} SELECT task, round(stddev_samp(target-pred), 3) AS residual_sd, round(stddev_samp(pred), 3) AS pred_sd, round(stddev_samp(target), 6) AS target_sd, round(sqrt(avg(pred*pred)), 3) AS pred_rms FROM l GROUP BY 1",
)
def a36(spark, d):
    out = M.signal_stats(rows(spark, d), ["task"])
    return out.withColumns({"residual_sd": F.round("residual_sd", 3), "pred_sd": F.round("pred_sd", 3), "target_sd": F.round("target_sd", 6), "pred_rms": F.round("pred_rms", 3)})


@query(
    "a38_composite_loss",
    f"WITH {ROWS}, s AS (SELECT parcel, {SUMS} FROM l GROUP BY 1) SELECT round(((SELECT avg((pred-target)*(pred-target)) FROM l) + 0.03e0 * (SELECT 1 - avg({_LOSS}) FROM s)) / 1e6, 4) AS loss",
)
def a38(spark, d):
    return M.composite_loss(rows(spark, d), "mse_pearson").withColumn("loss", F.round(F.col("loss") / 1e6, 4))


@query("a40_mean_parcel_map", f"WITH {ROWS}, m AS (SELECT parcel, avg(pred) AS mean FROM l GROUP BY 1) SELECT parcel, round(mean, 4) AS mean, round((SELECT max(abs(mean)) FROM m), 4) AS scale FROM m")
def a40(spark, d):
    return M.mean_parcel_map(rows(spark, d)).withColumns({"mean": F.round("mean", 4), "scale": F.round("scale", 4)})


@query(
    "p22_every_kth_parcel",
    f"WITH {ROWS} SELECT parcel, count(*) AS n FROM l WHERE parcel % (SELECT greatest(1, (max(parcel) + 1) // 4) FROM l) = 0 GROUP BY 1",
)
def p22(spark, d):
    return M.every_kth_parcel(rows(spark, d), 4).groupBy("parcel").agg(F.count(F.lit(1)).alias("n"))


