"""Ensembling: scores of members, softmax weights by parcel, blended predictions and their evaluation.

Member rows are (member, row_id, subject, parcel, pred, target), or packed: (row_id, subject, parcel, preds, target),
a row for all members, preds being an array of (member, pred).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridwise.functions.num import finite
from gridwise.functions.session import measured
from gridwise.operators import metrics as M

TEMPERATURE = 0.3


def member_scores(rows: DataFrame) -> DataFrame:
    """(member, subject, parcel, score) over the full grid: NULL with fewer than two rows or a constant side."""
    found = M.sums(rows, ["member", "subject", "parcel"]).select("member", "subject", "parcel", F.when(F.col("n") >= 2, M.strict_pearson_of_sums()).alias("score"))
    members, subjects = (F.broadcast(rows.select(c).distinct()) for c in ("member", "subject"))  # two short lists
    keys = rows.select("parcel").distinct().crossJoin(members).crossJoin(subjects)
    return keys.hint("merge").join(found, ["member", "subject", "parcel"], "left")


def softmax_weights(scores: DataFrame, keys: list[str], temperature: float = TEMPERATURE, score: str = "score") -> DataFrame:
    """scores with ``weight``: softmax over the members of each key; 0 for undefined scores, equal if all are undefined."""
    if temperature <= 0:
        raise ValueError("temperature must be positive")
    by = W.partitionBy(*keys)
    s = finite(F.col(score))
    e = F.exp((s - F.max(s).over(by)) / temperature)
    weight = F.when(F.count(s).over(by) == 0, 1 / F.count(F.lit(1)).over(by)).otherwise(F.coalesce(e, F.lit(0.0)) / F.sum(F.coalesce(e, F.lit(0.0))).over(by))
    return scores.withColumn("weight", weight)


def misaligned(rows: DataFrame, reference) -> DataFrame:
    """(member, row_id, subject, parcel) that differ from the reference member: missing, extra or with another target (1e-8 + 1e-5 relative)."""
    keys = ["row_id", "subject", "parcel"]
    ref = rows.filter(F.col("member") == reference).select(*keys, F.col("target").alias("want"), F.lit(True).alias("known"))
    members = F.broadcast(rows.filter(F.col("member") != reference).select("member").distinct())  # a short list
    want = ref.crossJoin(members)
    got = rows.filter(F.col("member") != reference).select("member", *keys, F.col("target").alias("got"), F.lit(True).alias("seen"))
    both = want.hint("merge").join(got, ["member", *keys], "full")
    close = F.col("want").eqNullSafe(F.col("got")) | (F.abs(F.col("got") - F.col("want")) <= 1e-8 + 1e-5 * F.abs("want"))
    return both.filter(F.col("known").isNull() | F.col("seen").isNull() | ~F.coalesce(close, F.lit(False))).select("member", *keys)


def missing_chunks(submissions: DataFrame, reference) -> DataFrame:
    """(member, subject, chunk, n_rows, n_expected): chunks of the reference that a member lacks or has in another length."""
    count = submissions.groupBy("member", "subject", "chunk").agg(F.count(F.lit(1)).alias("n_rows"))
    ref = count.filter(F.col("member") == reference).select("subject", "chunk", F.col("n_rows").alias("n_expected"))
    want = ref.crossJoin(F.broadcast(count.select("member").distinct()))
    return want.hint("merge").join(count, ["member", "subject", "chunk"], "left").filter("not (n_rows <=> n_expected)").select("member", "subject", "chunk", "n_rows", "n_expected")


def unpacked(rows: DataFrame) -> DataFrame:
    """Packed rows as a row a member; others as they are."""
    if "preds" not in rows.columns:
        return rows
    each = rows.select("row_id", "subject", "parcel", "target", F.explode("preds").alias("p"))
    return each.select("p.member", "row_id", "subject", "parcel", "p.pred", "target")


def blend(rows: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """(row_id, subject, parcel, pred, target): predictions summed with the weights of (member, keys...).

    Packed rows only meet their keys' weights: nothing is expanded, sent once more or grouped.
    """
    if "preds" not in rows.columns:
        both = rows.join(measured(weights.select("member", *keys, "weight")), ["member", *keys])
        return both.groupBy("row_id", "subject", "parcel").agg(F.sum(F.col("weight") * F.col("pred")).alias("pred"), F.min("target").alias("target"))
    held = weights.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("member", "weight"))).alias("weights"))  # a few members
    both = rows.join(measured(held), keys).filter(F.exists("preds", lambda p: F.map_contains_key("weights", p["member"])))
    terms = F.filter(F.transform("preds", lambda p: F.try_element_at("weights", p["member"]) * p["pred"]), lambda t: t.isNotNull())
    pred = F.when(F.size(terms) > 0, F.aggregate(terms, F.lit(0.0), lambda total, t: total + t))
    return both.select("row_id", "subject", "parcel", pred.alias("pred"), "target")


def evaluate(rows: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """One row: ensemble mean r, best single member, its mean and the difference."""
    strict = lambda df, by: M.sums(df, by).withColumn("r", M.strict_pearson_of_sums())
    single = strict(unpacked(rows), ["member", "parcel"]).groupBy("member").agg(F.avg("r").alias("r"))
    best = single.agg(F.max_by("member", "r").alias("best_member"), F.max("r").alias("best_r"))
    whole = strict(blend(rows, weights, keys), ["parcel"]).agg(F.avg("r").alias("ensemble_r"))
    return whole.crossJoin(F.broadcast(best)).withColumn("delta", F.col("ensemble_r") - F.col("best_r"))  # one row each


def per_subject(rows: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """(subject, r): mean over parcels of the blend's correlation, NULL with fewer than two rows."""
    scored = M.sums(blend(rows, weights, keys), ["subject", "parcel"]).withColumn("r", F.when(F.col("n") >= 2, M.strict_pearson_of_sums()))
    return scored.groupBy("subject").agg(F.avg("r").alias("r"))


def best_member(scores: DataFrame, score: str = "score", digits: int | None = None) -> DataFrame:
    """(member, mean): the member with the highest mean of finite scores; the smaller one of equals, which are compared after rounding to ``digits``."""
    mean = F.avg(finite(F.col(score)))
    means = scores.groupBy("member").agg((mean if digits is None else F.round(mean, digits)).alias("mean"))
    return means.orderBy(F.col("mean").desc_nulls_last(), "member").limit(1)


def subject_mean(predictions: DataFrame) -> DataFrame:
    """(chunk, tr, parcel, subject, pred): the mean over subjects, copied to every subject."""
    means = predictions.groupBy("chunk", "tr", "parcel").agg(F.avg("pred").alias("pred"))
    return means.crossJoin(F.broadcast(predictions.select("subject").distinct()))  # a short list
