"""Scores of predictions against targets: mergeable sums first, one expression over them last.

Rows are (keys..., pred, target). Every score is one partial/final aggregation;
rows with a null pred or target are left out.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwise.functions.num import clamp, finite, ratio
from gridwise.functions.session import measured
from gridwise.operators import losses

EPS = 1e-8


def sums(df: DataFrame, keys: Sequence[str], pred: str = "pred", target: str = "target") -> DataFrame:
    """The mergeable state of the moment scores: n, sx, sy, sxx, syy, sxy, se, see by keys."""
    x, y = F.col(pred).cast("double"), F.col(target).cast("double")
    aggs = [
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"),
        F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy"), F.sum(y - x).alias("se"), F.sum((y - x) * (y - x)).alias("see"),
    ]
    return df.filter(x.isNotNull() & y.isNotNull()).groupBy(*keys).agg(*aggs)


def merge_sums(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    return states.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy", "se", "see")])


def pearson_of_sums() -> Column:
    """Clamped correlation: 0 for no rows and for a constant side, within [-1, 1]."""
    n, x, y = F.col("n"), F.col("sx"), F.col("sy")
    side = lambda a, s: F.sqrt(clamp(n * F.col(a) - s * s, 0.0))
    r = (n * F.col("sxy") - x * y) / clamp(side("sxx", x) * side("syy", y), EPS)
    return F.when(n > 0, clamp(r, -1.0, 1.0)).otherwise(0.0)


def explained_variance_of_sums() -> Column:
    n = F.col("n")
    left = n * F.col("see") - F.col("se") * F.col("se")
    return clamp(1 - left / clamp(n * F.col("syy") - F.col("sy") * F.col("sy"), EPS), high=1.0)


def strict_pearson_of_sums() -> Column:
    """Correlation that is NULL where a side is constant."""
    n = F.col("n")
    xx, yy = n * F.col("sxx") - F.col("sx") * F.col("sx"), n * F.col("syy") - F.col("sy") * F.col("sy")
    return F.when((xx > 0) & (yy > 0), ratio(n * F.col("sxy") - F.col("sx") * F.col("sy"), F.sqrt(xx * yy)))


def pearson_per_parcel(df: DataFrame, keys: Sequence[str] = ("parcel",)) -> DataFrame:
    return sums(df, keys).select(*keys, F.col("n").cast("long").alias("n"), pearson_of_sums().alias("r"))


def explained_variance(df: DataFrame, keys: Sequence[str] = ("parcel",)) -> DataFrame:
    return sums(df, keys).select(*keys, explained_variance_of_sums().alias("ev"))


def grouped_scores(df: DataFrame, groups: Sequence[str], parcel: str = "parcel") -> DataFrame:
    """Macro means: scores by (group, parcel), averaged over parcels; all groupings in one pass.

    Returns (grouping, value, r, ev), grouping being 'all' or a name in groups; null group values are left out.
    """
    sets = F.explode(F.array(F.struct(F.lit("all").alias("grouping"), F.lit("").alias("value")), *[F.struct(F.lit(g).alias("grouping"), F.col(g).cast("string").alias("value")) for g in groups]))
    # sums by all groups together come first, so that the fan-out is over sums and not over rows
    first = sums(df, [*groups, parcel])
    merged = merge_sums(first.select("*", sets.alias("s")).select("*", "s.*").filter("value is not null"), ["grouping", "value", parcel])
    scored = merged.select("grouping", "value", pearson_of_sums().alias("r"), explained_variance_of_sums().alias("ev"))
    return scored.groupBy("grouping", "value").agg(F.avg("r").alias("r"), F.avg("ev").alias("ev"))


def macro_mean(scores: DataFrame) -> DataFrame:
    """Mean over the values of each grouping of grouped_scores."""
    return scores.groupBy("grouping").agg(F.avg("r").alias("r"), F.avg("ev").alias("ev"))


def weighted_mean(df: DataFrame, keys: Sequence[str], value: str, weight: str) -> DataFrame:
    """Mean weighted by positive weights; 0 where there are none."""
    w = F.when((F.col(weight) > 0) & F.col(value).isNotNull(), F.col(weight).cast("double"))
    return df.groupBy(*keys).agg(F.coalesce(ratio(F.sum(F.col(value) * w), F.sum(w)), F.lit(0.0)).alias("mean"))


def pearson_two_pass(df: DataFrame, keys: Sequence[str] = ("parcel",)) -> DataFrame:
    """Centred correlation, NULL where a side is constant: a second pass over the rows, joined to their means."""
    keys = list(keys)
    rows = df.filter("pred is not null and target is not null").select(*keys, F.col("pred").cast("double").alias("x"), F.col("target").cast("double").alias("y"))
    means = rows.groupBy(*keys).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    c = rows.join(means, keys).select(*keys, (F.col("x") - F.col("mx")).alias("x"), (F.col("y") - F.col("my")).alias("y"))
    out = c.groupBy(*keys).agg(F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("y") * F.col("y")).alias("yy"))
    return out.select(*keys, ratio(F.col("xy"), F.sqrt(F.col("xx") * F.col("yy"))).alias("r"))


def report_arrays(df: DataFrame) -> DataFrame:
    """(subject, parcel, r): strict correlations by parcel (subject NULL) and by subject and parcel."""
    by_both = sums(df, ["subject", "parcel"])
    whole = merge_sums(by_both, ["parcel"]).select(F.lit(None).cast(df.schema["subject"].dataType).alias("subject"), "parcel", strict_pearson_of_sums().alias("r"))
    return whole.union(by_both.select("subject", "parcel", strict_pearson_of_sums().alias("r")))


#: Gap to a reference mean that is still accepted.
TOLERANCE = 0.02


def report_columns(value: str = "r") -> list[Column]:
    """Mean, median, linear 10 and 90 percentiles and count above zero of the finite scores of a group, to four places."""
    v = finite(F.col(value))
    four = lambda c, name: F.round(c, 4).alias(name)
    places = [four(F.percentile(v, F.lit(p)), name) for p, name in ((0.1, "p10"), (0.9, "p90"))]
    return [four(F.avg(v), "mean"), four(F.median(v), "median"), *places, F.count_if(v > 0).alias("n_positive")]


def run_report(scores: DataFrame, keys: Sequence[str] = (), value: str = "r") -> DataFrame:
    """(keys..., report_columns) of scores."""
    return scores.groupBy(*keys).agg(*report_columns(value))


def acceptance(report: DataFrame, reference: float | Column | None, tolerance: float | Column = TOLERANCE, value: str = "mean") -> DataFrame:
    """report with gap and verdict: PASS within the tolerance of the reference, FAIL beyond it or without a value; SKIPPED without a reference."""
    target = reference if isinstance(reference, Column) else F.lit(reference).cast("double")
    gap = F.abs(F.col(value) - target)
    verdict = F.when(target.isNull(), "SKIPPED").when(gap <= tolerance, "PASS").otherwise("FAIL")
    return report.withColumn("gap", gap).withColumn("verdict", verdict)


def mse(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    d = F.col("pred").cast("double") - F.col("target").cast("double")
    return df.groupBy(*keys).agg(F.avg(d * d).alias("mse"))


def pearson_loss(df: DataFrame, parcel: str = "parcel") -> DataFrame:
    """1 minus the mean over parcels of the correlation with clamped norms."""
    n = F.col("n")
    norm = lambda a, s: clamp(F.sqrt(clamp((n * F.col(a) - F.col(s) * F.col(s)) / n, 0.0)), EPS)
    r = (F.col("sxy") - F.col("sx") * F.col("sy") / n) / (norm("sxx", "sx") * norm("syy", "sy"))
    return sums(df, [parcel]).agg((1 - F.avg(r)).alias("loss"))


def signal_stats(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Sample deviations of residual, prediction and target over all cells."""
    x, y = F.col("pred").cast("double"), F.col("target").cast("double")
    return df.groupBy(*keys).agg(F.stddev_samp(y - x).alias("residual_sd"), F.stddev_samp(x).alias("pred_sd"), F.stddev_samp(y).alias("target_sd"), F.sqrt(F.avg(x * x)).alias("pred_rms"))


#: Terms that flat sums over (parcel, pred, target) give; the others need samples of vectors (losses.py).
LOSSES = {
    "mse": lambda df: mse(df).withColumnRenamed("mse", "v"),
    "pearson": lambda df: pearson_loss(df).withColumnRenamed("loss", "v"),
}


def composite_loss(df: DataFrame, name: str, weights: Mapping[str, float | None] | Sequence[float] | None = None, row: str | None = None) -> DataFrame:
    """One row (loss): the weighted sum of the named terms of losses.TERMS.

    df has rows (parcel, pred, target). Terms of similarity and alignment compare samples, so they need ``row``, the column that tells samples apart.
    """
    used = {t: w for t, w in losses.term_weights(name, weights).items() if w}
    if set(used) <= set(LOSSES):
        terms = [LOSSES[t](df).select((F.col("v") * w).alias("v")) for t, w in used.items()]
        return reduce(DataFrame.union, terms).agg(F.sum("v").alias("loss"))
    if row is None:
        raise ValueError(f"{name!r} compares samples: name the column that tells them apart")
    return losses.composite(losses.samples(df, row), name, weights).select("loss")


def mean_parcel_map(df: DataFrame) -> DataFrame:
    """(parcel, mean, scale): mean prediction of each parcel, and the largest absolute mean of all."""
    means = df.groupBy("parcel").agg(F.avg("pred").alias("mean"))
    top = means.agg(F.max(F.abs("mean")).alias("scale"))
    return means.crossJoin(F.broadcast(top))  # one row


def every_kth_parcel(df: DataFrame, most: int = 250, parcel: str = "parcel") -> DataFrame:
    """Every k-th parcel, k = max(1, parcels // most); parcels are numbered from 0."""
    count = df.agg(F.greatest(F.lit(1), F.floor((F.max(parcel) + 1) / most)).alias("__step"))
    return df.crossJoin(F.broadcast(count)).filter(F.pmod(F.col(parcel), F.col("__step")) == 0).drop("__step")  # one row


def zscore(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """df with z: standard scores by key (sample deviation; 1 where it is undefined or under EPS), by aggregation and join."""
    stats = df.groupBy(*keys).agg(F.avg(value).alias("__m"), F.stddev_samp(value).alias("__s"))
    sd = F.when(F.col("__s").isNull() | (F.col("__s") < EPS), 1.0).otherwise(F.col("__s"))
    return df.join(measured(stats), list(keys)).withColumn("z", (F.col(value) - F.col("__m")) / sd).drop("__m", "__s")
