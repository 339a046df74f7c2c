"""Layer selection and pooling, and linear scoring of vectors in Arrow batches.

Layered features are (item, frame, layer, vec array<float>).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwise.functions import special
from gridwise.functions.session import measured


def layer_indices(n: int, fractions: Sequence[float]) -> list[int]:
    """int(f (n - 1)) of each fraction, clipped, distinct, in order."""
    if n == 1:
        return [0]
    return sorted({min(n - 1, max(0, int(f * (n - 1)))) for f in fractions})


def select_layers(features: DataFrame, n: int, fractions: Sequence[float]) -> DataFrame:
    """Rows of the chosen layers, with layer_frac. The layers are literals, so that the scan prunes them."""
    out = features.filter(F.col("layer").isin(layer_indices(n, fractions)))
    return out.withColumn("layer_frac", F.col("layer") / F.lit(max(1, n - 1)))


@dataclass(frozen=True)
class Pooling:
    """How layers are pooled: selection 'fractions' or 'all'; aggregation None, 'mean', 'group_mean' or 'cat'."""

    selection: str = "fractions"
    fractions: tuple[float, ...] = (0.5, 0.75, 1.0)
    aggregation: str | None = None

    def __post_init__(self):
        if self.selection not in ("fractions", "all"):
            raise ValueError(f"unknown layer selection {self.selection!r}")
        if self.aggregation not in (None, "mean", "group_mean", "cat"):
            raise ValueError(f"unknown layer aggregation {self.aggregation!r}")
        if self.selection == "all" and self.aggregation not in (None, "mean"):
            raise ValueError("all layers can be kept or averaged only")

    def apply(self, features: DataFrame, n: int) -> DataFrame:
        if self.aggregation == "group_mean":
            return group_mean(features, n, self.fractions)
        chosen = features if self.selection == "all" else select_layers(features, n, self.fractions).drop("layer_frac")
        if self.aggregation == "mean":
            return layer_mean(chosen)
        return layer_cat(chosen) if self.aggregation == "cat" else chosen


def cast_saved(features: DataFrame, kind: str = "float") -> DataFrame:
    """vec as it is stored: source (as it is), float, double, or half: rounded to half precision and kept as float, which holds it."""
    if kind == "source":
        return features
    if kind == "half":
        return features.withColumn("vec", F.transform("vec", lambda x: special.half_precision(x).cast("float")))
    return features.withColumn("vec", F.transform("vec", lambda x: x.cast(kind)))


def _mean_of(features: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean vector by keys: partial sums by channel (map-side), then one array a key."""
    long = features.select(*keys, F.posexplode("vec").alias("ch", "x"))
    means = long.groupBy(*keys, "ch").agg(F.avg(F.col("x").cast("double")).alias("x"))
    pairs = F.sort_array(F.collect_list(F.struct("ch", "x")))  # one array of channels
    return means.groupBy(*keys).agg(F.transform(pairs, lambda p: p["x"]).alias("vec"))


def layer_mean(features: DataFrame) -> DataFrame:
    return _mean_of(features, ["item", "frame"]).withColumn("layer", F.lit(0))


def group_bounds(n: int, fractions: Sequence[float]) -> list[tuple[int, int, float]]:
    """(first, past the last, label) of the layer groups; the last group holds the top layer; labels are the last fractions as asked for."""
    idx = layer_indices(n, fractions)
    if len(idx) == 1:
        return [(idx[0], idx[0] + 1, list(fractions)[-1])]
    bounds = [*idx[:-1], idx[-1] + 1]
    labels = list(fractions)[-(len(bounds) - 1) :]
    return [(a, b, f) for a, b, f in zip(bounds, bounds[1:], labels, strict=False)]


def group_mean(features: DataFrame, n: int, fractions: Sequence[float]) -> DataFrame:
    """Mean over each layer group; layer is the group's number, layer_frac its label."""
    bounds = group_bounds(n, fractions)
    group, label = F.lit(None).cast("int"), F.lit(None).cast("double")
    for g, (a, b, f) in enumerate(bounds):
        inside = (F.col("layer") >= a) & (F.col("layer") < b)
        group, label = F.when(inside, g).otherwise(group), F.when(inside, float(f)).otherwise(label)
    grouped = features.withColumns({"__g": group, "layer_frac": label}).filter("__g is not null").drop("layer").withColumnRenamed("__g", "layer")
    return _mean_of(grouped, ["item", "frame", "layer", "layer_frac"])


def group_mean_equal(features: DataFrame, n: int, groups: int) -> DataFrame:
    if n % groups:
        raise ValueError(f"{n} layers can't be cut into {groups} equal groups")
    return _mean_of(features.withColumn("layer", F.floor(F.col("layer") / (n // groups)).cast("int")), ["item", "frame", "layer"])


def layer_cat(features: DataFrame) -> DataFrame:
    """Layers one after the other along the channels."""
    pairs = F.sort_array(F.collect_list(F.struct("layer", "vec")))  # the layers of one frame
    return features.groupBy("item", "frame").agg(F.flatten(F.transform(pairs, lambda p: p["vec"])).alias("vec")).withColumn("layer", F.lit(0))


def identity_layer(features: DataFrame) -> DataFrame:
    """features of one layer; a frame with more is an error."""
    bad = F.raise_error("more than one layer").cast("int")
    return features.withColumn("layer", F.when(F.col("layer") != 0, bad).otherwise(F.col("layer")))


PREDICTION_MODES = ("default", "full", "group_only")


def normalise_mode(mode: str | None) -> str:
    mode = mode or "default"
    if mode not in PREDICTION_MODES:
        raise ValueError(f"unknown prediction mode {mode!r}")
    return mode


def _matmul(df: DataFrame, subjects: dict | None, weight: np.ndarray | None, bias: np.ndarray | None, subject_col: str | None) -> DataFrame:
    """df with pred = vec W + b, plus vec W[s] + b[s] of the row's subject. The weights are parameters of fixed size."""
    schema = df.schema.jsonValue()
    from pyspark.sql import types as T

    names = df.columns
    out = T.StructType([*T.StructType.fromJson(schema).fields, T.StructField("pred", T.ArrayType(T.DoubleType()))])
    at, sub = names.index("vec"), names.index(subject_col) if subject_col else None

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = np.array(b.column(at).to_pylist(), dtype=np.float64)
            y = x @ weight + bias if weight is not None else np.zeros((len(x), next(iter(subjects.values()))[0].shape[1]))
            if subjects is not None:
                ids = np.array(b.column(sub).to_pylist())
                for s in np.unique(ids):
                    w, c = subjects[s.item()]
                    y[ids == s] += x[ids == s] @ w + c
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, y.shape[1]), pa.int32()), pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], [*names, "pred"])

    return df.mapInArrow(run, out)


def subject_linear(df: DataFrame, weights: dict, subject: str = "subject") -> DataFrame:
    """pred = vec W[s] + b[s]; weights: subject -> (W, b)."""
    return _matmul(df, weights, None, None, subject)


def group_linear(df: DataFrame, weight: np.ndarray, bias: np.ndarray) -> DataFrame:
    return _matmul(df, None, weight, bias, None)


def group_residual(df: DataFrame, weight: np.ndarray, bias: np.ndarray, weights: dict, mode: str | None = None, subject: str = "subject") -> DataFrame:
    """Group prediction plus the subject's residual; the group prediction alone in mode group_only."""
    if normalise_mode(mode) == "group_only":
        return group_linear(df, weight, bias)
    return _matmul(df, weights, weight, bias, subject)


def subject_linear_long(df: DataFrame, weights: DataFrame, keys: Sequence[str], subject: str = "subject") -> DataFrame:
    """The same in long form: weights (subject, ch, out, w), joined and summed. For weights that are a table."""
    x = df.select(*keys, subject, F.posexplode("vec").alias("ch", "x"))
    return x.hint("merge").join(weights, [subject, "ch"]).groupBy(*keys, subject, "out").agg(F.sum(F.col("x").cast("double") * F.col("w")).alias("pred"))


def project(df: DataFrame, weight: np.ndarray, bias: np.ndarray, layer_norm: bool = False, gelu: bool = False) -> DataFrame:
    """Affine map, then layer normalisation (eps 1e-5) and exact GELU if asked for, as array functions."""
    out = group_linear(df, weight, bias)
    if layer_norm:
        n = F.size("pred")
        mean = F.aggregate("pred", F.lit(0.0), lambda a, x: a + x) / n
        out = out.withColumn("__m", mean)
        var = F.aggregate("pred", F.lit(0.0), lambda a, x: a + (x - F.col("__m")) * (x - F.col("__m"))) / n
        out = out.withColumn("__s", F.sqrt(var + 1e-5)).withColumn("pred", F.transform("pred", lambda x: (x - F.col("__m")) / F.col("__s"))).drop("__m", "__s")
    if gelu:
        out = out.withColumn("pred", F.transform("pred", special.gelu))
    return out


def fuse(df: DataFrame, columns: Sequence[str], how: str = "cat") -> DataFrame:
    """df with vec: the modality vectors concatenated, or their elementwise mean or sum; columns are taken in sorted order."""
    columns = sorted(columns)
    if how == "cat":
        return df.withColumn("vec", F.concat(*columns))
    if how not in ("mean", "sum"):
        raise ValueError(f"unknown fusion {how!r}")
    out = F.col(columns[0])
    for c in columns[1:]:
        out = F.zip_with(out, F.col(c), lambda a, b: a + b)
    return df.withColumn("vec", F.transform(out, lambda x: x / len(columns)) if how == "mean" else out)


def static_expand(df: DataFrame, n_frames: int) -> DataFrame:
    """Features without time, repeated for every frame."""
    return df.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_frames - 1))).alias("frame"))


def with_subject_weights(rows: DataFrame, weights: DataFrame, subject: str = "subject") -> DataFrame:
    """rows with the columns of weights, one row a subject; rows of subjects without weights are left out."""
    return rows.join(measured(weights), subject)
