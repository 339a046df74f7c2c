"""Windows, frames and resampling on regular time grids.

All range conditions are turned into integer frame numbers first, so that every
join here is by equality.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridwise.functions.session import measured
from gridwise.operators.ordered import blocks, medians

TR, DELAY, WINDOW, STRIDE, HZ = 1.49, 4.47, 149.0, 149.0, 2.0


def segment_count(stop: Column, stride: float = STRIDE) -> Column:
    """max(1, ceil((stop + 1e-8) / stride)): windows that start before the stop."""
    return F.greatest(F.lit(1), F.ceil((stop + 1e-8) / stride)).cast("int")


def segment_windows(df: DataFrame, stop: str = "stop_s", duration: float = WINDOW, stride: float = STRIDE, delay: float = DELAY, drop_incomplete: bool = False, key: str = "stimulus_id") -> DataFrame:
    """df with segment_idx, segment_id, segment_start_s, segment_duration_s: windows from -delay on."""
    end = F.col(stop) - (duration if drop_incomplete else 0.0)
    k = F.explode(F.sequence(F.lit(0), segment_count(end, stride) - 1)).alias("segment_idx")
    out = df.select("*", k)
    return out.withColumns({
        "segment_id": F.format_string("%s@seg%03d", F.col(key), F.col("segment_idx")), "segment_start_s": F.col("segment_idx") * stride - delay, "segment_duration_s": F.lit(duration),
    })


def inference_windows(df: DataFrame, duration: str = "duration_s", window: float = WINDOW, delay: float = DELAY) -> DataFrame:
    """Another rule than segment_windows: max(1, ceil((duration + delay) / window)) windows."""
    n = F.greatest(F.lit(1), F.ceil((F.col(duration) + delay) / window)).cast("int")
    return df.select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias("segment_idx")).withColumn("segment_start_s", F.col("segment_idx") * window - delay)


def align(features: DataFrame, times: DataFrame, hz: float, linear: bool = True, keys: Sequence[str] = ("item",)) -> DataFrame:
    """(keys..., t, value): features (keys..., frame, value) at times (keys..., t).

    Linear: between frames int(t hz) and the next; before the first and past the last frame their values. Nearest: the frame at
    round(t hz), halves to even, within the item.
    """
    keys = list(keys)
    last = features.groupBy(*keys).agg(F.max("frame").alias("__last"))
    at = times.join(measured(last), keys).withColumn("__x", F.col("t") * hz)
    if not linear:
        near = at.withColumn("frame", F.least(F.greatest(F.rint("__x").cast("int"), F.lit(0)), F.col("__last")))
        return near.hint("merge").join(features, [*keys, "frame"]).select(*keys, "t", "value")
    low = F.when(F.col("__x").cast("int") < 0, 0).otherwise(F.least(F.col("__x").cast("int"), F.col("__last")))
    flat = (F.col("__x").cast("int") < 0) | (F.col("__x").cast("int") >= F.col("__last"))
    at = at.withColumns({"__lo": low, "__w": F.when(flat, 0.0).otherwise(F.col("__x") - low)}).withColumn("__hi", F.least(F.col("__lo") + 1, F.col("__last")))
    a = features.select(*keys, F.col("frame").alias("__lo"), F.col("value").alias("__a"))
    b = features.select(*keys, F.col("frame").alias("__hi"), F.col("value").alias("__b"))
    both = at.hint("merge").join(a, [*keys, "__lo"]).hint("merge").join(b, [*keys, "__hi"])
    return both.select(*keys, "t", (F.col("__a") * (1 - F.col("__w")) + F.col("__b") * F.col("__w")).alias("value"))


def _lengths(features: DataFrame, keys: list[str]) -> DataFrame:
    return features.groupBy(*keys).agg((F.max("frame") + 1).alias("__n"))


def resample_nearest(features: DataFrame, n_out: int | Column, keys: Sequence[str] = ("item",)) -> DataFrame:
    """(keys..., frame, value) with n_out frames each: output i takes input floor(i n_in / n_out)."""
    keys = list(keys)
    n_out = F.lit(n_out) if isinstance(n_out, int) else n_out
    out = _lengths(features, keys).withColumn("__m", n_out).select(*keys, "__n", "__m", F.explode(F.sequence(F.lit(0), F.col("__m") - 1)).alias("__i"))
    out = out.withColumn("frame", F.floor(F.col("__i") * F.col("__n") / F.col("__m")).cast("int"))
    return out.hint("merge").join(features, [*keys, "frame"]).select(*keys, F.col("__i").alias("frame"), "value")


def adaptive_average(features: DataFrame, n_out: int, keys: Sequence[str] = ("item",)) -> DataFrame:
    """Bin i is the mean of the frames in [floor(i n / n_out), ceil((i + 1) n / n_out)); bins may overlap."""
    keys = list(keys)
    with_n = features.join(_lengths(features, keys), keys)
    # frame f lies in bins floor(f m / n) to ceil((f + 1) m / n) - 1
    low, high = F.floor(F.col("frame") * n_out / F.col("__n")), F.ceil((F.col("frame") + 1) * n_out / F.col("__n")) - 1
    bins = with_n.select(*keys, F.explode(F.sequence(low.cast("int"), high.cast("int"))).alias("bin"), "value")
    return bins.groupBy(*keys, "bin").agg(F.avg("value").alias("value"))


def fir_filter(features: DataFrame, kernel: Sequence[float], keys: Sequence[str] = ("item",)) -> DataFrame:
    """Cross-correlation with an odd kernel, zeros outside, same length."""
    if len(kernel) % 2 == 0:
        raise ValueError("the kernel must have an odd length")
    by, half = W.partitionBy(*keys, "__block").orderBy("__n"), len(kernel) // 2
    terms = [F.lit(float(k)) * F.coalesce(F.lag("value", half - i).over(by) if half >= i else F.lead("value", i - half).over(by), F.lit(0.0)) for i, k in enumerate(kernel)]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return blocks(features, keys, ["frame"], half, half).withColumn("value", out).filter("__own").select(*features.columns)


def frame_grid(df: DataFrame, duration: str = "duration_s", hz: float = HZ) -> DataFrame:
    """df with frame and t_s: max(1, round(duration hz)) frames, halves to even."""
    n = F.greatest(F.lit(1), F.rint(F.col(duration) * hz)).cast("int")
    return df.select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias("frame")).withColumn("t_s", F.col("frame") / hz)


def step_cutoffs(df: DataFrame, duration: str = "duration_s", hz: float = HZ) -> DataFrame:
    """df with step and cutoff_s = min(duration, (step + 1) / hz)."""
    n = F.greatest(F.lit(1), F.rint(F.col(duration) * hz)).cast("int")
    return df.select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias("step")).withColumn("cutoff_s", F.least(F.col(duration), (F.col("step") + 1) / hz))


def row_time(start: Column, tr_idx: Column, delay: float = DELAY, tr: float = TR) -> Column:
    return start + delay + tr_idx * tr


def infer_duration(frames: DataFrame, hz: float = HZ, keys: Sequence[str] = ("item",)) -> DataFrame:
    """Last time of any stream; frames / hz where that is zero."""
    out = frames.groupBy(*keys).agg(F.max("t_s").alias("m"), F.max("frame").alias("f"))
    return out.select(*keys, F.coalesce(F.when(F.col("m") > 0, F.col("m")), (F.col("f") + 1) / hz).alias("duration_s"))


def zero_features(df: DataFrame, n_layers: int, dim: int) -> DataFrame:
    """df (with frame) times n_layers, with zero vectors."""
    layer = F.explode(F.sequence(F.lit(0), F.lit(n_layers - 1))).alias("layer")
    return df.select("*", layer).withColumn("vec", F.array_repeat(F.lit(0.0).cast("float"), dim))


def infer_rate(times: DataFrame, keys: Sequence[str] = ("item",), t: str = "t_s", default: float = HZ) -> DataFrame:
    """(keys..., hz): 1 / median step; the default with fewer than two times or a step that is not positive."""
    by = W.partitionBy(*keys, "__block").orderBy("__n")
    steps = blocks(times.select(*keys, t), keys, [t], back=1).withColumn("__d", F.col(t) - F.lag(t).over(by)).filter("__own")
    step = medians(steps.select(*keys, "__d"), keys, "__d", "__m")
    return step.select(*keys, F.when(F.col("__m") > 0, 1 / F.col("__m")).otherwise(default).alias("hz"))


def chunk_ranges(df: DataFrame, duration: str = "duration_s", chunk: float = 60.0, least: float = 30.0) -> DataFrame:
    """df with chunk_idx, start_s, stop_s: stretches of ``chunk``; a rest under ``least`` joins the last one."""
    n = F.greatest(F.lit(1), F.ceil(F.col(duration) / chunk)).cast("int")
    rest = F.col(duration) - (n - 1) * chunk
    n = F.when((n > 1) & (rest < least), n - 1).otherwise(n)
    out = df.withColumn("__n", n).select("*", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)).alias("chunk_idx"))
    stop = F.when(F.col("chunk_idx") == F.col("__n") - 1, F.col(duration)).otherwise((F.col("chunk_idx") + 1) * chunk)
    return out.withColumns({"start_s": F.col("chunk_idx") * chunk, "stop_s": stop}).drop("__n")


def window_frames(segments: DataFrame, features: DataFrame, item: str = "item", hz: float = HZ, value: str = "value") -> DataFrame:
    """Every window's n = max(1, round(duration hz)) frames of its item, zeros where the item has none.

    segments: (item, segment_idx, segment_start_s, segment_duration_s); features: (item, frame, value). The source frame of output
    frame k is round(start hz) + k, an integer, so the join is by equality.
    """
    n = F.greatest(F.lit(1), F.rint(F.col("segment_duration_s") * hz)).cast("int")
    grid = segments.select(item, "segment_idx", F.rint(F.col("segment_start_s") * hz).cast("int").alias("__i0"), F.explode(F.sequence(F.lit(0), n - 1)).alias("dst"))
    grid = grid.withColumn("frame", F.col("__i0") + F.col("dst"))
    return grid.hint("merge").join(features.select(item, "frame", value), [item, "frame"], "left").select(item, "segment_idx", "dst", F.coalesce(value, F.lit(0.0)).alias(value))


def window_bold(segments: DataFrame, bold: DataFrame, item: str = "item", tr: float = TR, delay: float = DELAY, value: str = "value") -> DataFrame:
    """Every window's n = round(duration / tr) volumes from round((start + delay) / tr) on, zeros where there are none."""
    n = F.greatest(F.lit(1), F.rint(F.col("segment_duration_s") / tr)).cast("int")
    grid = segments.select(item, "segment_idx", F.rint((F.col("segment_start_s") + delay) / tr).cast("int").alias("__i0"), F.explode(F.sequence(F.lit(0), n - 1)).alias("dst"))
    grid = grid.withColumn("tr", F.col("__i0") + F.col("dst"))
    return grid.hint("merge").join(bold.select(item, "tr", value), [item, "tr"], "left").select(item, "segment_idx", "dst", F.coalesce(value, F.lit(0.0)).alias(value))


def align_modalities(segments: DataFrame, streams: dict[str, DataFrame], bold: DataFrame, item: str = "item") -> DataFrame:
    """Per window and volume: each stream's frame at the volume's time, and the recorded value; items without a stream are left out."""
    for s in streams.values():
        segments = segments.hint("merge").join(s.select(item).distinct(), item, "left_semi")
    out = window_bold(segments, bold, item).withColumnRenamed("value", "bold")
    for name, s in streams.items():
        frames = window_frames(segments, s, item).select(item, "segment_idx", F.col("dst").alias("__f"), F.col("value").alias(name))
        out = out.withColumn("__f", F.floor(F.col("dst") * TR * HZ).cast("int")).hint("merge").join(frames, [item, "segment_idx", "__f"], "left").drop("__f")
    return out


def optional_stream(items: DataFrame, stream: DataFrame, required: Column, item: str = "item", value: str = "value") -> DataFrame:
    """Left join; a missing value is zero where the stream is not required, and an error where it is."""
    absent = F.when(required, F.raise_error(F.concat(F.lit("no features for "), F.col(item).cast("string"))).cast("double")).otherwise(0.0)
    return items.join(stream, item, "left").withColumn(value, F.coalesce(value, absent))


def global_tr(segment: Column, tr_idx: Column, per_window: int = 100) -> Column:
    return segment * per_window + tr_idx


def trim_to_count(rows: DataFrame, expected: DataFrame, keys: Sequence[str], tr: str = "tr") -> DataFrame:
    """First n_trs rows (by number) of each key; a key with fewer is an error."""
    have = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__have")).join(expected, list(keys))
    short = F.raise_error(F.concat(F.lit("too few rows for "), F.concat_ws("/", *[F.col(k).cast("string") for k in keys]))).cast("long")
    n = have.select(*keys, F.when(F.col("__have") < F.col("n_trs"), short).otherwise(F.col("n_trs").cast("long")).alias("__n"))
    return rows.join(n, list(keys)).filter(F.col(tr) < F.col("__n")).drop("__n")


def trim_to_duration(rows: DataFrame, duration: Column, tr: str = "tr", step: float = TR) -> DataFrame:
    """Rows below max(1, round(duration / step)); all of them where the duration is not positive."""
    return rows.filter((duration <= 0) | (F.col(tr) < F.greatest(F.lit(1.0), F.rint(duration / step))))


def last_k(rows: DataFrame, keys: Sequence[str], order: str, k: int) -> DataFrame:
    by = W.partitionBy(*keys).orderBy(F.col(order).desc())
    return rows.withColumn("__n", F.row_number().over(by)).filter(F.col("__n") <= k).drop("__n")


def examples(rows: DataFrame, known: DataFrame, key: str, shown: int = 5) -> DataFrame:
    """The first few keys of rows, in order, that known has not (a bounded report)."""
    return rows.join(known, key, "left_anti").select(key).orderBy(key).limit(shown)
