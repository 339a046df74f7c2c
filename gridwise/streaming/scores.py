"""Structured Streaming forms of the running scores and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwise.functions.num import ratio
from gridwise.operators import metrics as M
from gridwise.streaming.results import SumTable
from gridwise.streaming.timed import rocksdb


#: Columns of metrics.sums, and of the sums that a weighted mean is read from.
MOMENTS, WEIGHED = ("n", "sx", "sy", "sxx", "syy", "sxy", "se", "see"), ("sw", "swv")


def moment_table(stream: DataFrame, keys: list[str], path: str, checkpoint: str) -> SumTable:
    """A table of moment sums by key that holds every batch of the stream once."""
    out = SumTable(stream.sparkSession, path, keys, MOMENTS)
    out.follow(stream, lambda df: M.sums(df, keys), checkpoint)
    return out


def finish_scores(state: DataFrame, keys: list[str]) -> DataFrame:
    return state.select(*keys, M.pearson_of_sums().alias("r"), M.explained_variance_of_sums().alias("ev"))


def weighted_mean_table(stream: DataFrame, keys: list[str], value: str, weight: str, path: str, checkpoint: str) -> SumTable:
    """A table of weights and weighted values by key that holds every batch of the stream once; weights that are not positive add nothing."""
    w = F.when((F.col(weight) > 0) & F.col(value).isNotNull(), F.col(weight).cast("double"))
    sums = lambda df: df.groupBy(*keys).agg(F.coalesce(F.sum(w), F.lit(0.0)).alias("sw"), F.coalesce(F.sum(F.col(value) * w), F.lit(0.0)).alias("swv"))
    out = SumTable(stream.sparkSession, path, keys, WEIGHED)
    out.follow(stream, sums, checkpoint)
    return out


def finish_mean(state: DataFrame, keys: list[str]) -> DataFrame:
    return state.select(*keys, F.coalesce(ratio(F.col("swv"), F.col("sw")), F.lit(0.0)).alias("mean"))


def stream_segments(stream: DataFrame, ts: str, value: str, keys: list[str], duration: str, slide: str | None = None, start: str = "0 seconds", late: str = "1 hour") -> DataFrame:
    """(keys..., start, stop, n, total): tumbling or sliding windows with an offset; later rows than ``late`` are dropped."""
    marked = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    w = F.window(ts, duration, slide, start) if slide else F.window(ts, duration, startTime=start)
    out = marked.groupBy(*keys, w).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(*keys, F.col("window.start").alias("start"), F.col("window.end").alias("stop"), "n", "total")


def drain_to(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs a stream over all that its source has now into Parquet (append mode), and reads it back."""
    with rocksdb(stream.sparkSession):
        q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
