"""Streaming queries: files of the tables are the source; results equal the batch ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridwise.plans.catalog import query, table
from gridwise.plans.q_metrics import EV, ROWS, SUMS, R
from gridwise.plans.q_store import folder
from gridwise.streaming import scores as S
from gridwise.streaming import timed


def source(spark, d, name):
    """A file stream of a table, whether it is one file or a folder of files."""
    schema = table(spark, d, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).parquet(f"{d}/{name}.parq[u]et")


def _scored(spark, d):
    return source(spark, d, "lineitem").select(F.col("l_suppkey").alias("parcel"), F.col("l_extendedprice").alias("pred"), F.col("l_quantity").alias("target"))


@query("st1_stream_pearson_ev", f"WITH {ROWS}, s AS (SELECT parcel, {SUMS} FROM l GROUP BY 1) SELECT parcel, round({R}, 6) AS r, round({EV}, 3) AS ev FROM s")
def st1(spark, d):
    root = folder(spark)
    state = S.moment_table(_scored(spark, d), ["parcel"], f"{root}/sums", f"{root}/state").read()
    return S.finish_scores(state, ["parcel"]).select("parcel", F.round("r", 6).alias("r"), F.round("ev", 3).alias("ev"))


@query("st2_stream_weighted_mean", "SELECT l_returnflag, round(coalesce(sum(l_extendedprice*l_discount) FILTER (l_discount > 0) / nullif(sum(l_discount) FILTER (l_discount > 0), 0), 0), 4) AS mean FROM lineitem GROUP BY 1")
def st2(spark, d):
    root = folder(spark)
    sums = S.weighted_mean_table(source(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_discount", f"{root}/sums", f"{root}/state")
    return S.finish_mean(sums.read(), ["l_returnflag"]).withColumn("mean", F.round("mean", 4))


_CLOSED = "b <= (SELECT epoch(max(ts)) - 3600 FROM events)"


def _segments(spark, d, duration, slide=None):
    out = S.stream_segments(source(spark, d, "events"), "ts", "value", ["event_type"], duration, slide, "10 minutes")
    root = folder(spark)
    done = S.drain_to(out, f"{root}/out", f"{root}/state")
    return done.select("event_type", F.unix_timestamp("start").alias("start_s"), "n", F.round("total", 4).alias("total"))


@query(
    "st3_stream_tumbling_segments",
    f"WITH e AS (SELECT event_type, value, ((epoch_us(ts) // 1000000) - 600) // 7200 * 7200 + 600 AS a FROM events), w AS (SELECT event_type, a, a + 7200 AS b, count(*) AS n, round(sum(value), 4) AS total FROM e GROUP BY 1, 2, 3) SELECT event_type, a AS start_s, n, total FROM w WHERE {_CLOSED}",
)
def st3(spark, d):
    return _segments(spark, d, "2 hours")


@query(
    "st3_stream_sliding_segments",
    f"WITH e AS (SELECT event_type, value, ((epoch_us(ts) // 1000000) - 600) // 3600 * 3600 + 600 - k * 3600 AS a FROM events, range(2) t(k)), w AS (SELECT event_type, a, a + 7200 AS b, count(*) AS n, round(sum(value), 4) AS total FROM e GROUP BY 1, 2, 3) SELECT event_type, a AS start_s, n, total FROM w WHERE {_CLOSED}",
)
def st3_sliding(spark, d):
    return _segments(spark, d, "2 hours", "1 hour")


#: Words wait in steps of an hour; a step is answered when the watermark, an hour behind the newest row, has passed its end.
_ANSWERED = "(epoch_us(ts) // 3600000000 + 1) * 3600 <= (SELECT epoch_us(max(ts)) // 1000 / 1e3 - 3600 FROM events)"


@query(
    "st4_stream_causal_last_n",
    f"""WITH e AS (SELECT user_id AS item, ts, event_type AS word, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type) AS n FROM events WHERE event_type <> 'error'), c AS (SELECT event_id, user_id AS item, ts FROM events WHERE event_type = 'error' AND {_ANSWERED}),
k AS (SELECT event_id, c.item, c.ts, coalesce(max(n), 0) AS n FROM c LEFT JOIN e ON e.item = c.item AND e.ts <= c.ts GROUP BY 1, 2, 3)
SELECT k.item, epoch_us(k.ts) / 1e6 AS t, coalesce(string_agg(word, ' ' ORDER BY e.n), '') AS text FROM k LEFT JOIN e ON e.item = k.item AND e.n <= k.n AND e.n > k.n - 3 GROUP BY k.event_id, 1, 2""",
)
def st4(spark, d):
    e = source(spark, d, "events").select(F.col("user_id").alias("item"), "ts", F.col("event_type").alias("word"), (F.col("event_type") == "error").alias("is_cutoff"))
    root = folder(spark)
    done = S.drain_to(timed.last_words(e, 3, step_ms=3_600_000, keep_ms=3650 * 86_400_000), f"{root}/out", f"{root}/state")
    return done.select("item", (F.unix_micros("ts") / 1e6).alias("t"), "text")


@query(
    "st5_stream_dedup_items",
    f"""WITH RECURSIVE e AS (SELECT user_id, event_type, epoch_us(ts) // 1000 AS ms FROM events WHERE {_ANSWERED}), g AS (SELECT user_id, event_type, min(ms) AS ms FROM e GROUP BY 1, 2
UNION ALL SELECT g.user_id, g.event_type, (SELECT min(ms) FROM e WHERE e.user_id = g.user_id AND e.event_type = g.event_type AND e.ms > g.ms + 86400000) AS ms FROM g WHERE g.ms IS NOT NULL)
SELECT user_id, event_type, ms FROM g WHERE ms IS NOT NULL""",
)
def st5(spark, d):
    """A user's event of a kind is given out once a day at most: the state of a pair ends a day after its last row."""
    root = folder(spark)
    out = timed.first_seen(source(spark, d, "events"), ["user_id", "event_type"], step_ms=3_600_000, horizon_ms=86_400_000)
    return S.drain_to(out, f"{root}/out", f"{root}/state").select("user_id", "event_type", F.unix_millis("ts").alias("ms"))


@query(
    "st6_late_data",
    f"""WITH e AS (SELECT event_type, value, event_id % 7 = 0 AS late, (epoch_us(ts) // 1000000 - 600) // 86400 * 86400 + 600 AS a, (epoch_us(ts) // 1000000 - 600) // 86400 * 86400 + 600 + 86400 AS b FROM events)
SELECT event_type, a AS start_s, count(*) AS n, round(sum(value), 4) AS total FROM e WHERE {_CLOSED} AND NOT (late AND b <= (SELECT epoch(max(ts)) - 3600 FROM events WHERE event_id % 7 <> 0)) GROUP BY 1, 2, b""",
)
def st6(spark, d):
    """A seventh of the rows comes in a second run: those whose window the watermark of the first has closed are dropped."""
    root = folder(spark)
    events = table(spark, d, "events")
    for late in (False, True):
        events.filter((F.col("event_id") % 7 == 0) == late).write.mode("append").parquet(f"{root}/in")
        out = S.stream_segments(spark.readStream.schema(events.schema).parquet(f"{root}/in"), "ts", "value", ["event_type"], "1 day", None, "10 minutes")
        done = S.drain_to(out, f"{root}/out", f"{root}/state")
    return done.select("event_type", F.unix_timestamp("start").alias("start_s"), "n", F.round("total", 4).alias("total"))
