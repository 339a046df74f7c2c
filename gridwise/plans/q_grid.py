"""Queries of time grids: documents are stimuli of n_chars / 10 seconds, events of a user are a signal."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridwise.operators import grid as G
from gridwise.operators import metrics as M
from gridwise.plans.catalog import query, table


def stimuli(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("stimulus_id"), (F.col("n_chars") / 10).alias("stop_s"))


def signal(spark, d):
    by = W.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select(F.col("user_id").alias("item"), (F.row_number().over(by) - 1).alias("frame"), "value")


SIGNAL = "s AS (SELECT user_id AS item, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, value FROM events), n AS (SELECT item, max(frame) + 1 AS n FROM s GROUP BY 1)"
_SEG = "seg AS (SELECT doc_id AS stimulus_id, n_chars / 10 AS stop_s, unnest(range(greatest(1, ceil((n_chars / 10 + 1e-8) / 149e0))::BIGINT)) AS segment_idx FROM documents)"


@query("r1_segment_windows", f"WITH {_SEG} SELECT stimulus_id, stop_s, segment_idx, printf('%d@seg%03d', stimulus_id, segment_idx) AS segment_id, round(segment_idx * 149e0 - 4.47e0, 6) AS segment_start_s, 149e0 AS segment_duration_s FROM seg")
def r1(spark, d):
    return G.segment_windows(stimuli(spark, d)).withColumn("segment_start_s", F.round("segment_start_s", 6))


@query("r2_inference_windows", "SELECT stimulus_id, stop_s, k AS segment_idx, round(k * 149e0 - 4.47e0, 6) AS segment_start_s FROM (SELECT doc_id AS stimulus_id, n_chars / 10 AS stop_s, unnest(range(greatest(1, ceil((n_chars / 10 + 4.47e0) / 149e0))::BIGINT)) AS k FROM documents)")
def r2(spark, d):
    return G.inference_windows(stimuli(spark, d), "stop_s").withColumn("segment_start_s", F.round("segment_start_s", 6))


_TIMES = "t AS (SELECT item, frame * 0.7e0 - 0.4e0 AS t FROM s)"


def _times(spark, d):
    return signal(spark, d).select("item", (F.col("frame") * 0.7 - 0.4).alias("t"))


@query(
    "r3_align_linear",
    f"""WITH {SIGNAL}, {_TIMES}, p AS (SELECT item, t, n - 1 AS last, trunc(t * 2e0)::BIGINT AS k, t * 2e0 AS x FROM t JOIN n USING (item)),
q AS (SELECT *, CASE WHEN k < 0 THEN 0 ELSE least(k, last) END AS lo, CASE WHEN k < 0 OR k >= last THEN 0e0 ELSE x - k END AS w FROM p)
SELECT q.item, round(t, 6) AS t, round(a.value * (1 - w) + b.value * w, 6) AS value FROM q JOIN s a ON a.item = q.item AND a.frame = lo JOIN s b ON b.item = q.item AND b.frame = least(lo + 1, last)""",
)
def r3(spark, d):
    return G.align(signal(spark, d), _times(spark, d), 2.0).select("item", F.round("t", 6).alias("t"), F.round("value", 6).alias("value"))


@query("r4_align_nearest", f"WITH {SIGNAL}, {_TIMES} SELECT t.item, round(t, 6) AS t, value FROM t JOIN n USING (item) JOIN s ON s.item = t.item AND s.frame = least(greatest(round_even(t * 2e0, 0)::BIGINT, 0), n - 1)")
def r4(spark, d):
    return G.align(signal(spark, d), _times(spark, d), 2.0, linear=False).withColumn("t", F.round("t", 6))


@query("r5_resample_nearest", f"WITH {SIGNAL} SELECT n.item, i AS frame, value FROM n, range(50) t(i) JOIN s ON s.item = n.item AND s.frame = i * n // 50")
def r5(spark, d):
    return G.resample_nearest(signal(spark, d), 50)


@query("r6_adaptive_avg", f"WITH {SIGNAL} SELECT n.item, i AS bin, round(avg(value), 6) AS value FROM n, range(7) t(i) JOIN s ON s.item = n.item AND s.frame >= i * n // 7 AND s.frame < ((i + 1) * n + 6) // 7 GROUP BY 1, 2")
def r6(spark, d):
    return G.adaptive_average(signal(spark, d), 7).withColumn("value", F.round("value", 6))


@query("r7_fir_filter", f"WITH {SIGNAL} SELECT item, frame, round(0.25e0 * coalesce(lag(value) OVER w, 0) + 0.5e0 * value + 0.25e0 * coalesce(lead(value) OVER w, 0), 6) AS value FROM s WINDOW w AS (PARTITION BY item ORDER BY frame)")
def r7(spark, d):
    return G.fir_filter(signal(spark, d), [0.25, 0.5, 0.25]).withColumn("value", F.round("value", 6))


@query("r8_frame_grid", "SELECT stimulus_id, f AS frame, f / 2e0 AS t_s FROM (SELECT doc_id AS stimulus_id, unnest(range(greatest(1, round_even(n_chars / 10 * 2e0, 0))::BIGINT)) AS f FROM documents)")
def r8(spark, d):
    return G.frame_grid(stimuli(spark, d), "stop_s").select("stimulus_id", "frame", "t_s")


@query("r9_step_cutoffs", "SELECT stimulus_id, k AS step, least(s, (k + 1) / 2e0) AS cutoff_s FROM (SELECT doc_id AS stimulus_id, n_chars / 10 AS s, unnest(range(greatest(1, round_even(n_chars / 10 * 2e0, 0))::BIGINT)) AS k FROM documents)")
def r9(spark, d):
    return G.step_cutoffs(stimuli(spark, d), "stop_s").select("stimulus_id", "step", "cutoff_s")


@query("r10_row_time", f"WITH {_SEG} SELECT stimulus_id, segment_idx, tr_idx, round(segment_idx * 149e0 - 4.47e0 + 4.47e0 + tr_idx * 1.49e0, 6) AS fmri_time_s FROM seg, range(100) t(tr_idx)")
def r10(spark, d):
    seg = G.segment_windows(stimuli(spark, d)).select("stimulus_id", "segment_idx", "segment_start_s", F.explode(F.sequence(F.lit(0), F.lit(99))).alias("tr_idx"))
    return seg.select("stimulus_id", "segment_idx", "tr_idx", F.round(G.row_time(F.col("segment_start_s"), F.col("tr_idx")), 6).alias("fmri_time_s"))


@query("r11_infer_duration", f"WITH {SIGNAL} SELECT item, CASE WHEN max(frame) > 1 THEN (max(frame) - 1) / 2e0 ELSE (max(frame) + 1) / 2e0 END AS duration_s FROM s GROUP BY 1")
def r11(spark, d):
    return G.infer_duration(signal(spark, d).withColumn("t_s", (F.col("frame") - 1) / 2))


@query("r12_zero_features", f"WITH {SIGNAL} SELECT item, frame, layer, 0e0 AS total FROM s, range(2) t(layer)")
def r12(spark, d):
    return G.zero_features(signal(spark, d).select("item", "frame"), 2, 4).select("item", "frame", "layer", F.aggregate("vec", F.lit(0.0), lambda a, x: a + x).alias("total"))


_SECONDS = "epoch_us(ts) / 1e6"


@query("w7_infer_rate", f"WITH t AS (SELECT user_id AS item, {_SECONDS} - lag({_SECONDS}) OVER (PARTITION BY user_id ORDER BY ts) AS d FROM events) SELECT item, round(CASE WHEN median(d) > 0 THEN 1 / median(d) ELSE 2e0 END, 6) AS hz FROM t GROUP BY 1")
def w7(spark, d):
    t = table(spark, d, "events").select(F.col("user_id").alias("item"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t_s"))
    return G.infer_rate(t).withColumn("hz", F.round("hz", 6))


@query(
    "w8_chunk_ranges",
    """WITH a AS (SELECT doc_id AS stimulus_id, n_chars / 10 AS s, greatest(1, ceil(n_chars / 10 / 60e0))::BIGINT AS n FROM documents), b AS (SELECT stimulus_id, s, CASE WHEN n > 1 AND s - (n - 1) * 60e0 < 30 THEN n - 1 ELSE n END AS n FROM a)
SELECT stimulus_id, k AS chunk_idx, k * 60e0 AS start_s, CASE WHEN k = n - 1 THEN s ELSE (k + 1) * 60e0 END AS stop_s FROM (SELECT *, unnest(range(n)) AS k FROM b)""",
)
def w8(spark, d):
    return G.chunk_ranges(stimuli(spark, d), "stop_s").select("stimulus_id", "chunk_idx", "start_s", "stop_s")


def _signal_windows(spark, d):
    s = signal(spark, d)
    ends = s.groupBy("item").agg((F.max("frame") + 1).alias("n"))
    return G.segment_windows(ends.withColumn("stop_s", F.col("n") / 2), duration=29.8, stride=29.8, key="item").drop("n", "stop_s"), s


_WIN = f"WITH {SIGNAL}, w AS (SELECT item, unnest(range(greatest(1, ceil((n / 2e0 + 1e-8) / 29.8e0))::BIGINT)) AS k FROM n)"


@query("j1_window_features", f"{_WIN}, g AS (SELECT item, k AS segment_idx, dst, round_even((k * 29.8e0 - 4.47e0) * 2e0, 0)::BIGINT + dst AS src FROM w, range(60) t(dst)) SELECT g.item, segment_idx, dst, coalesce(value, 0e0) AS value FROM g LEFT JOIN s ON s.item = g.item AND s.frame = src")
def j1(spark, d):
    seg, s = _signal_windows(spark, d)
    return G.window_frames(seg, s)


_BOLD = "SELECT g.item, segment_idx, dst, coalesce(value, 0e0) AS value FROM (SELECT item, k AS segment_idx, dst, round_even((k * 29.8e0 - 4.47e0 + 4.47e0) / 1.49e0, 0)::BIGINT + dst AS src FROM w, range(20) t(dst)) g LEFT JOIN s ON s.item = g.item AND s.frame = src"


@query("j2_window_bold", f"{_WIN} {_BOLD}")
def j2(spark, d):
    seg, s = _signal_windows(spark, d)
    return G.window_bold(seg, s.withColumnRenamed("frame", "tr"))


@query(
    "j3_align_modalities",
    f"""{_WIN}, f AS (SELECT item, k, dst, coalesce(value, 0e0) AS value FROM (SELECT item, k, dst, round_even((k * 29.8e0 - 4.47e0) * 2e0, 0)::BIGINT + dst AS src FROM w, range(60) t(dst)) g LEFT JOIN s USING (item) WHERE s.frame = src
UNION ALL SELECT item, k, dst, 0e0 FROM (SELECT item, k, dst, round_even((k * 29.8e0 - 4.47e0) * 2e0, 0)::BIGINT + dst AS src FROM w, range(60) t(dst)) g WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.item = g.item AND s.frame = src)),
b AS ({_BOLD}) SELECT b.item, segment_idx, b.dst, b.value AS bold, f.value AS audio, 2 * f.value AS vision FROM b LEFT JOIN f ON f.item = b.item AND f.k = segment_idx AND f.dst = floor(b.dst * 1.49e0 * 2e0)::BIGINT""",
)
def j3(spark, d):
    seg, s = _signal_windows(spark, d)
    return G.align_modalities(seg, {"audio": s, "vision": s.withColumn("value", 2 * F.col("value"))}, s.withColumnRenamed("frame", "tr"))


@query("j6_optional_text", "SELECT doc_id AS item, coalesce(quality, 0)::DOUBLE AS value FROM documents LEFT JOIN labels USING (doc_id)")
def j6(spark, d):
    items = table(spark, d, "documents").select(F.col("doc_id").alias("item"))
    return G.optional_stream(items, table(spark, d, "labels").select(F.col("doc_id").alias("item"), F.col("quality").cast("double").alias("value")), F.lit(False))


@query("t1_order_segments", f"WITH {_SEG} SELECT stimulus_id, segment_idx FROM seg ORDER BY 1, 2")
def t1(spark, d):
    return G.segment_windows(stimuli(spark, d)).select("stimulus_id", "segment_idx").orderBy("stimulus_id", "segment_idx")


@query("t2_concat_windows", f"{_WIN}, b AS ({_BOLD}) SELECT item, segment_idx * 20 + dst AS tr, value FROM b")
def t2(spark, d):
    return j2(spark, d).select("item", G.global_tr(F.col("segment_idx"), F.col("dst"), 20).alias("tr"), "value")


def _submission(spark, d):
    by = W.partitionBy("o_orderpriority", "o_orderstatus").orderBy("o_orderkey")
    return table(spark, d, "orders").select(F.col("o_orderpriority").alias("subject"), F.col("o_orderstatus").alias("chunk"), (F.row_number().over(by) - 1).alias("tr"), F.col("o_totalprice").alias("value"))


_SUB = "o AS (SELECT o_orderpriority AS subject, o_orderstatus AS chunk, row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY o_orderkey) - 1 AS tr, o_totalprice AS value FROM orders)"


@query("t3_trim_to_count", f"WITH {_SUB} SELECT o.* FROM o JOIN (SELECT subject, chunk, (count(*) * 3) // 4 AS n FROM o GROUP BY 1, 2) USING (subject, chunk) WHERE tr < n")
def t3(spark, d):
    rows = _submission(spark, d)
    expected = rows.groupBy("subject", "chunk").agg(F.floor(F.count(F.lit(1)) * 3 / 4).alias("n_trs"))
    return G.trim_to_count(rows, expected, ["subject", "chunk"])


@query("t4_trim_to_duration", f"WITH {_SUB} SELECT * FROM o WHERE tr < greatest(1e0, round_even(200e0 / 1.49e0, 0))")
def t4(spark, d):
    return G.trim_to_duration(_submission(spark, d), F.lit(200.0))


@query("t5_examples", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY 1 LIMIT 5")
def t5(spark, d):
    return G.examples(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id", 5)


@query("t6_last_k_frames", f"WITH {SIGNAL} SELECT item, frame, value FROM s JOIN n USING (item) WHERE frame >= n - 8")
def t6(spark, d):
    return G.last_k(signal(spark, d), ["item"], "frame", 8)


@query("w1_zscore", f"WITH {SIGNAL}, z AS (SELECT *, avg(value) OVER w AS m, stddev_samp(value) OVER w AS sd FROM s WINDOW w AS (PARTITION BY item)) SELECT item, frame, round((value - m) / CASE WHEN sd IS NULL OR sd < 1e-8 THEN 1 ELSE sd END, 6) AS z FROM z")
def w1(spark, d):
    return M.zscore(signal(spark, d), ["item"]).select("item", "frame", F.round("z", 6).alias("z"))
