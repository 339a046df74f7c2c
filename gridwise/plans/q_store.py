"""Queries of sources and sinks: what is written under the shared folder is read back."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridwise.functions import registry
from gridwise.functions.session import shared_folder
from gridwise.operators import layers as L
from gridwise.operators import metrics as scores
from gridwise.plans.catalog import query, table
from gridwise.plans.q_interval import TALK, talk
from gridwise.plans.q_layers import FEATURES, features, flat
from gridwise.plans.q_manifest import RUNS, runs
from gridwise.plans.q_metrics import EV, ROWS, STRICT, SUMS, R
from gridwise.plans.q_metrics import rows as scored_rows
from gridwise.sources import features as S
from gridwise.sources import manifests as M
from gridwise.sources import runs as run_store


def folder(spark) -> str:
    return f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"


def listing(spark, d):
    """File paths as a catalogue would list them."""
    docs = table(spark, d, "documents")
    ext = F.when(F.col("doc_id") % 3 == 0, "mkv").when(F.col("doc_id") % 3 == 1, "mp4").otherwise("tsv")
    chunk = F.format_string("s%02de%04d", F.pmod("doc_id", F.lit(8)), F.col("doc_id"))
    return docs.select(
        "doc_id", chunk.alias("chunk"), F.concat(F.lit("/data/"), F.when(F.col("lang") == "en", "friends").otherwise("movie10"), F.lit("/"), chunk, F.lit(".tsv")).alias("path"), F.concat(F.lit("/ood/m"), F.floor(F.col("doc_id") / 4).cast("string"), F.lit("."), ext).alias("ood")
    )


_LIST = "l AS (SELECT doc_id, printf('s%02de%04d', doc_id % 8, doc_id) AS chunk, lang, '/data/' || CASE lang WHEN 'en' THEN 'friends' ELSE 'movie10' END || '/' || printf('s%02de%04d', doc_id % 8, doc_id) || '.tsv' AS path FROM documents)"


@query(
    "s1_scan_run_manifest",
    f"""WITH {_LIST} SELECT subject, CASE lang WHEN 'en' THEN 'friends' ELSE 'movie10' END AS task, chunk, CASE lang WHEN 'en' THEN 'friends' ELSE 'movie10' END || '/' || chunk AS stimulus_id, path AS transcript_relpath,
CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'ses-' || subject || '_' || chunk END AS fmri_h5_key FROM l, (VALUES ('sub01'), ('sub02')) v(subject)""",
)
def s1(spark, d):
    files = listing(spark, d)
    subjects = spark.createDataFrame([("sub01",), ("sub02",)], "subject string")
    keys = files.filter("doc_id % 5 <> 0").crossJoin(F.broadcast(subjects)).select("subject", F.concat(F.lit("ses-"), "subject", F.lit("_"), "chunk").alias("key"))
    return M.scan_run_manifest(files, subjects, keys)


@query("s2_scan_heldout_season", f"WITH {_LIST} SELECT '' AS subject, -1::BIGINT AS subject_idx, chunk, path AS transcript_relpath, 'test' AS split FROM l WHERE starts_with(chunk, 's07')")
def s2(spark, d):
    return M.scan_heldout(listing(spark, d))


@query(
    "s3_scan_ood_manifest",
    """WITH l AS (SELECT 'm' || doc_id // 4 AS s, CASE doc_id % 3 WHEN 0 THEN 'mkv' WHEN 1 THEN 'mp4' ELSE 'tsv' END AS ext FROM documents)
SELECT s AS stimulus_id, '/ood/' || s || '.' || min(ext) FILTER (ext <> 'tsv') AS video_relpath, coalesce('/ood/' || s || '.' || min(ext) FILTER (ext = 'tsv'), '') AS transcript_relpath FROM l GROUP BY 1, s HAVING count(*) FILTER (ext <> 'tsv') > 0""",
)
def s3(spark, d):
    return M.scan_ood(listing(spark, d).select(F.col("ood").alias("path")))


@query("s4_read_manifest_tsv", f"WITH {RUNS} SELECT stimulus_id, chunk, CASE WHEN doc_id % 4 = 0 THEN '' ELSE movie END AS movie, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE transcript_duration_s END AS transcript_duration_s, doc_id AS n_parcels FROM r")
def s4(spark, d):
    path, cols = folder(spark), ["stimulus_id", "chunk", "movie", "transcript_duration_s", "n_parcels"]
    r = runs(spark, d).select("stimulus_id", "chunk", F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.col("movie")).alias("movie"), F.when(F.col("doc_id") % 7 == 0, "bad").otherwise(F.col("transcript_duration_s").cast("string")).alias("transcript_duration_s"), F.col("doc_id").alias("n_parcels"))
    M.write_tsv(r, path)
    return M.read_manifest_tsv(spark, path, cols)


@query("s5_read_user_manifest", "SELECT doc_id::VARCHAR AS stimulus_id, '/v/' || source AS video_path FROM documents")
def s5(spark, d):
    path = folder(spark)
    table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("stimulus_id"), F.concat(F.lit("/v/"), "source").alias("video_path")).write.csv(path, header=True)
    return M.read_user_manifest(spark, path)


@query("s6_read_transcript_per_tr", "SELECT user_id AS item, event_id AS tr, p AS pos, CASE p WHEN 0 THEN event_type ELSE 'it''s' END AS word, CASE p WHEN 0 THEN value ELSE value + 1 END AS onset_s, CASE p WHEN 0 THEN 0.5e0 ELSE 0.25e0 END AS duration_s FROM events, (VALUES (0), (2)) v(p) WHERE event_type <> 'error'")
def s6(spark, d):
    q = "'"
    e = table(spark, d, "events").select(
        F.col("user_id").alias("item"), F.col("event_id").alias("tr"),
        F.when(F.col("event_type") == "error", "[broken").otherwise(F.concat(F.lit(f"[{q}"), "event_type", F.lit(f"{q}, {q} {q}, \"it's\"]"))).alias("words_per_tr"),
        F.concat(F.lit("["), F.col("value").cast("string"), F.lit(", 0.0, "), (F.col("value") + 1).cast("string"), F.lit("]")).alias("onsets_per_tr"), F.lit("[0.5, 0.5, 0.25]").alias("durations_per_tr"),
    )
    return M.parse_transcript_per_tr(e)


@query("s7_read_transcript_flat", "SELECT user_id AS item, event_type AS word, value AS onset_s, CASE WHEN event_id % 2 = 0 THEN 0e0 ELSE 0.5e0 END AS duration_s FROM events")
def s7(spark, d):
    return M.read_transcript_flat(table(spark, d, "events").select(F.col("user_id").alias("item"), F.col("event_type").alias("word"), F.col("value").alias("onset"), F.when(F.col("event_id") % 2 == 1, 0.5).alias("duration")))


@query("s8_read_transcript_json", "SELECT user_id::VARCHAR AS item, event_type AS word, value AS onset_s, 0e0 AS duration_s FROM events")
def s8(spark, d):
    path = folder(spark)
    rows = table(spark, d, "events").select(F.struct(F.col("user_id").cast("string").alias("item"), F.col("event_type").alias("word"), F.col("value").alias("onset")).alias("x"), F.floor(F.col("event_id") / 10_000).alias("f"))
    rows.groupBy("f").agg(F.to_json(F.collect_list("x")).alias("value")).repartition("f").write.partitionBy("f").text(path)  # one list of at most 10,000 events a file
    return M.read_transcript_json(spark, path)


def store(spark, d):
    s = S.FeatureStore(spark, folder(spark))
    s.write(features(spark, d).withColumn("t_s", F.col("frame") / 2))
    return s


@query("s9_read_feature_slice", f"WITH {FEATURES} SELECT item, layer, frame, ch - 2 AS ch, round(v, 5) AS v FROM x WHERE layer IN (2, 3) AND frame >= 5 AND frame < 20 AND ch IN (2, 3, 4)")
def s9(spark, d):
    return flat(store(spark, d).read_slice((2, 4), (5, 20), (2, 5)), "item", "layer", "frame")


@query("s10_feature_shape", f"WITH {FEATURES} SELECT item, count(DISTINCT layer) AS n_layers, max(frame) + 1 AS n_time, max(len(vec)) AS n_channels FROM f GROUP BY 1")
def s10(spark, d):
    return store(spark, d).shape()


@query("s11_read_time_axis", f"WITH {FEATURES} SELECT DISTINCT item, frame, frame / 2e0 AS t_s FROM f")
def s11(spark, d):
    return store(spark, d).time_axis()


@query("s12_list_keys", "SELECT DISTINCT label AS item FROM embeddings")
def s12(spark, d):
    return store(spark, d).list_keys()


@query("s13_write_features", "SELECT CASE WHEN label < 4 THEN 'skip' ELSE 'ok' END AS status, count(DISTINCT label) AS n FROM embeddings GROUP BY 1")
def s13(spark, d):
    s = S.FeatureStore(spark, folder(spark))
    f = features(spark, d).withColumn("t_s", F.col("frame") / 2)
    s.write(f.filter("item < 4"))
    return s.write(f)


@query("s13_write_features_overwrite", f"WITH {FEATURES} SELECT item, layer, frame, ch, round(CASE WHEN item < 4 THEN 2 * v ELSE v END, 5) AS v FROM x")
def s13_overwrite(spark, d):
    s = store(spark, d)
    f = features(spark, d).withColumn("t_s", F.col("frame") / 2)
    s.write(f.filter("item < 4").withColumn("vec", F.transform("vec", lambda x: x * 2)), overwrite=True)
    return flat(s.read(), "item", "layer", "frame")


@query("s14_read_bold", "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS tr, len(embedding) AS n FROM embeddings WHERE label = 3")
def s14(spark, d):
    by = W.partitionBy("label").orderBy("vec_id")
    bold = table(spark, d, "embeddings").select(F.col("label").cast("string").alias("fmri_item_id"), (F.row_number().over(by) - 1).alias("tr"), F.col("embedding").alias("vec"))
    return S.read_bold(bold, "3").select("tr", F.size("vec").alias("n"))


def _bundle(spark, d):
    path, r = folder(spark), runs(spark, d)
    M.save_bundle({"run_manifest": r, "stimulus_manifest": r.drop("subject"), "friends_s7_manifest": r.filter("task = 'friends'"), "ood_manifest": r.filter("task = 'other'")}, path)
    return path


@query("s15_manifest_bundle", f"WITH {RUNS} SELECT 'run_manifest' AS name, count(*) AS n, true AS ok FROM r UNION ALL SELECT 'stimulus_manifest', count(*), true FROM r UNION ALL SELECT 'friends_s7_manifest', count(*) FILTER (task = 'friends'), true FROM r UNION ALL SELECT 'ood_manifest', count(*) FILTER (task = 'other'), true FROM r")
def s15(spark, d):
    return M.bundle_report(spark, _bundle(spark, d))


@query("s16_load_run_bundle", f"WITH {RUNS} SELECT stimulus_id, chunk FROM r")
def s16(spark, d):
    return M.load_bundle(spark, _bundle(spark, d), ["run_manifest"])["run_manifest"].select("stimulus_id", "chunk")


_WINDOWED = "w AS (SELECT stimulus_id, task, chunk, k FROM r, range(2) t(k))"


@query(
    "s17_write_split_artifacts",
    f"""WITH {RUNS}, {_WINDOWED}, s AS (SELECT *, CASE WHEN task = 'friends' AND starts_with(chunk, 's06') THEN 'val' ELSE 'train' END AS split FROM r), v AS (SELECT w.*, s.split FROM w JOIN s USING (stimulus_id))
SELECT split || '_run_manifest' AS name, stimulus_id, -1 AS segment_idx FROM s UNION ALL SELECT split || '_segment_manifest', stimulus_id, k::INTEGER FROM v""",
)
def s17(spark, d):
    from gridwise.operators.manifests import season_holdout

    path, r = folder(spark), runs(spark, d)
    segments = r.select("stimulus_id", "task", "chunk", F.explode(F.array(F.lit(0), F.lit(1))).alias("segment_idx"))
    M.write_split_artifacts(season_holdout(r), segments, path)
    tables = M.read_split_artifacts(spark, path)
    index = lambda df: F.col("segment_idx").cast("int") if "segment_idx" in df.columns else F.lit(-1)
    return reduce(DataFrame.union, [df.select(F.lit(name).alias("name"), "stimulus_id", index(df).alias("segment_idx")) for name, df in tables.items()])


@query(
    "s18_write_val_rows",
    """SELECT l_orderkey::VARCHAR AS row_index, l_linenumber::VARCHAR AS subject_id, 'sub-' || l_linenumber AS subject, 'o' || l_orderkey AS stimulus_id, '' AS fmri_item_id, l_returnflag AS task, '' AS movie,
l_linestatus AS chunk, 'o' || l_orderkey || '_0' AS segment_id, '0' AS segment_idx, '1.5' AS segment_start_s, 149e0 AS segment_duration_s, l_suppkey::VARCHAR AS tr_idx, '' AS fmri_time_s FROM lineitem""",
)
def s18(spark, d):
    """Two fields are missing, a column is no field, and the columns come in another order."""
    path = folder(spark)
    line = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_suppkey", "l_tax")
    order = F.concat(F.lit("o"), F.col("l_orderkey").cast("string"))
    rows = line.select(
        F.col("l_tax"), F.col("l_suppkey").alias("tr_idx"), F.col("l_linestatus").alias("chunk"), F.concat(order, F.lit("_0")).alias("segment_id"), F.lit(0).alias("segment_idx"), F.lit(1.5).alias("segment_start_s"), F.lit(149.0).alias("segment_duration_s"),
        F.col("l_orderkey").alias("row_index"), F.col("l_linenumber").alias("subject_id"), F.concat(F.lit("sub-"), F.col("l_linenumber").cast("string")).alias("subject"), order.alias("stimulus_id"), F.col("l_returnflag").alias("task"), F.lit("").alias("movie"),
    )
    M.write_val_rows(rows, path)
    return M.read_manifest_tsv(spark, path, list(M.VAL_ROWS))


_SUBMITTED = "SELECT o_orderpriority AS subject, o_orderstatus AS chunk_key, o_totalprice AS value FROM orders"


def _submission(spark, d):
    path = folder(spark)
    M.write_submission(table(spark, d, "orders").select(F.col("o_orderpriority").alias("subject"), F.col("o_orderstatus").alias("chunk_key"), F.col("o_totalprice").alias("value")), path)
    return M.read_submission(spark, path)


@query("s19_submission_round_trip", _SUBMITTED)
def s19(spark, d):
    return _submission(spark, d)


@query("a35_submission_summary", f"SELECT subject, count(DISTINCT chunk_key) AS n_chunks, count(*) AS n_trs FROM ({_SUBMITTED}) GROUP BY 1")
def a35(spark, d):
    return M.submission_summary(_submission(spark, d))


@query("s20_write_report_json", "SELECT source, count(*) AS n FROM documents GROUP BY 1")
def s20(spark, d):
    path = folder(spark)
    M.write_report_json(table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n")), path)
    return spark.read.schema("source string, n long").json(path)


@query("s23_inference_index", "SELECT label AS stimulus_id, vec_id % 3 AS subject, count(*) AS n_trs, 64 AS n_parcels, 'out/' || label || '_' || vec_id % 3 AS path FROM embeddings GROUP BY 1, 2")
def s23(spark, d):
    return M.inference_index(table(spark, d, "embeddings").select(F.col("label").alias("stimulus_id"), F.pmod("vec_id", F.lit(3)).alias("subject"), F.col("embedding").alias("vec")))


@query("s13_delete_and_replace", f"WITH {FEATURES} SELECT item, layer, frame, ch, round(CASE WHEN item = 5 THEN 4 * v ELSE v END, 5) AS v FROM x WHERE item <> 3")
def s13_delete(spark, d):
    """An item is deleted and another one replaced; what the versions before held can still be read."""
    s, f = store(spark, d), features(spark, d).withColumn("t_s", F.col("frame") / 2)
    s.delete(f.filter("item = 3").select("item"))
    s.write(f.filter("item = 5").withColumn("vec", F.transform("vec", lambda x: x * 4)), overwrite=True)
    return flat(s.read(), "item", "layer", "frame")


@query(
    "a34_cache_inventory",
    """SELECT modality, modality || '_store' AS name, count(label) > 0 AS present, count(DISTINCT label) AS n_keys, coalesce(sum(len(embedding)), 0)::BIGINT AS n_values, count(label) > 0 AS has_bytes
FROM (VALUES ('audio', 0), ('text', 1), ('vision', 9)) v(modality, m) LEFT JOIN embeddings ON vec_id % 2 = m GROUP BY 1""",
)
def a34(spark, d):
    root = folder(spark)
    held = table(spark, d, "embeddings").select("vec_id", F.col("label").alias("item"), F.lit(0).alias("layer"), F.col("vec_id").alias("frame"), F.lit(0.0).alias("t_s"), F.col("embedding").alias("vec"))
    for name, rest in (("audio", 0), ("text", 1)):
        S.FeatureStore(spark, f"{root}/{name}_store").write(held.filter(F.col("vec_id") % 2 == rest))
    out = S.cache_inventory(spark, {m: f"{root}/{m}_store" for m in ("audio", "text", "vision")})
    return out.select("modality", F.element_at(F.split("path", "/"), -1).alias("name"), "present", "n_keys", "n_values", (F.col("n_bytes") > 0).alias("has_bytes"))


@query("d1_extractor_registry", f"WITH {TALK} SELECT item, ('0x' || md5(word)[1:8])::BIGINT % 8 AS k, count(*)::DOUBLE AS total FROM t GROUP BY 1, 2")
def d1(spark, d):
    vecs = registry.extract(talk(spark, d), "hashing")
    return vecs.select("item", F.posexplode("vec").alias("k", "v")).groupBy("item", F.col("k").cast("long").alias("k")).agg(F.sum("v").alias("total")).filter("total <> 0")


@query("d2_metric_registry", f"WITH {ROWS}, s AS (SELECT subject, {SUMS} FROM l GROUP BY 1) SELECT subject, round({R}, 6) AS pearson, round({EV}, 3) AS ev FROM s")
def d2(spark, d):
    return registry.score(scored_rows(spark, d), ["pearson", "ev"], ["subject"]).withColumns({"pearson": F.round("pearson", 6), "ev": F.round("ev", 3)})


@query("d3_benchmark_registry", f"WITH {RUNS} SELECT stimulus_id FROM r WHERE task = 'friends'")
def d3(spark, d):
    return runs(spark, d).filter(F.col("task") == registry.benchmark("id_dist")["task"]).select("stimulus_id")


@query("d5_pooling_config", f"WITH {FEATURES} SELECT item, frame, layer * 8 + ch AS ch, round(v, 5) AS v FROM (SELECT *, CASE layer WHEN 3 THEN 0 WHEN 5 THEN 1 ELSE 2 END AS layer2 FROM x WHERE layer IN (3, 5, 7)) z".replace("layer * 8 + ch", "layer2 * 8 + ch"))
def d5(spark, d):
    return flat(L.Pooling(aggregation="cat").apply(features(spark, d), 8), "item", "frame")


def run_tables(spark, d):
    """Artefacts of three runs, the return flags: R has neither scores by output nor settings."""
    rows = scored_rows(spark, d).withColumnRenamed("task", "run")
    r = scores.strict_pearson_of_sums().alias("r")
    lines = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("run"))
    logged = lines.agg(F.avg("l_discount").alias("val/pearson"), F.avg("l_tax").alias("loss"))
    return {
        "parcels": scores.sums(rows.filter("run <> 'R'"), ["run", "parcel"]).select("run", "parcel", r),
        "subjects": scores.sums(rows, ["run", "subject"]).select("run", F.col("subject").cast("string").alias("subject"), r),
        "metrics": logged.unpivot("run", ["val/pearson", "loss"], "name", "value"),
        "settings": logged.filter("run <> 'R'").select("run", F.concat(F.lit("run "), "run").alias("run_name"), F.lit(0.0).alias("reference"), F.lit(0.5).alias("tolerance")),
    }


@query(
    "a19_runs_report",
    f"""WITH {ROWS}, p AS (SELECT task AS run, parcel, {SUMS} FROM l WHERE task <> 'R' GROUP BY 1, 2), pr AS (SELECT run, {STRICT} AS r FROM p),
u AS (SELECT task AS run, subject, {SUMS} FROM l GROUP BY 1, 2), ur AS (SELECT run, {STRICT} AS r FROM u),
s AS (SELECT run, count(r) AS n_subjects, round(avg(r), 4) AS subject_mean, round(max(r), 4) AS best FROM ur GROUP BY 1),
o AS (SELECT run, avg(r) AS m, round(median(r), 4) AS median, round(quantile_cont(r, 0.1), 4) AS p10, round(quantile_cont(r, 0.9), 4) AS p90, count(*) FILTER (r > 0) AS n_positive FROM pr GROUP BY 1),
g AS (SELECT l_returnflag AS run, avg(l_discount) AS d, round(avg(l_tax), 6) AS loss FROM lineitem GROUP BY 1),
c AS (SELECT *, CASE run WHEN 'A' THEN 0e0 WHEN 'N' THEN 0.9e0 END AS reference, CASE run WHEN 'A' THEN 0.5e0 ELSE 0.02e0 END AS tolerance, round(coalesce(m, d), 4) AS mean FROM g LEFT JOIN o USING (run) LEFT JOIN s USING (run))
SELECT run, CASE WHEN run <> 'R' THEN 'run ' || run END AS run_name, mean, median, p10, p90, coalesce(n_positive, -1) AS n_positive, n_subjects, subject_mean, best, loss, reference, tolerance, round(abs(mean - reference), 6) AS gap,
CASE WHEN reference IS NULL THEN 'SKIPPED' WHEN abs(mean - reference) <= tolerance THEN 'PASS' ELSE 'FAIL' END AS verdict FROM c""",
)
def runs_report(spark, d):
    """Run N's settings are written a second time, which leaves those of A."""
    path, tables = folder(spark), run_tables(spark, d)
    run_store.write_run_artefacts(tables, path)
    again = tables["settings"].filter("run = 'N'").withColumns({"reference": F.lit(0.9), "tolerance": F.lit(None).cast("double")})
    run_store.write_run_artefacts({"settings": again}, path)
    report = run_store.runs_report(run_store.read_run_artefacts(spark, path))
    by_subject = F.map_values("per_subject")
    return report.select(
        "run", "run_name", "mean", "median", "p10", "p90", F.col("n_positive").cast("long").alias("n_positive"), F.size(by_subject).cast("long").alias("n_subjects"), "subject_mean", F.array_max(by_subject).alias("best"),
        F.round(F.col("metrics")["loss"], 6).alias("loss"), "reference", "tolerance", F.round("gap", 6).alias("gap"), "verdict",
    )
