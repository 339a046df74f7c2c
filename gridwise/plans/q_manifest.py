"""Queries of manifests: documents are stimuli, their language is the task and their source the chunk."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridwise.operators import manifests as M
from gridwise.operators.digests import table_digest
from gridwise.plans.catalog import query, table


def runs(spark, d):
    return table(spark, d, "documents").select(
        F.lit("docs").alias("dataset_name"), F.lit("docs").alias("stimulus_namespace"), F.col("lang").alias("subject"),
        F.when(F.col("lang") == "en", "friends").when(F.col("lang") == "fr", "movie10").otherwise("other").alias("task"), F.col("source").alias("movie"),
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("stimulus_id"), F.format_string("s%02de%02d", F.pmod("doc_id", F.lit(7)), F.pmod("doc_id", F.lit(25))).alias("chunk"),
        F.when(F.col("doc_id") % 11 == 0, "").otherwise(F.concat(F.lit("ses-"), F.col("doc_id").cast("string"))).alias("fmri_h5_key"),
        F.concat(F.lit("/data/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".mkv")).alias("video_relpath"), (F.col("n_chars") / 10).alias("transcript_duration_s"), "doc_id",
    )


RUNS = """r AS (SELECT 'docs' AS dataset_name, 'docs' AS stimulus_namespace, lang AS subject, CASE lang WHEN 'en' THEN 'friends' WHEN 'fr' THEN 'movie10' ELSE 'other' END AS task, source AS movie,
source || '/' || doc_id AS stimulus_id, printf('s%02de%02d', doc_id % 7, doc_id % 25) AS chunk, CASE WHEN doc_id % 11 = 0 THEN '' ELSE 'ses-' || doc_id END AS fmri_h5_key,
'/data/' || source || '/' || doc_id || '.mkv' AS video_relpath, n_chars / 10 AS transcript_duration_s, doc_id FROM documents)"""


@query("p1_relativize_paths", f"WITH {RUNS} SELECT doc_id, substr(video_relpath, 7) AS path FROM r")
def p1(spark, d):
    return runs(spark, d).select("doc_id", M.relativize(F.col("video_relpath"), "/data").alias("path"))


@query("p2_resolve_paths", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '' ELSE '/mnt/x/' || source END AS path FROM documents")
def p2(spark, d):
    return table(spark, d, "documents").select("doc_id", M.resolve(F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("source")), "/mnt/x").alias("path"))


@query("p3_ensure_columns", "SELECT doc_id, 0e0 AS audio_duration_s, 0::BIGINT AS n_parcels, '' AS audio_relpath FROM documents")
def p3(spark, d):
    return M.ensure_columns(table(spark, d, "documents").select("doc_id"), ["audio_duration_s", "n_parcels", "audio_relpath"])


@query(
    "p4_canonical_manifest",
    f"""WITH {RUNS} SELECT 'cat' AS dataset_name, 'cat' AS stimulus_namespace, task, movie, stimulus_id, chunk, substr(video_relpath, 7) AS video_relpath, '' AS transcript_relpath, '' AS audio_relpath,
    transcript_duration_s, 0e0 AS video_duration_s, 0e0 AS audio_duration_s FROM r""",
)
def p4(spark, d):
    return M.canonical(runs(spark, d).drop("subject", "doc_id", "fmri_h5_key"), M.STIMULUS_COLUMNS, "cat", "/data")


@query("p5_subject_index", f"WITH {RUNS} SELECT stimulus_id, subject, dense_rank() OVER (ORDER BY subject) - 1 AS subject_idx FROM r")
def p5(spark, d):
    return M.subject_index(runs(spark, d).select("stimulus_id", "subject"))


@query("p6_item_key", f"WITH {RUNS} SELECT subject || '/' || stimulus_id AS item FROM r")
def p6(spark, d):
    return runs(spark, d).select(M.item_key(F.col("subject"), F.col("stimulus_id")).alias("item"))


@query("p7_filter_subjects_stimuli", f"WITH {RUNS} SELECT stimulus_id FROM r WHERE subject IN ('en', 'de') AND doc_id IN (SELECT doc_id FROM labels)")
def p7(spark, d):
    r = runs(spark, d)
    stimuli = r.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").select("stimulus_id")
    return M.filter_subjects_stimuli(r, spark.createDataFrame([("en",), ("de",)], "subject string"), stimuli).select("stimulus_id")


@query("p8_stimulus_index", f"WITH {RUNS} SELECT stimulus_id, row_number() OVER (ORDER BY stimulus_id) - 1 AS stimulus_idx FROM (SELECT DISTINCT stimulus_id FROM r)")
def p8(spark, d):
    return M.stimulus_index(runs(spark, d))


@query(
    "p8_select_indices",
    f"WITH {RUNS}, i AS (SELECT stimulus_id, row_number() OVER (ORDER BY stimulus_id) - 1 AS stimulus_idx FROM (SELECT DISTINCT stimulus_id FROM r)) SELECT place, stimulus_idx, stimulus_id FROM (VALUES (0, 7), (1, 3), (3, 1000000000)) v(place, stimulus_idx) LEFT JOIN i USING (stimulus_idx)",
)
def p8_select(spark, d):
    return M.select_indices(M.stimulus_index(runs(spark, d)), [7, 3, 7, 1000000000])


_SELECTORS = ["s6", "s03-18", "S02E09"]


@query("p9_holdout_selector", f"WITH {RUNS} SELECT stimulus_id, CASE WHEN task = 'friends' AND (starts_with(chunk, 's06') OR starts_with(chunk, 's03e18') OR starts_with(chunk, 's02e09')) THEN 'val' ELSE 'train' END AS split FROM r")
def p9(spark, d):
    return M.add_splits(runs(spark, d), "custom_holdout", selectors=_SELECTORS).select("stimulus_id", "split")


@query("p9_unmatched_selectors", f"WITH {RUNS} SELECT selector FROM (VALUES ('s6', 's06'), ('s5-99', 's05e99')) v(selector, prefix) WHERE NOT EXISTS (SELECT 1 FROM r WHERE task = 'friends' AND starts_with(chunk, prefix))")
def p9_unmatched(spark, d):
    return M.unmatched_selectors(runs(spark, d), spark.createDataFrame(M.parse_selectors(["s6", "s5-99"]), "selector string, task string, prefix string"))


@query("p10_season_holdout", f"WITH {RUNS} SELECT stimulus_id, CASE WHEN task = 'friends' AND starts_with(chunk, 's06') THEN 'val' ELSE 'train' END AS split FROM r")
def p10(spark, d):
    return M.season_holdout(runs(spark, d), 6).select("stimulus_id", "split")


@query("p11_split_filter", f"WITH {RUNS} SELECT stimulus_id FROM r WHERE task = 'friends' AND starts_with(chunk, 's06')")
def p11(spark, d):
    return M.season_holdout(runs(spark, d), 6).filter("split = 'val'").select("stimulus_id")


@query("p15_chunk_key", f"WITH {RUNS} SELECT stimulus_id, regexp_replace(stimulus_id, '^[^/]*/', '') AS chunk_key FROM r")
def p15(spark, d):
    return runs(spark, d).select("stimulus_id", M.chunk_key(F.col("stimulus_id")).alias("chunk_key"))


_SLUG = "trim(regexp_replace({}, '[^A-Za-z0-9._-]+', '_', 'g'), '_')"


@query("p16_slug", f"SELECT doc_id, CASE WHEN s = '' THEN 'stimulus' ELSE s END AS slug FROM (SELECT doc_id, {_SLUG.format('text')} AS s FROM documents)")
def p16(spark, d):
    return table(spark, d, "documents").select("doc_id", M.slug(F.col("text")).alias("slug"))


@query("p17_store_identity", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'ctx-text-vision' ELSE 'ctx-audio-vision' END AS identity FROM documents")
def p17(spark, d):
    lists = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("vision"), F.lit("text"), F.lit("vision"))).otherwise(F.array(F.lit("vision"), F.lit("audio")))
    return table(spark, d, "documents").select("doc_id", M.store_identity(lists).alias("identity"))


@query("p21_task_code", f"WITH {RUNS} SELECT stimulus_id, CASE task WHEN 'friends' THEN 0 WHEN 'movie10' THEN 1 ELSE -1 END AS code FROM r")
def p21(spark, d):
    return runs(spark, d).select("stimulus_id", M.task_code(F.col("task")).alias("code"))


@query("p23_linspace_rows", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT (i * ((SELECT max(doc_id) FROM documents)) // 9) FROM range(10) t(i))")
def p23(spark, d):
    return M.linspace_rows(table(spark, d, "documents"), 10, "doc_id").select("doc_id")


@query("p24_missing_label_guard", f"WITH {RUNS}, b AS (SELECT stimulus_id FROM r WHERE fmri_h5_key = '') SELECT (SELECT count(*) FROM b) AS n_missing, (SELECT string_agg(stimulus_id, ',' ORDER BY stimulus_id) FROM (SELECT stimulus_id FROM b ORDER BY 1 LIMIT 5)) AS examples")
def p24(spark, d):
    return M.missing_labels(runs(spark, d))


@query("a1_distinct_stimuli", "SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def a1(spark, d):
    return M.distinct_stimuli(table(spark, d, "documents").select("source", "doc_id"), ["doc_id"], ["source"])


@query("a2_split_counts", f"WITH {RUNS}, s AS (SELECT *, CASE WHEN task = 'friends' AND starts_with(chunk, 's06') THEN 'val' ELSE 'train' END AS split FROM r) SELECT split, count(*) AS n_rows, count(DISTINCT stimulus_id) AS n_stimuli FROM s GROUP BY 1")
def a2(spark, d):
    return M.split_counts(M.season_holdout(runs(spark, d), 6))


@query("a3_manifest_summary", f"WITH {RUNS} SELECT count(*) AS n_runs, count(*) FILTER (fmri_h5_key = '') AS n_missing, count(DISTINCT subject) AS n_subjects, (SELECT string_agg(task, ',' ORDER BY task) FROM (SELECT DISTINCT task FROM r)) AS tasks FROM r")
def a3(spark, d):
    return M.summary(runs(spark, d))


#: A row as lengths and values, columns in the order of their names; nodes of rows that share three hexadecimal digits, then the root.
_WRITTEN = "concat_ws(',', " + ", ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "lang", "n_chars", "source")) + ")"
_DIGEST = f"""h AS (SELECT sha256({_WRITTEN}) AS h, count(*) AS n FROM t GROUP BY 1),
l AS (SELECT left(h, 3) AS p, sha256(string_agg(h || 'x' || n, ',' ORDER BY h)) AS e, sum(n) AS n FROM h GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS n, sha256('6:doc_id4:lang7:n_chars6:source,' || string_agg(p || 'x' || e, ',' ORDER BY p)) AS hash FROM l"""


@query("a4_table_hash", f"WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN '' ELSE lang END AS lang, source, n_chars FROM documents), {_DIGEST}")
def a4(spark, d):
    lang = F.when(F.col("doc_id") % 3 == 1, "").when(F.col("doc_id") % 3 == 2, F.col("lang"))
    return table_digest(table(spark, d, "documents").select("source", "doc_id", lang.alias("lang"), "n_chars"), levels=1)


@query("a5_validate_manifest", f"WITH {RUNS} SELECT count(*) AS n, count(*) FILTER (transcript_duration_s IS NULL) AS bad_transcript_duration_s, (SELECT count(*) FROM (SELECT 1 FROM r GROUP BY chunk HAVING count(*) > 1)) AS n_repeated_keys FROM r")
def a5(spark, d):
    return M.validate(runs(spark, d), ["chunk"], ["transcript_duration_s"])


@query("a7_stop_time", "SELECT doc_id, greatest(n_chars / 10, doc_id % 100 * 1.49e0, 30e0) AS stop_s FROM documents")
def a7(spark, d):
    return table(spark, d, "documents").select("doc_id", M.stop_time(F.col("n_chars") / 10, F.col("doc_id") % 100 * 1.49, F.lit(30.0)).alias("stop_s"))


@query("j4_apply_split_map", "SELECT doc_id, CASE WHEN source IN ('src0', 'src1') THEN 'val' ELSE 'train' END AS split FROM documents")
def j4(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("chunk"))
    splits = docs.select("chunk").distinct().withColumn("split", F.when(F.col("chunk").isin("src0", "src1"), "val").otherwise("train"))
    return M.apply_split_map(docs, splits).select("doc_id", "split")


_KEYS = "k AS (SELECT doc_id, concat_ws('-', source, doc_id) AS k FROM documents UNION ALL SELECT doc_id, concat_ws('-', 'q' || quality, doc_id) FROM labels)"


def _match(spark, d, contains):
    """Every document's number among the keys of documents and of labels; both have it where a document has a label."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    keys = docs.select(F.concat_ws("-", "source", F.col("doc_id").cast("string")).alias("key")).union(labels.select(F.concat_ws("-", F.concat(F.lit("q"), F.col("quality").cast("string")), F.col("doc_id").cast("string"))))
    return M.match_unique_key(docs.select("doc_id", F.col("doc_id").cast("string").alias("token")), keys, "token", contains=contains).select("doc_id", "key")


@query("j5_match_unique_key", f"WITH {_KEYS}, g AS (SELECT doc_id, min(k) AS k, count(DISTINCT k) AS n FROM k GROUP BY 1) SELECT d.doc_id, CASE WHEN n = 1 THEN k ELSE '' END AS key FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id")
def j5(spark, d):
    return _match(spark, d, contains=False)


@query("j5_match_containing_key", f"WITH {_KEYS} SELECT doc_id, CASE WHEN n = 1 THEN key ELSE '' END AS key FROM (SELECT d.doc_id, min(k) AS key, count(DISTINCT k) AS n FROM documents d LEFT JOIN k ON contains(k, d.doc_id::VARCHAR) GROUP BY 1)")
def j5_containing(spark, d):
    return _match(spark, d, contains=True)


@query("j7_missing_features", f"WITH {RUNS} SELECT DISTINCT stimulus_id FROM r WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j7(spark, d):
    r = runs(spark, d)
    return M.missing_features(r, r.join(table(spark, d, "labels"), "doc_id", "left_semi").select("stimulus_id"))


@query("j8_stimulus_x_subject", f"WITH {RUNS} SELECT r.stimulus_id, s.subject FROM r, (SELECT DISTINCT subject FROM r) s")
def j8(spark, d):
    r = runs(spark, d)
    return M.stimulus_x_subject(r.select("stimulus_id"), r)


@query(
    "j9_check_key_sets",
    """WITH e AS (SELECT DISTINCT o_orderpriority AS subject, o_orderstatus AS chunk FROM orders), g AS (SELECT DISTINCT c_mktsegment AS subject, 'F' AS chunk FROM customer UNION SELECT subject, chunk FROM e WHERE chunk <> 'P')
SELECT coalesce(e.subject, g.subject) AS subject, coalesce(e.chunk, g.chunk) AS chunk, CASE WHEN e.chunk IS NULL THEN 'extra' ELSE 'missing' END AS side FROM e FULL JOIN g ON e.subject = g.subject AND e.chunk = g.chunk WHERE e.chunk IS NULL OR g.chunk IS NULL""",
)
def j9(spark, d):
    e = table(spark, d, "orders").select(F.col("o_orderpriority").alias("subject"), F.col("o_orderstatus").alias("chunk"))
    g = table(spark, d, "customer").select(F.col("c_mktsegment").alias("subject"), F.lit("F").alias("chunk")).union(e.filter("chunk <> 'P'"))
    return M.check_key_sets(e, g, ["subject", "chunk"])


@query("w4_row_number_first", "SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS n FROM lineitem) WHERE n = 1")
def w4(spark, d):
    return M.distinct_stimuli(table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey", "l_linenumber", "l_partkey"], ["l_suppkey"])


@query("u1_union_manifests", "SELECT doc_id, lang, NULL::INTEGER AS quality FROM documents UNION ALL SELECT doc_id, NULL, quality FROM labels")
def u1(spark, d):
    return M.union_manifests(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels").select("doc_id", F.col("quality").cast("int").alias("quality")))


@query("u2_extraction_manifest", "SELECT 'docs' AS stimulus_namespace, doc_id AS stimulus_id, coalesce('label' || l.quality, d.lang) AS origin FROM documents d LEFT JOIN labels l USING (doc_id)")
def u2(spark, d):
    base = lambda t, o: table(spark, d, t).select(F.lit("docs").alias("stimulus_namespace"), F.col("doc_id").alias("stimulus_id"), o.alias("origin"))
    return M.extraction_manifest(base("labels", F.concat(F.lit("label"), F.col("quality").cast("string"))), base("documents", F.col("lang")))


@query("u3_key_difference", "(SELECT *, 'missing' AS side FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT n_nationkey FROM nation WHERE n_nationkey > 3)) UNION ALL (SELECT *, 'extra' FROM (SELECT n_nationkey FROM nation WHERE n_nationkey > 3 EXCEPT SELECT c_nationkey FROM customer))")
def u3(spark, d):
    return M.key_difference(table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "nation").filter("n_nationkey > 3").select(F.col("n_nationkey").alias("k")))


@query("u4_unknown_subjects", f"WITH {RUNS} SELECT DISTINCT c_mktsegment AS subject FROM customer WHERE c_mktsegment NOT IN (SELECT subject FROM r)")
def u4(spark, d):
    return M.unknown_subjects(table(spark, d, "customer").select(F.col("c_mktsegment").alias("subject")), runs(spark, d))


_SCORE = "('0x' || substr(sha256('33' || chunk), 1, 13))::BIGINT / 4503599627370496e0"


@query("x1_hash_split", f"WITH {RUNS}, k AS (SELECT DISTINCT chunk, {_SCORE} >= 0.9e0 AS v FROM r) SELECT stimulus_id, CASE WHEN v OR (NOT (SELECT bool_or(v) FROM k) AND chunk = (SELECT max(chunk) FROM k)) THEN 'val' ELSE 'train' END AS split FROM r JOIN k USING (chunk)")
def x1(spark, d):
    return M.hash_split(runs(spark, d)).select("stimulus_id", "split")


@query("x1_hash_split_fallback", f"WITH {RUNS}, k AS (SELECT chunk, min(doc_id) AS f FROM r GROUP BY 1) SELECT stimulus_id, CASE WHEN chunk = (SELECT arg_max(chunk, f) FROM k) THEN 'val' ELSE 'train' END AS split FROM r")
def x1_fallback(spark, d):
    """No chunk scores that high a number, so the chunk that appears last is val."""
    return M.hash_split(runs(spark, d), ratio=1e-12, order="doc_id").select("stimulus_id", "split")


@query("x1_hash_split_compat")
def x1_compat(spark, d):
    return M.hash_split(runs(spark, d), compat=True).select("stimulus_id", "split")


_CUSTOM = "CASE WHEN task = 'friends' AND starts_with(chunk, 's03') THEN 'val' ELSE 'train' END"


@query(
    "x2_split_dispatch",
    f"""WITH {RUNS}, k AS (SELECT chunk, min(doc_id) AS f FROM r GROUP BY 1), a AS (SELECT 'chunk' AS strategy, stimulus_id, CASE WHEN chunk = (SELECT arg_max(chunk, f) FROM k) THEN 'val' ELSE 'train' END AS split FROM r
UNION ALL SELECT 'friends_season_holdout', stimulus_id, CASE WHEN task = 'friends' AND starts_with(chunk, 's06') THEN 'val' ELSE 'train' END FROM r UNION ALL SELECT 'custom_holdout', stimulus_id, {_CUSTOM} FROM r)
SELECT strategy, split, count(*) AS n_rows, count(DISTINCT stimulus_id) AS n_stimuli FROM a GROUP BY 1, 2""",
)
def x2(spark, d):
    """The chunk strategy with the generator's scores, none of them high enough: the chunk that appears last is val."""
    asked = {"chunk": {"compat": True, "order": "doc_id", "ratio": 1e-12}, "friends_season_holdout": {}, "custom_holdout": {"selectors": ["s3"]}}
    parts = [M.split_counts(M.add_splits(runs(spark, d), s, **rest)).select(F.lit(s).alias("strategy"), "split", "n_rows", "n_stimuli") for s, rest in asked.items()]
    return parts[0].union(parts[1]).union(parts[2])
