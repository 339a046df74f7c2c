"""Hand cases and properties of the time-series and scoring operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwise.functions import registry
from gridwise.operators import ensemble as E
from gridwise.operators import grid as G
from gridwise.operators import intervals as I
from gridwise.operators import layers as L
from gridwise.operators import losses as T
from gridwise.operators import manifests as M
from gridwise.operators import metrics as S
from gridwise.operators import pairwise as P


def rows(spark, pred, target, parcel=0):
    return spark.createDataFrame([(parcel, float(a), float(b)) for a, b in zip(pred, target, strict=True)], "parcel int, pred double, target double")


def test_pearson_ev_mse(spark):
    df = rows(spark, [1, 2, 3, 4], [2, 1, 4, 3]).union(rows(spark, [1, 2, 3, 4], [5, 5, 5, 5], 1))
    r = {x.parcel: x.r for x in S.pearson_per_parcel(df).collect()}
    assert math.isclose(r[0], 0.6) and r[1] == 0.0  # a constant side scores 0 here ...
    strict = {x.parcel: x.r for x in S.pearson_two_pass(df).collect()}
    assert math.isclose(strict[0], 0.6) and strict[1] is None  # ... and nothing there
    assert math.isclose(S.explained_variance(df.filter("parcel = 0")).first().ev, 0.2)
    assert S.mse(df.filter("parcel = 0")).first().mse == 1.0
    assert S.pearson_per_parcel(df.filter("parcel > 5")).count() == 0


def test_percentiles_and_verdict(spark):
    df = spark.createDataFrame([(0.1,), (0.2,), (0.3,), (0.4,), (float("nan"),)], "r double")
    one = S.acceptance(S.run_report(df), 0.26).first()
    assert (one.p10, one.p90, one["mean"], one.n_positive, one.verdict) == (0.13, 0.37, 0.25, 4, "PASS")
    assert S.acceptance(S.run_report(df), None).first().verdict == "SKIPPED"


def test_composite_names_and_weights():
    assert T.term_names("mse_pearson") == ["mse", "pearson"] and T.term_names("mse_rsa_log") == T.term_names("mse__log_rsa_") == ["mse", "rsa_log"]
    assert T.term_names("rsa_log_cka") == ["rsa_log", "cka"] and T.term_names("log_cka_log_rsa") == ["cka_log", "rsa_log"]
    for bad in ("mse_mse", "mse_other", "", "log", "rsa_log_rsa", "log_rsa_log", "mse_log"):
        with pytest.raises(ValueError):
            T.term_names(bad)
    assert T.term_weights("mse_pearson") == {"mse": 1, "pearson": 0.03} and T.term_weights("pearson_mse") == {"pearson": 0.03, "mse": 1}
    assert T.term_weights("mse_rsa_log", {"rsa": 2, "mse": None}) == {"mse": 1, "rsa_log": 2} and T.term_weights("mse_cka", [0, 3]) == {"mse": 0, "cka": 3}
    for bad in ({"mse": -1}, {"mse": 0, "cka": 0}, {"rsa": 1}, [1], [1, 2, 3]):
        with pytest.raises(ValueError):
            T.term_weights("mse_cka", bad)


def test_composites_equal_their_terms(spark, monkeypatch):
    """Terms of samples against whole matrices in numpy, in small blocks; a term without weight is left out."""
    monkeypatch.setattr(P._blocks, "__defaults__", (4,))
    rng = np.random.default_rng(8)
    x = rng.normal(size=(11, 5))
    y = x + rng.normal(size=(11, 5))
    rows = spark.createDataFrame([(g, i, x[i].tolist(), y[i].tolist()) for g in ("a", None) for i in range(11)], "group string, i long, x array<double>, y array<double>").repartition(4)
    upper = np.triu_indices(11, 1)
    rsa = np.corrcoef((1 - np.corrcoef(x))[upper], (1 - np.corrcoef(y))[upper])[0, 1]
    xc, yc = x - x.mean(0), y - y.mean(0)
    cka = (np.linalg.norm(xc.T @ yc) ** 2) / (np.linalg.norm(xc.T @ xc) * np.linalg.norm(yc.T @ yc))
    pearson = np.mean([np.corrcoef(x[:, c], y[:, c])[0, 1] for c in range(5)])
    want = {"mse": ((x - y) ** 2).mean(), "rsa_log": np.log(1 - rsa + 1e-8), "cka": 1 - cka, "pearson": 1 - pearson}
    got = T.composite(rows.filter("group = 'a'"), "mse_log_rsa_cka_pearson", {"cka": 2, "mse": 0.5}).first().asDict()
    assert all(math.isclose(got[k], v, abs_tol=1e-9) for k, v in want.items())
    assert math.isclose(got["loss"], 0.5 * want["mse"] + want["rsa_log"] + 2 * want["cka"] + want["pearson"], abs_tol=1e-9)
    less = T.composite(rows.filter("group = 'a'"), "mse_rsa", {"rsa": 0})
    assert less.columns == ["group", "mse", "loss"]
    long = spark.createDataFrame([(i, c, float(x[i, c]), float(y[i, c])) for i in range(11) for c in range(5)], "row int, parcel int, pred double, target double")
    assert math.isclose(S.composite_loss(long, "mse_log_rsa", row="row").first().loss, want["mse"] + want["rsa_log"], abs_tol=1e-9)
    with pytest.raises(ValueError, match="samples"):
        S.composite_loss(long, "mse_cka")
    two = T.evaluate(rows.filter("group = 'a' and i < 2"), ["rsa", "cka_unbiased"]).first()
    assert two.rsa == 0.0 and two.cka_unbiased is None  # one pair has no spread; four rows are needed
    assert registry.score_samples(rows.filter("group = 'a'"), ["ev"]).columns == ["group", "ev"] and T.evaluate(rows.limit(0), ["mse", "rsa"]).collect() == []
    with pytest.raises(KeyError):
        registry.score_samples(rows, ["none"])


def test_softmax_weights(spark):
    nan = float("nan")
    df = spark.createDataFrame([(0, 0, 0.2), (1, 0, 0.3), (2, 0, nan), (0, 1, nan), (1, 1, nan), (2, 1, None)], "member int, parcel int, score double")
    w = {(x.parcel, x.member): x.weight for x in E.softmax_weights(df, ["parcel"]).collect()}
    assert [round(w[0, m], 8) for m in range(3)] == [0.41742979, 0.58257021, 0.0]
    assert all(math.isclose(w[1, m], 1 / 3) for m in range(3))


def test_average_ranks(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 3.0), (0, 3.0), (0, 7.0)], "k int, v double")
    assert sorted(x.r for x in P.average_ranks(df, ["k"], "v", "r").collect()) == [0, 1.5, 1.5, 3]


def test_layers():
    assert [L.layer_indices(n, [0.5, 0.75, 1.0]) for n in (8, 5, 1)] == [[3, 5, 7], [2, 3, 4], [0]]
    assert [(a, b) for a, b, _ in L.group_bounds(8, [0.5, 0.75, 1.0])] == [(3, 5), (5, 8)]
    with pytest.raises(ValueError):
        L.Pooling("all", aggregation="group_mean")
    with pytest.raises(ValueError):
        L.normalise_mode("other")


def test_windows_have_two_rules(spark):
    df = spark.createDataFrame([("a", 100.0), ("b", 145.0), ("c", 149.0), ("d", 300.0)], "stimulus_id string, stop_s double")
    n = lambda out: [x[1] for x in sorted((r.stimulus_id, r["count"]) for r in out.groupBy("stimulus_id").count().collect())]
    assert n(G.segment_windows(df)) == [1, 1, 2, 3]
    assert n(G.inference_windows(df, "stop_s")) == [1, 2, 2, 3]


def test_window_starts_are_whole_frames(spark):
    seg = G.segment_windows(spark.createDataFrame([("a", 500.0)], "stimulus_id string, stop_s double")).orderBy("segment_idx").collect()
    assert [round(s.segment_start_s * 2) for s in seg] == [-9, 289, 587, 885]
    assert [round((s.segment_start_s + 4.47) / 1.49) for s in seg] == [0, 100, 200, 300]


def test_alignment(spark):
    f = spark.createDataFrame([("a", i, v) for i, v in enumerate([10.0, 20.0, 40.0])], "item string, frame int, value double")
    times = [0, 0.25, 0.75, 1, 9, -0.25, -1]
    t = spark.createDataFrame([("a", float(x)) for x in times], "item string, t double")
    got = {x.t: x.value for x in G.align(f, t, 2.0).collect()}
    assert [got[float(x)] for x in times] == [10, 15, 30, 40, 40, 5, 10]


def test_resampling(spark):
    f = lambda n: spark.createDataFrame([("a", i, float(i)) for i in range(n)], "item string, frame int, value double")
    take = lambda df, c: [x.value for x in sorted(df.collect(), key=lambda x: x[c])]
    assert take(G.resample_nearest(f(5), 3), "frame") == [0, 1, 3]
    assert take(G.resample_nearest(f(3), 7), "frame") == [0, 0, 0, 1, 1, 2, 2]
    assert take(G.adaptive_average(f(5), 3), "bin") == [0.5, 2.0, 3.5]


def test_chunk_ranges(spark):
    df = spark.createDataFrame([(20.0,), (100.0,), (130.0,), (200.0,)], "duration_s double")
    got = {}
    for x in G.chunk_ranges(df).orderBy("chunk_idx").collect():
        got.setdefault(x.duration_s, []).append((x.start_s, x.stop_s))
    assert got == {20: [(0, 20)], 100: [(0, 60), (60, 100)], 130: [(0, 60), (60, 130)], 200: [(0, 60), (60, 120), (120, 200)]}


def test_interval_to_frames(spark):
    cases = [(0, 0.5), (0.25, 0.5), (0.75, 0), (4.9, 0.4), (5, 0), (5, 1), (-1, 1), (1.25, 1.25)]
    w = spark.createDataFrame([("a", i, float(o), float(d)) for i, (o, d) in enumerate(cases)], "item string, word_idx int, onset_s double, duration_s double")
    got = {}
    for x in I.interval_to_frames(w, spark.createDataFrame([("a", 10)], "item string, n_frames int"), 2.0).collect():
        got.setdefault(x.word_idx, []).append(x.frame)
    assert {k: (min(v), max(v) + 1) for k, v in got.items()} == {0: (0, 1), 1: (0, 1), 2: (2, 3), 3: (9, 10), 4: (9, 10), 7: (2, 4)}


def test_asof_counts_words_that_end_at_the_cutoff(spark):
    w = spark.createDataFrame([("a", 0, "x", 0.0, 1.0), ("a", 1, "y", 1.0, 1.0)], "item string, word_idx int, word string, onset_s double, duration_s double")
    c = spark.createDataFrame([("a", 0.5), ("a", 1.0), ("a", 2.0), ("b", 1.0)], "item string, cutoff_s double")
    assert {(x.item, x.cutoff_s): x.n_words for x in I.asof_prefix(w, c).collect()} == {("a", 0.5): 0, ("a", 1.0): 1, ("a", 2.0): 2, ("b", 1.0): 0}


def test_kernel_alignment(spark):
    x, y = [[1, 0], [0, 1], [1, 1], [2, 0]], [[1], [0], [2], [1]]
    df = spark.createDataFrame([(0, i, [float(v) for v in a], [float(v) for v in b]) for i, (a, b) in enumerate(zip(x, y, strict=True))], "group int, i long, x array<double>, y array<double>")
    assert round(P.cka_linear(df).first().cka, 6) == 0.188982
    assert round(P.cka_unbiased(df).first().cka, 6) == -0.866025
    same = df.withColumn("y", F.col("x"))
    assert math.isclose(P.cka_linear(same).first().cka, 1) and math.isclose(P.cka_rbf(same).first().cka, 1) and math.isclose(P.rsa(same).first().rsa, 1)


def test_pairs_by_blocks(spark):
    df = spark.createDataFrame([(0, i, [float(i)]) for i in range(7)], "group int, i long, x array<double>")
    got = {(r.i, r.j): r.x for r in P.pairs(df, {"x": "dot"}, block=3).collect()}
    assert got == {(i, j): float(i * j) for i in range(7) for j in range(i + 1, 7)}


def test_scores_over_blocks_equal_whole_matrices(spark):
    """Two groups, one of three blocks and one of three rows, against matrices in numpy."""
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(1100, 4)), rng.normal(size=(1100, 3))
    y[:, :2] += x[:, :2]
    made = [(1, i, x[i].tolist(), y[i].tolist()) for i in range(1100)] + [(2, i, x[i].tolist(), y[i].tolist()) for i in range(3)]
    df = spark.createDataFrame(made, "group int, i long, x array<double>, y array<double>").repartition(5)
    value = lambda scored, c: {r["group"]: r[c] for r in scored.collect()}

    upper = np.triu_indices(1100, 1)
    far = lambda z: np.sqrt(((z[:, None] - z[None]) ** 2).sum(-1))
    dx, dy = far(x), far(y)
    got = value(P.rsa(df, dissimilarity="euclidean"), "rsa")
    assert got.keys() == {1, 2} and math.isclose(got[1], np.corrcoef(dx[upper], dy[upper])[0, 1], abs_tol=1e-9)

    n, k, l = 1100, x @ x.T, y @ y.T  # noqa: E741
    np.fill_diagonal(k, 0)
    np.fill_diagonal(l, 0)
    hsic = lambda a, b: ((a * b).sum() + a.sum() * b.sum() / ((n - 1) * (n - 2)) - 2 * a.sum(0) @ b.sum(0) / (n - 2)) / (n * (n - 3))
    got = value(P.cka_unbiased(df), "cka")
    assert got.keys() == {1} and math.isclose(got[1], hsic(k, l) / (np.sqrt(hsic(k, k) * hsic(l, l)) + 1e-8), abs_tol=1e-9)

    sigma, centre = np.median(dx[upper]), np.eye(n) - 1 / n
    k, l = (centre @ np.exp(-(d**2) / (2 * sigma**2)) @ centre for d in (dx, dy))  # noqa: E741
    got = value(P.cka_rbf(df), "cka")
    assert math.isclose(got[1], (k * l).sum() / np.sqrt((k * k).sum() * (l * l).sum()), abs_tol=1e-9)


def test_split_compat_scores(spark):
    df = spark.createDataFrame([("chunk:e01a",), ("chunk:1",)], "chunk string")
    s = {x.chunk: round(x.s, 10) for x in df.select("chunk", M.compat_score(F.col("chunk"), 33).alias("s")).collect()}
    assert s == {"chunk:e01a": 0.5999035832, "chunk:1": 0.5740568882}
    out = {x.chunk: x.split for x in M.hash_split(df, compat=True).collect()}
    assert sorted(out.values()) == ["train", "val"] and out["chunk:e01a"] == "val"
    with pytest.raises(ValueError):
        M.hash_split(df, 1.0)


def test_selectors_and_paths(spark):
    assert [x[2] for x in M.parse_selectors(["s6", "s6-18b", "s06e18b", "friends/s3", "figures03"])] == ["s06", "s06e18b", "s06e18b", "s03", "figures03"]
    df = spark.createDataFrame([("/r/a",), ("",), ("b",)], "p string")
    assert [x.q for x in df.select(M.relativize(F.col("p"), "/r").alias("q")).collect()] == ["a", "", "b"]
    with pytest.raises(Exception, match="outside"):
        spark.createDataFrame([("/x/a",)], "p string").select(M.relativize(F.col("p"), "/r")).collect()
    ident = spark.range(1).select(M.store_identity(F.array(F.lit("vision"), F.lit("text"))).alias("s")).first().s
    assert ident == "ctx-text-vision"


def test_registry():
    assert registry.benchmark("friends")["season"] == 7
    for call in (lambda: registry.benchmark("none"), lambda: registry.get_extractor("none")):
        with pytest.raises(KeyError):
            call()
