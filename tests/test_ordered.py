"""Running sums, ranks, medians and blocks against plain Python, with a key that holds most rows."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridwise.operators import grid as G
from gridwise.operators import intervals as I
from gridwise.operators import manifests as M
from gridwise.operators import ordered as O
from gridwise.operators import pairwise as P


@pytest.fixture(params=[0, 1_000_000], ids=["spread", "windows"], autouse=True)
def task_rows(request, monkeypatch):
    """Every test runs in both forms, keys spread over ranges and keys in plain windows."""
    monkeypatch.setattr(O, "TASK_ROWS", request.param)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    made = [(rng.choice([None, "a", "b", "hot", "hot", "hot", "hot"]), i, rng.choice([None, 1.0, 2.5, float(i)])) for i in range(900)]
    rng.shuffle(made)
    return spark.createDataFrame(made, "k string, i long, v double").repartition(7)


def test_running_sums_equal_a_window(spark, rows):
    held = spark.conf.get("spark.sql.adaptive.enabled")
    by = W.partitionBy("k").orderBy("i")
    want = rows.select("k", "i", F.coalesce(F.sum("v").over(by), F.lit(0.0)).alias("s"), F.coalesce(F.sum("v").over(W.partitionBy("k")), F.lit(0.0)).alias("t"))
    for adaptive in ("true", "false"):  # one range, and several of them
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        got = O.running(rows, ["k"], ["i"], {"s": F.col("v")}, {"s": "t"}).select("k", "i", F.col("s"), F.col("t"))
        key = lambda r: (str(r.k), r.i, round(r.s, 6), round(r.t, 6))
        assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
    spark.conf.set("spark.sql.adaptive.enabled", held)
    assert O.running(rows.limit(0), ["k"], ["i"], {"s": F.col("v")}).collect() == []


def test_average_ranks_and_medians_with_ties_and_nulls(rows):
    by = {}
    for r in rows.collect():
        by.setdefault(r.k, []).append(r.v)
    place = lambda v: (v is not None, v or 0)  # nulls first
    rank = lambda vs, v: sum(place(x) < place(v) for x in vs) + (vs.count(v) - 1) / 2
    got = O.average_ranks(rows, ["k"], "v", "r").collect()
    assert len(got) == rows.count() and all(r.r == rank(by[r.k], r.v) for r in got)
    medians = {r.k: r.m for r in O.medians(rows, ["k"], "v", "m").collect()}
    assert medians == {k: statistics.median([v for v in vs if v is not None]) for k, vs in by.items()}


def test_median_of_nulls_alone(spark):
    df = spark.createDataFrame([("a", None), ("b", 2.0), ("b", 5.0)], "k string, v double")
    assert {r.k: r.m for r in O.medians(df, ["k"], "v", "m").collect()} == {"a": None, "b": 3.5}


@pytest.mark.parametrize("size", [3, 7, 1000])
def test_blocks_see_their_neighbours(rows, size):
    near = W.partitionBy("k", "__block").orderBy("__n").rowsBetween(-3, 2)
    got = O.blocks(rows, ["k"], ["i"], back=3, ahead=2, size=size).withColumn("near", F.collect_list("i").over(near)).filter("__own")
    want = rows.withColumn("near", F.collect_list("i").over(W.partitionBy("k").orderBy("i").rowsBetween(-3, 2)))
    key = lambda r: (str(r.k), r.i, tuple(r.near))
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))


def test_filters_and_contexts_cross_blocks(spark, monkeypatch):
    whole = O.blocks
    small = lambda *a, **k: whole(*a, **{**k, "size": 4})
    monkeypatch.setattr(G, "blocks", small)
    monkeypatch.setattr(I, "blocks", small)
    f = spark.createDataFrame([("a", i, float(i)) for i in range(11)], "item string, frame int, value double")
    got = [r.value for r in G.fir_filter(f, [1.0, 0.0, 10.0]).orderBy("frame").collect()]
    assert got == [(i - 1 if i else 0) + 10 * (i + 1 if i < 10 else 0) for i in range(11)]
    w = spark.createDataFrame([("a", i, f"w{i}", i // 5 if i != 6 else None) for i in range(11)], "item string, word_idx int, word string, sentence_idx int")
    near = {r.word_idx: r.context for r in I.running_context(w, 5).collect()}
    assert near == {i: " ".join(f"w{j}" for j in range(max(0, i - 5), i + 1)) for i in range(11)}
    sentence = {r.word_idx: r.context for r in I.sentence_context(w, 2).collect()}
    assert (sentence[5], sentence[6], sentence[7], sentence[10]) == ("w3 w4 w5", "", "w7", "w8 w9 w10")


def test_kernels_and_ranks_of_pairs(spark, task_rows, monkeypatch):
    """Medians and ranks from histograms, over several blocks, ranges of few numbers, ties and groups of one and two rows."""
    monkeypatch.setattr(P, "RANGE", 50)
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(40, 3)), rng.integers(0, 3, size=(40, 3)).astype(float)  # y has ties
    made = [("all", i, x[i].tolist(), y[i].tolist()) for i in range(40)] + [("two", i, x[i].tolist(), x[i].tolist()) for i in range(2)] + [("one", 0, x[0].tolist(), y[0].tolist())]
    df = spark.createDataFrame(made, "group string, i long, x array<double>, y array<double>")
    far = lambda z: np.sqrt(((z[:, None] - z[None]) ** 2).sum(-1))
    dx, dy, upper = far(x), far(y), np.triu_indices(40, 1)
    sides = [np.concatenate([[(np.round(v, 9) < q).sum() + ((np.round(v, 9) == q).sum() - 1) / 2 for q in np.round(v, 9)]]) for v in (dx[upper], dy[upper])]
    for block in (512, 16):
        part = P._rank_moments(df, "x", "y", "euclidean", block).collect()
        n = sum(r.n for r in part if r.group == "all")
        mean = [sum(r.n * r[c] for r in part if r.group == "all") / n for c in ("ma", "mb")]
        ab, aa, bb = (sum(r[p + q] + r.n * (r["m" + p] - mean[p == "b"]) * (r["m" + q] - mean[q == "b"]) for r in part if r.group == "all") for p, q in ("ab", "aa", "bb"))
        assert n == 780 and {r.group for r in part} == {"all", "two"}
        assert abs(ab / np.sqrt(aa * bb) - np.corrcoef(*sides)[0, 1]) < 1e-9
        sigma = {r.group: r.sigma for r in P.median_distance(df, "x", block=block).collect()}
        assert sigma.keys() == {"all", "two"} and abs(sigma["all"] - np.median(dx[upper])) < 1e-9 and abs(sigma["two"] - dx[0, 1]) < 1e-9
        assert abs({r.group: r.sigma for r in P.median_distance(df, "y", block=block).collect()}["all"] - np.median(dy[upper])) < 1e-9
    assert abs({r.group: r.rsa for r in P.rsa(df, dissimilarity="euclidean", similarity="spearman").collect()}["all"] - np.corrcoef(*sides)[0, 1]) < 1e-9
    sigma, centre = np.median(dx[upper]), np.eye(40) - 1 / 40
    k, l = (centre @ np.exp(-(d**2) / (2 * sigma**2)) @ centre for d in (dx, dy))  # noqa: E741
    assert abs(P.cka_rbf(df.filter("group = 'all'")).first().cka - (k * l).sum() / np.sqrt((k * k).sum() * (l * l).sum())) < 1e-9


def test_bins_keep_the_order_of_numbers():
    v = np.array([-np.inf, -3.5, -1e-300, -0.0, 0.0, 5e-324, 1e-9, 0.1, 1.0, 1.5, 7e300, np.inf])
    assert (np.diff(P._bins(v)) >= 0).all() and P._bins(v)[3] == P._bins(v)[4]


def test_keys_that_contain_a_token(spark):
    docs = spark.createDataFrame([("s1",), ("e02",), ("none",), ("",), (None,)], "token string")
    keys = spark.createDataFrame([("ses-1_s1e02",), ("ses-2_s2e02",), ("e02",)], "key string")
    got = {r.token: r.key for r in M.match_unique_key(docs, keys, "token", contains=True).collect()}
    assert got == {"s1": "ses-1_s1e02", "e02": "", "none": "", "": "", None: ""}
    assert {r.token: r.key for r in M.match_unique_key(docs, keys, "token").collect()}["e02"] == "e02"


def test_compat_scores_of_many_keys(spark):
    import hashlib

    df = spark.createDataFrame([(f"movie:{i:03d}",) for i in range(100)], "chunk string")
    want = {k: random.Random(int(hashlib.sha256(k.encode()).hexdigest(), 16) + 33).random() >= 0.9 for k in (f"movie:{i:03d}" for i in range(100))}
    assert any(want.values())
    assert {r.chunk: r.split == "val" for r in M.hash_split(df, compat=True).collect()} == want
