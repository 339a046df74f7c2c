"""Table digests, functions that Spark lacks, and tokens in keys, against plain Python and numpy."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwise.functions import special
from gridwise.operators import digests
from gridwise.operators import manifests as M
from gridwise.sources import manifests as source

SCHEMA = "a string, b string, n long"


def plain_digest(columns, rows, levels, digits=3):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    text = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    header = "".join(f"{len(columns[i].encode())}:{columns[i]}" for i in order) + ","
    counts = {}
    for r in rows:
        h = sha(",".join(text(r[i]) for i in order))
        counts[h] = counts.get(h, 0) + 1

    def node(prefix, level):
        mine = sorted(h for h in counts if h.startswith(prefix))
        if level == levels:
            entries = [f"{h}x{counts[h]}" for h in mine]
        else:
            entries = [f"{p}x{node(p, level + 1)}" for p in sorted({h[: digits * (level + 1)] for h in mine})]
        return sha((header if level == 0 else "") + ",".join(entries))

    return node("", 0)


@pytest.mark.parametrize("levels", [0, 1, 2])
def test_digest_equals_a_plain_tree(spark, levels):
    rng = random.Random(levels)
    rows = [(rng.choice([None, "", "x", "é\t", "5:x"]), rng.choice(["", "y", None]), rng.randrange(4)) for _ in range(80)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = digests.table_digest(df, levels).first()
    assert (got.n, got.hash) == (80, plain_digest(["a", "b", "n"], rows, levels))
    other = df.select("n", "b", "a").repartition(7)
    assert digests.table_digest(other, levels).first().hash == got.hash  # order of rows and columns


def test_what_changes_a_digest(spark):
    of = lambda rows, schema=SCHEMA: M.table_hash(spark.createDataFrame(rows, schema)).first().hash
    base = of([("x", "y\tz", 1)])
    assert base != of([("x\ty", "z", 1)]) and base != of([("x", "y\tz", 1)], "a string, c string, n long") and base != of([("x", "y\tz", 1)] * 2)
    assert of([(None, "", 1)]) != of([("", None, 1)]) != of([("", "", 1)]) and of([("-", "", 1)]) != of([(None, "", 1)])
    assert of([("1:a,1:b", "c", 1)]) != of([("1:a", "1:b,c", 1)])
    empty = M.table_hash(spark.createDataFrame([], SCHEMA)).first()
    assert empty.n == 0 and empty.hash == plain_digest(["a", "b", "n"], [], 0) != M.table_hash(spark.createDataFrame([], "a string")).first().hash
    assert [digests.tree_levels(n) for n in (0, 1024, 1025, 4_194_304, 4_194_305)] == [0, 0, 1, 1, 2]


def test_a_damaged_bundle_is_not_loaded(spark, tmp_path):
    df = spark.createDataFrame([("x", "y", 1)], SCHEMA)
    source.save_bundle(dict.fromkeys(source.BUNDLE, df), str(tmp_path))
    assert set(source.load_bundle(spark, str(tmp_path))) == set(source.BUNDLE)
    df.withColumnRenamed("b", "c").write.mode("overwrite").parquet(f"{tmp_path}/{source.BUNDLE[1]}")
    with pytest.raises(ValueError, match=source.BUNDLE[1]):
        source.load_bundle(spark, str(tmp_path))


def test_erf_and_gelu(spark):
    x = [0.0, -0.0, 1e-300, 0.25, -0.25, 0.2499999999, 5.999, 6.0, -7.0, 40.0, math.inf, -math.inf, *np.random.default_rng(1).normal(0, 2, 500).tolist()]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    for r in df.select("x", special.erf(F.col("x")).alias("e"), special.gelu(F.col("x")).alias("g")).collect():
        assert abs(r.e - math.erf(r.x)) < 1e-13
        if math.isfinite(r.x):
            assert abs(r.g - r.x * 0.5 * (1 + math.erf(r.x / math.sqrt(2)))) < 1e-12
    odd = spark.createDataFrame([(math.nan,), (None,)], "x double").select(special.erf(F.col("x")).alias("e")).collect()
    assert math.isnan(odd[0].e) and odd[1].e is None


def test_half_precision_equals_numpy(spark):
    edges = [0.0, -0.0, 1.0, 2048.0, 2049.0, 2051.0, 65504.0, 65519.99, 65520.0, 1e9, 2.0**-14, 2.0**-24, 2.0**-25, 2.0**-25 * 1.0001, 3 * 2.0**-25, 1e-12, 0.1, 1 / 3, math.inf, 1 + 2.0**-11, 1 + 3 * 2.0**-11, np.nextafter(2.0, 0), np.nextafter(0.5, 1), 5e-324]
    x = [*edges, *[-v for v in edges], *np.random.default_rng(2).normal(0, 1, 300).tolist(), *(2.0 ** np.random.default_rng(3).uniform(-27, 17, 400)).tolist()]
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    with np.errstate(over="ignore"):
        for r in df.select("x", special.half_precision(F.col("x")).alias("h")).collect():
            assert r.h == float(np.float16(r.x)), r.x
    odd = spark.createDataFrame([(math.nan,), (None,)], "x double").select(special.half_precision(F.col("x")).alias("h")).collect()
    assert math.isnan(odd[0].h) and odd[1].h is None


@pytest.mark.parametrize("chars", [20_000_000, 6])
def test_tokens_in_keys(spark, monkeypatch, chars):
    monkeypatch.setattr(M, "AUTOMATON_CHARS", chars)
    tokens = ["a", "ab", "abab", "é", "", None, "zz", "b", "a"]
    keys = ["xabab", "é1", "zz", "zz", "q", "", None, "bb"]
    df = spark.createDataFrame([(t,) for t in tokens], "token string")
    ks = spark.createDataFrame([(k,) for k in keys], "key string")
    hold = {t: {k for k in keys if k and t and t in k} for t in tokens}
    got = [(r.token, r.key) for r in M.match_unique_key(df, ks, "token", contains=True).collect()]
    assert sorted(map(str, got)) == sorted(str((t, next(iter(hold[t])) if len(hold[t]) == 1 else "")) for t in tokens)
    assert M.match_unique_key(df.filter("token = ''"), ks, "token", contains=True).first().key == ""
    plan = M._contained(df.filter("token <> ''").select(F.col("token").alias("__t")), ks.select(F.col("key").alias("__key")))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan


def test_validation_rows_and_user_lists(spark, tmp_path):
    rows = spark.createDataFrame([(7, "s", "extra")], "row_index long, subject string, other string")
    source.write_val_rows(rows, str(tmp_path / "v"))
    back = spark.read.csv(str(tmp_path / "v"), sep="\t", header=True)
    assert tuple(back.columns) == source.VAL_ROWS and back.first().row_index == "7" and back.first().chunk is None
    (tmp_path / "list.tab").write_text("video_path\tnote\tstimulus_id\n/v/a\tx\ta\n")
    assert source.read_user_manifest(spark, str(tmp_path / "list.tab")).collect() == [("a", "/v/a", "x")]
    (tmp_path / "list.csv").write_text("video_path,note\n/v/a,x\n")
    with pytest.raises(Exception, match="stimulus_id"):
        source.read_user_manifest(spark, str(tmp_path / "list.csv"))
