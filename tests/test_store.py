"""The versioned feature store: what a reader sees, which files a commit writes, and writers that die or meet."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gridwise.sources import features as S
from gridwise.sources import snapshots


def rows(spark, items, value=1.0):
    made = [(i, layer, frame, frame / 2, [value * k for k in range(3)]) for i in items for layer in range(2) for frame in range(4)]
    return spark.createDataFrame(made, "item string, layer int, frame int, t_s double, vec array<double>")


def seen(store):
    return sorted((r.item, r.layer, r.frame, r.t_s, tuple(r.vec)) for r in store.read().collect())


def counts(df):
    return {r.status: r.n for r in df.collect()}


def files(path):
    return {p for p in Path(path).rglob("*.parquet") if p.is_file() and "/data/" in str(p)}


def test_writes_skips_replaces_and_deletes(spark, tmp_path):
    s = S.FeatureStore(spark, str(tmp_path / "s"))
    assert not s.exists()
    with pytest.raises(FileNotFoundError):
        s.list_keys()
    assert counts(s.write(rows(spark, ["a", "b", "c"]))) == {"ok": 3}
    assert counts(s.write(rows(spark, ["b", "d"], 5.0))) == {"ok": 1, "skip": 1}
    want = seen(s)
    assert want == sorted((r.item, r.layer, r.frame, r.t_s, tuple(r.vec)) for r in rows(spark, ["a", "b", "c"]).union(rows(spark, ["d"], 5.0)).collect())
    before = files(tmp_path / "s")
    stamps = {p: p.stat().st_mtime_ns for p in before}
    assert counts(s.write(rows(spark, ["b"], 9.0), overwrite=True)) == {"ok": 1}
    new = files(tmp_path / "s") - before
    assert {p: p.stat().st_mtime_ns for p in before} == stamps  # no older file was touched ...
    assert {r.item for p in new for r in spark.read.parquet(str(p)).select("item").collect()} == {"b"}  # ... and the new ones hold the item alone
    assert {r.vec[1] for r in s.read().filter("item = 'b'").collect()} == {9.0} and s.read().count() == 32
    s.delete(spark.createDataFrame([("a",), ("none",)], "item string"))
    assert sorted(r.item for r in s.list_keys().collect()) == ["b", "c", "d"] and s.read().filter("item = 'a'").count() == 0
    assert seen(S.FeatureStore(spark, str(tmp_path / "s"), version=1)) == want  # an earlier version
    some = spark.createDataFrame([("b",), ("a",)], "item string")
    assert {r.item for r in s.read(some).collect()} == {"b"} and s.read_slice((0, 1), (1, 3), (1, 2), some).count() == 2
    s.delete(s.list_keys())
    assert s.read().collect() == [] and s.read().columns == ["item", "layer", "frame", "t_s", "vec"] and s.list_keys().count() == 0


def test_keys_and_shapes_come_from_the_index(spark, tmp_path):
    s = S.FeatureStore(spark, str(tmp_path / "s"))
    s.write(rows(spark, ["a", "b"]))
    shapes = s.shape()
    assert {tuple(r) for r in shapes.collect()} == {("a", 2, 4, 3), ("b", 2, 4, 3)}
    for df in (shapes, s.list_keys()):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "vec" not in plan and all("/index/" in f for f in df.inputFiles())
    index = s.index().collect()
    names = {p.name for p in files(tmp_path / "s")}
    assert {r.n_values for r in index} == {24} and {f for r in index for f in r["files"]} == names


def test_a_writer_that_dies_before_publishing(spark, tmp_path, monkeypatch):
    s = S.FeatureStore(spark, str(tmp_path / "s"))
    s.write(rows(spark, ["a"]))
    want = seen(s)

    def dies(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(snapshots.VersionLog, "publish", dies)
        for overwrite in (True, False):
            with pytest.raises(RuntimeError, match="lost"):
                s.write(rows(spark, ["a", "b"], 7.0), overwrite)
    assert len(files(tmp_path / "s")) > 1 and seen(s) == want and [r.item for r in s.list_keys().collect()] == ["a"]
    assert counts(s.write(rows(spark, ["a", "b"], 7.0), overwrite=True)) == {"ok": 2} and {r.vec[1] for r in s.read().collect()} == {7.0}


def test_writers_that_meet(spark, tmp_path, monkeypatch):
    """Another writer publishes between this one's reading and its publishing; both commits stand."""
    path = str(tmp_path / "s")
    s, other = S.FeatureStore(spark, path), S.FeatureStore(spark, path)
    s.write(rows(spark, ["a"]))
    publish, calls = snapshots.VersionLog.publish, []

    def late(self, version, content):
        if not calls:
            calls.append(version)
            other.write(rows(spark, ["b", "c"], 3.0))
        publish(self, version, content)

    monkeypatch.setattr(snapshots.VersionLog, "publish", late)
    assert counts(s.write(rows(spark, ["c", "d"], 4.0))) == {"ok": 1, "skip": 1}  # c was there first
    assert {(r.item, r.vec[1]) for r in s.read().collect()} == {("a", 1.0), ("b", 3.0), ("c", 3.0), ("d", 4.0)}
    monkeypatch.setattr(snapshots.VersionLog, "publish", publish)
    with pytest.raises(snapshots.VersionTaken):
        s.log.publish(0, {})
    assert s.log.versions() == [0, 1, 2]


def test_inventory_counts_the_files_that_are_needed(spark, tmp_path):
    path = str(tmp_path / "text")
    s = S.FeatureStore(spark, path)
    s.write(rows(spark, ["a", "b"]).coalesce(1))
    first = S.cache_inventory(spark, {"text": path, "audio": str(tmp_path / "none")}).collect()
    size = sum(p.stat().st_size for p in files(path))
    assert [tuple(r) for r in first] == [("audio", str(tmp_path / "none"), False, 0, 0, 0), ("text", path, True, 2, 48, size)]
    s.write(rows(spark, ["a", "b"], 2.0).withColumn("vec", F.slice("vec", 1, 2)), overwrite=True)
    then = S.cache_inventory(spark, {"text": path}).first()
    assert (then.n_keys, then.n_values) == (2, 32) and then.n_bytes == sum(p.stat().st_size for p in files(path)) - size
