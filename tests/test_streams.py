"""Timed state and exactly-once tables: batches out of order, replays, late rows and state that ends."""

import os
import random
from datetime import datetime, timedelta

import pytest

from gridwise.operators import metrics as M
from gridwise.sources import snapshots
from gridwise.streaming import results, timed
from gridwise.streaming import scores as S

DAY = datetime(2024, 1, 1)
SCHEMA = "item string, ts timestamp, word string, is_cutoff boolean"


def batches(spark, path, parts, schema):
    """A file a batch, in the order given; each is read in a batch of its own."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/{i:03d}")
        for f in (path / f"{i:03d}").glob("*.parquet"):
            f.rename(path / f"{i:03d}.parquet")
    for i in range(len(parts)):  # a file source takes files by their times
        os.utime(path / f"{i:03d}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(str(path))


def plain_last_words(rows, n, until):
    out = []
    for item, ts, _, cutoff in rows:
        if cutoff and ts < until:
            words = sorted((t, w) for i, t, w, c in rows if i == item and not c and t <= ts)
            out.append((item, ts, " ".join(w for _, w in words[-n:])))
    return out


def run(stream, out, tmp_path, name):
    with timed.rocksdb(stream.sparkSession):
        q = out.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-state")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    progress = [p for p in q.recentProgress if p["stateOperators"]]
    return out.sparkSession.read.schema(out.schema).parquet(str(tmp_path / name)), progress


def test_batches_out_of_order_give_the_batch_answer(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), DAY + timedelta(seconds=40 * i), f"w{i}", rng.random() < 0.3) for i in range(120)]
    near = [rows[i : i + 30] for i in range(0, 120, 30)]
    mixed = [list(p) for p in near]
    for a, b in ((0, 1), (1, 2), (2, 3)):  # rows swapped with the next batch, at most half an hour out of order
        for k in range(0, 15, 2):
            mixed[a][-1 - k], mixed[b][k] = mixed[b][k], mixed[a][-1 - k]
    mixed = [rng.sample(p, len(p)) for p in mixed]
    until = rows[-1][1] - timedelta(hours=1)
    until = until.replace(second=0)  # whole steps of a minute
    want = plain_last_words(rows, 3, until)
    assert len(want) > 5
    for name, parts in (("in", near), ("mixed", mixed)):
        (tmp_path / name).mkdir()
        stream = batches(spark, tmp_path / name, parts, SCHEMA)
        got, _ = run(stream, timed.last_words(stream, 3, late="1 hour", step_ms=60_000), tmp_path, f"{name}-out")
        key = lambda x: (str(x[0]), x[1])
        assert sorted(((r.item, r.ts, r.text) for r in got.collect()), key=key) == sorted(want, key=key)


def test_state_ends_and_late_rows_are_dropped(spark, tmp_path):
    at = lambda m: DAY + timedelta(minutes=m)
    parts = [
        [("a", at(0), "old", False), ("b", at(1), "x", False)],
        [("z", at(300), "y", False)],  # an hour's delay and the horizon of ten minutes have passed for a and b
        [("a", at(302), "new", False), ("a", at(5), "late", False), ("a", at(303), "", True)],
        [("z", at(600), "y", False)],
        [("z", at(900), "y", False)],
        [("z", at(900), "y", False)],
    ]
    (tmp_path / "in").mkdir()
    stream = batches(spark, tmp_path / "in", parts, SCHEMA)
    got, progress = run(stream, timed.last_words(stream, 5, late="1 hour", step_ms=60_000, keep_ms=600_000), tmp_path, "out")
    assert [(r.item, r.ts, r.text) for r in got.collect()] == [("a", at(303), "new")]  # old was forgotten, late dropped
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in progress]
    assert max(rows) > 6 and rows[-1] < max(rows)
    assert rows[-1] <= 8  # z alone is left


def test_first_rows_within_a_horizon(spark, tmp_path):
    at = lambda m: DAY + timedelta(minutes=m)
    parts = [[("a", at(3), "k"), ("a", at(0), "k"), (None, at(2), "k")], [("a", at(1), "k"), ("a", at(10), "k"), ("a", at(11), "k")], [("b", at(500), "k")], [("b", at(501), "k")]]
    (tmp_path / "in").mkdir()
    stream = batches(spark, tmp_path / "in", parts, "item string, ts timestamp, kind string")
    out = timed.first_seen(stream, ["item", "kind"], late="1 hour", step_ms=60_000, horizon_ms=600_000)
    got, progress = run(stream, out, tmp_path, "out")
    assert sorted((str(r.item), r.ts) for r in got.collect()) == [("None", at(2)), ("a", at(0)), ("a", at(11))]
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in progress]
    assert rows[-1] < max(rows)


def test_sums_count_every_batch_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(results, "MOST_PARTS", 2)  # folders are added up, too
    rng = random.Random(9)
    rows = [(rng.randrange(4), rng.random(), rng.random()) for _ in range(400)]
    schema = "parcel int, pred double, target double"
    (tmp_path / "in").mkdir()
    stream = batches(spark, tmp_path / "in", [rows[i : i + 80] for i in range(0, 400, 80)], schema)
    table = S.moment_table(stream, ["parcel"], str(tmp_path / "sums"), str(tmp_path / "state"))
    want = {r.parcel: r.asDict() for r in M.sums(spark.createDataFrame(rows, schema), ["parcel"]).collect()}

    def same():
        got = {r.parcel: r.asDict() for r in table.read().collect()}
        return got.keys() == want.keys() and all(abs(got[k][c] - want[k][c]) < 1e-9 for k in want for c in S.MOMENTS)

    assert same() and len(table.log.versions()) == 5
    again = M.sums(spark.createDataFrame(rows[:80], schema), ["parcel"])
    assert not table.add(again, 0) and not table.add(again, 4) and same()  # played again
    S.moment_table(stream, ["parcel"], str(tmp_path / "sums"), str(tmp_path / "state2"))  # the whole stream again, from an empty checkpoint
    assert same()
    with monkeypatch.context() as m:
        m.setattr(snapshots.VersionLog, "publish", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            table.add(again, 5)
    assert same()
    assert table.add(again, 5) and not same()
    assert table.add(again, 0, source="other")  # another source counts its own batches


def test_weighted_means_and_empty_tables(spark, tmp_path):
    schema = "k string, v double, w double"
    (tmp_path / "in").mkdir()
    rows = [("a", 1.0, 2.0), ("a", 4.0, 1.0), ("a", 9.0, -3.0), ("b", 5.0, 0.0), ("b", None, 2.0)]
    stream = batches(spark, tmp_path / "in", [rows[:2], rows[2:]], schema)
    table = S.weighted_mean_table(stream, ["k"], "v", "w", str(tmp_path / "sums"), str(tmp_path / "state"))
    assert {r.k: r["mean"] for r in S.finish_mean(table.read(), ["k"]).collect()} == {"a": 2.0, "b": 0.0}
    with pytest.raises(FileNotFoundError):
        results.SumTable(spark, str(tmp_path / "none"), ["k"], ["n"]).read()
