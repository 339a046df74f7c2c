"""Queries on small tables of their own that showed faults at larger sizes."""

import duckdb
import numpy as np
from pyspark.sql import Row
from pyspark.sql import functions as F

from gridwise.operators import ensemble, intervals, manifests, ordered, pairwise, sentences
from gridwise.plans import catalog, q_ensemble
from gridwise.streaming import timed


def test_best_member_of_equals_after_rounding(spark, tmp_path):
    """Member 2 is better by less than the five places that the SQL orders by: the smaller member wins."""
    rows = [(k, 1, 1, 1000.0 + 100 * k + 70 * (k * k % 5), float(k), 1e-8 * k) for k in range(1, 12)]
    schema = "l_orderkey long, l_linenumber int, l_suppkey long, l_extendedprice double, l_quantity double, l_discount double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    sql = catalog.oracle_sql()["w10_best_member"]
    exact = db.execute(sql.replace("round(avg(score), 5)", "avg(score)")).fetchall()
    assert exact[0][0] == 2
    want = db.execute(sql).fetchall()
    assert want[0][0] == 0
    assert [tuple(r) for r in catalog.queries()["w10_best_member"](spark, str(tmp_path)).collect()] == want


def test_matched_words_write_nothing_out(spark, monkeypatch):
    """While items fit a task, the match is windows over one shuffle: no step of it is written."""

    def no(*_):
        raise AssertionError("written out")

    monkeypatch.setattr(ordered, "checkpointed", no)
    monkeypatch.setattr(sentences, "checkpointed", no)
    for name in ("w9_matched_context", "w9_word_sentences", "w9_match_words"):
        assert "item" in catalog.queries()[name](spark, "/root/testdata/sf0.001").columns


def test_steps_of_a_batch_take_few_calls_of_the_store():
    """A backlog of many steps of a key is one append and one timer, not some calls for each step."""
    calls = []

    class State:
        def __init__(self, name):
            self.name, self.held = name, []

        def __getattr__(self, call):
            def do(*args):
                calls.append((self.name, call))
                return None if call == "get" and self.name != "waiting" else iter(())

            return do

    class Handle(State):
        def getListState(self, name, _):
            return State(name)

        getValueState = getMapState = getListState

    seen = timed.FirstSeen(["item"], 1000, 5000)
    seen.init(Handle("handle"))
    list(seen.handleInputRows(("a",), iter([Row(ms=1000 * i) for i in range(500)]), None))
    assert len(calls) <= 5


def test_numbers_of_a_block_are_sent_packed():
    """Sorted numbers come back to the bit, and dense ones take fewer bytes than doubles, which their pairs were sent as."""
    rng = np.random.default_rng(3)
    for v in (np.array([2.5]), np.array([-3.0, -1e-300, 0.0, 1e-300, 7.0, 1e300]), np.unique(rng.normal(size=1000)), np.array([1.0, np.nextafter(1.0, 2)])):
        bits = pairwise._ordered(v.view(np.int64))
        assert (np.diff(bits) > 0).all()
        back = pairwise._ordered(pairwise._unpacked(pairwise._packed(bits), len(v))).view(np.float64)
        assert (back == v).all()
    dense = np.unique(rng.uniform(5, 6, 100_000))
    assert len(pairwise._packed(pairwise._ordered(dense.view(np.int64)))) < 0.8 * dense.nbytes


def test_slug_is_worked_out_once(spark):
    texts = spark.createDataFrame([("a b",), ("",), ("??",), ("_x__ y_",), (None,)], "t string")
    slugs = texts.select("t", manifests.slug(F.col("t")).alias("s"))
    assert [r.s for r in slugs.collect()] == ["a_b", "stimulus", "stimulus", "x___y", None]
    assert slugs._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1


def test_rows_go_to_a_bounded_number_of_blocks(spark):
    """A row of a large group was sent to every block of its group (200 here); wide blocks are cut into tiles inside their task."""
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(2, 400, 3))
    df = spark.createDataFrame([("g", i, x[i].tolist(), y[i].tolist()) for i in range(400)], "group string, i long, x array<double>, y array<double>")
    placed, tasks = pairwise._placed(df, 2)
    assert pairwise._spread(placed, ["x"], tasks).count() <= 400 * pairwise.SPREAD
    got = {(r.i, r.j): (r.x, r.y) for r in pairwise.pairs(df, {"x": "euclidean", "y": "dot"}, block=2).collect()}
    want = {(i, j): (np.linalg.norm(x[i] - x[j]), y[i] @ y[j]) for i in range(400) for j in range(i + 1, 400)}
    assert got.keys() == want.keys()
    assert np.allclose([got[k] for k in want], list(want.values()))


def test_pairs_are_rounded_as_in_their_sql(spark):
    """Spark rounds a number's shortest digits, DuckDB the scaled number: 8506.242255 is 8506.24226 by the one, 8506.24225 by the other."""
    values = [8506.242255, 1.000015, 2.5e-5, -1.5e-5, 0.285, 1e300, -0.0]
    df = spark.createDataFrame([("g", 0, [1.0])] + [("g", k + 1, [v]) for k, v in enumerate(values)], "group string, i long, x array<double>")
    got = {r.j: r.x for r in pairwise.pairs(df, {"x": "dot"}, digits=5).filter("i = 0").collect()}
    want = [duckdb.execute("SELECT round(?::DOUBLE, 5)", [v]).fetchone()[0] for v in values]
    assert [got[k + 1] for k in range(len(values))] == want


def test_grids_of_the_step_plan_are_made_last(spark, monkeypatch):
    """The cutoffs of the grids were shuffled and grouped, some thousand a user; now they leave their cells, and the rows are the same."""
    plan = catalog.queries()["j20_joint_step_plan"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in plan and not any(s in plan.split("Generate")[0] for s in ("Exchange", "Aggregate"))

    monkeypatch.setattr(intervals, "CELL", 4)
    rng = np.random.default_rng(2)
    rows = [(int(k % 5), float(o), 0.5) for k, o in enumerate(rng.integers(-8, 40, 300) / 4)]
    rows += [(None, 1.0, 0.5), (None, 0.25, 0.0), (1, float("nan"), 0.0), (1, None, 0.0), (1, 1e12, 0.0), (7, 1.0, 0.0), (2, 0.1234567, 0.0)]
    words = spark.createDataFrame(rows, "item long, onset_s double, duration_s double")
    frames = spark.createDataFrame([(0, 1), (1, 30), (2, 9), (3, 17), (4, 0), (6, 21), (None, 3)], "item long, n_frames int")
    steps = {"a": 0.5, "b": 1.0, "c": 0.75}
    k = frames.select("item", F.explode(F.expr("filter(sequence(0, n_frames), k -> k > 0)")).alias("k"))
    want = intervals.joint_step_plan(words, {n: k.select("item", (F.col("k") * s).alias("cutoff_s")) for n, s in steps.items()})
    got = intervals.regular_step_plan(words, frames, steps)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_blended_rows_are_grouped_once_in_bounded_tasks(spark, monkeypatch):
    """Lines were grouped before and after they were dealt, and their members once more: four tables of keys, by the size of files and partitions."""
    monkeypatch.setattr(q_ensemble, "TASK_LINES", 1000)
    for name in ("a20_blend_predictions", "a21_ensemble_per_subject"):
        plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        by_row = [line for line in plan.splitlines() if "Aggregate(keys=[l_orderkey" in line or "Aggregate(keys=[row_id" in line]
        assert len(by_row) == 2  # the two steps of one grouping, in one task
    lines = q_ensemble.packed(spark, "/root/testdata/sf0.001")
    assert lines.select(F.spark_partition_id()).distinct().count() == 6


def test_packed_rows_blend_as_rows_of_members(spark):
    """Without a weight a member is left out, without any the row; null predictions add nothing."""
    preds = [[(0, 1.0), (1, 2.0)], [(1, 3.0)], [(0, None), (1, 5.0)], [(0, None)], [(2, 7.0)], [], [(0, 4.0), (1, 8.0)]]
    rows = spark.createDataFrame([(k, 1, k % 2 if k < 6 else 9, p, float(k)) for k, p in enumerate(preds)], "row_id long, subject int, parcel long, preds array<struct<member:int,pred:double>>, target double")
    weights = spark.createDataFrame([(0, 0, 0.25), (1, 0, 0.75), (0, 1, 0.5), (1, 1, None)], "member int, parcel long, weight double")
    want = ensemble.blend(ensemble.unpacked(rows), weights, ["parcel"])
    got = ensemble.blend(rows, weights, ["parcel"])
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count()


def _rank_correlation(x, y):
    """Of the distances of all pairs of rows, ties averaged."""
    upper, ranks = np.triu_indices(len(x), 1), []
    for z in (x, y):
        v = np.round(np.sqrt(((z[:, None] - z[None]) ** 2).sum(-1))[upper], 9)
        ranks.append([(v < q).sum() + (v == q).sum() / 2 for q in v])
    return np.corrcoef(*ranks)[0, 1]


def test_rank_correlations_are_proven_from_counts_of_bins(spark, monkeypatch):
    """Every pair's number and rank were shuffled (2,316 MB for 51,282 vectors); now only pairs of groups whose digits the counts leave open."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(60, 3))
    y = x + rng.normal(size=(60, 3))
    made = {"far": (x, y), "ties": (np.floor(x), np.floor(y)), "few": (x[:4], y[:4]), "one": (x[:1], y[:1]), "same": (x[:9] * 0, y[:9])}
    df = spark.createDataFrame([(g, i, a.tolist(), b.tolist()) for g, v in made.items() for i, (a, b) in enumerate(zip(*v, strict=True))], "group string, i long, x array<double>, y array<double>")
    want = {g: _rank_correlation(*v) for g, v in made.items() if g in ("far", "ties", "few")} | {"same": 0.0}
    for form in ({"block": 4, "tiles": 2}, {"block": 64}):  # many blocks and one
        got = {r.group: r for r in pairwise._bracketed(df, "x", "y", "euclidean", 3, whole=10, fine=1 << 18, part=1 << 15, **form).collect()}
        assert {g for g, r in got.items() if r.sure} == {"far", "few", "one"}
        assert [got[g].n for g in ("far", "ties", "few", "one")] == [1770, 1770, 6, 0]
        assert abs(got["far"].rsa - want["far"]) < 1e-5 and abs(got["few"].rsa - want["few"]) < 1e-12
        coarse = {r.group: r for r in pairwise._bracketed(df, "x", "y", "euclidean", 3, whole=10, fine=100, **form).collect()}
        assert {g for g, r in coarse.items() if r.sure} == {"few", "one"} and abs(coarse["far"].rsa - want["far"]) < 1e-2

    ordered, bracketed = [], pairwise._bracketed
    exact = pairwise._rank_moments
    monkeypatch.setattr(pairwise, "_bracketed", lambda *a: bracketed(*a, block=4, tiles=2, whole=10, fine=1 << 18))
    monkeypatch.setattr(pairwise, "_rank_moments", lambda rows, *a: ordered.extend(r.group for r in rows.select("group").distinct().collect()) or exact(rows, *a))
    got = {r.group: r for r in pairwise.rsa(df, dissimilarity="euclidean", similarity="spearman", digits=3).collect()}
    assert sorted(ordered) == ["same", "ties"]
    assert got.keys() == want.keys()
    assert all(round(got[g].rsa, 3) == round(v, 3) and got[g].loss == 1 - got[g].rsa for g, v in want.items())


def test_bounds_hold_for_any_bins():
    """Of random groups with and without ties, the sums of true ranks lie within the bounds that the counts give."""
    rng = np.random.default_rng(12)
    for k in range(60):
        n = int(rng.integers(2, 400))
        a = rng.normal(size=n) if k % 2 else rng.integers(0, 9, n).astype(float)
        b = a * rng.normal() + rng.normal(size=n)
        ra, rb = pairwise._exact_ranks(a), pairwise._exact_ranks(b)
        ranks, bounds = [], []
        for v in (a, b):
            bins = pairwise._Bins("dot", np.sqrt(np.abs(v).max()), 7, int(rng.integers(7, 200)))
            counts = bins.cut(bins.counted([v])).filled([v])
            assert counts.sum() == n and (np.diff(bins.bins(np.sort(v))) >= 0).all()
            r, own = pairwise._mean_ranks([counts[:5], counts[5:]])
            ranks.append(r[bins.bins(v)])
            bounds.append(own)
        (sa, ea, la, eva, fa), (sb, eb, lb, evb, fb) = bounds
        assert np.isclose(sa, ranks[0] @ ranks[0]) and sa - 1e-6 <= ra @ ra <= sa + ea + 1e-6
        far, rest = (n - 1) / 2, [abs((ra - ranks[0]) @ ranks[1]), abs((rb - ranks[1]) @ ranks[0])]
        for off, e, s, l, ev, f in ((rest[0], ea, sb, la, eva, fa), (rest[1], eb, sa, lb, evb, fb)):  # noqa: E741
            assert off <= min(np.sqrt(e * s), l * far, np.sqrt(ev * s) + f * far) + 1e-6
        assert abs((ra - ranks[0]) @ (rb - ranks[1])) <= np.sqrt(ea * eb) + 1e-6


def test_rows_do_not_carry_the_ranges_of_their_group(spark, monkeypatch):
    """The ranges of a group's numbers, an entry for each million pairs, were joined to every row and sent with it to every block."""
    sent, spread = [], pairwise._spread
    monkeypatch.setattr(pairwise, "_spread", lambda rows, columns, tasks: sent.append(columns) or spread(rows, columns, tasks))
    df = spark.createDataFrame([("g", i, [float(i)], [float(i % 3)]) for i in range(9)], "group string, i long, x array<double>, y array<double>")
    part = pairwise._rank_moments(df, "x", "y", "euclidean", 2).collect()
    assert sum(r.n for r in part) == 36 and all(c == ["x", "y"] for c in sent)
