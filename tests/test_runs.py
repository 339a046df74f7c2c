"""Artefacts of runs: missing parts, replaced runs, and the report's rules."""

import math
import uuid

import pytest

from gridwise.functions.session import shared_folder
from gridwise.sources import runs as R


def tables(spark, **rows):
    return {name: spark.createDataFrame(r, R.ARTEFACTS[name]) for name, r in rows.items()}


@pytest.fixture
def root(spark):
    return f"{shared_folder(spark)}/runs-{uuid.uuid4().hex}"


def report(spark, root, **more):
    return {r.run: r for r in R.runs_report(R.read_run_artefacts(spark, root), **more).collect()}


def test_parts_of_a_run_may_be_missing(spark, root):
    assert report(spark, root) == {}
    scores = [("a", i, x) for i, x in enumerate([0.1, 0.2, 0.3, 0.4, math.nan, None])]
    R.write_run_artefacts(tables(spark, parcels=scores, metrics=[("b", "val/pearson", 0.25), ("b", "loss", 1.5), ("c", "loss", 2.0)]), root)
    got = report(spark, root)
    a, b, c = got["a"], got["b"], got["c"]
    assert (a["mean"], a.median, a.p10, a.p90, a.n_positive) == (0.25, 0.25, 0.13, 0.37, 4)
    assert (b["mean"], b.median, b.n_positive, b.metrics) == (0.25, None, -1, {"val/pearson": 0.25, "loss": 1.5})
    assert (c["mean"], c.verdict, c.per_subject, c.subject_mean, c.run_name) == (None, "SKIPPED", {}, None, None)


def test_settings_stand_behind_what_is_given(spark, root):
    R.write_run_artefacts(tables(spark, parcels=[("a", 0, 0.5), ("b", 0, 0.5)], subjects=[("a", "s1", 0.4), ("a", "s2", 0.7), ("a", "s2", 0.6)], settings=[("a", "first", 0.45, 0.1), ("b", "other", 0.45, None)]), root)
    got = report(spark, root)
    assert (got["a"].verdict, got["b"].verdict, got["b"].tolerance) == ("PASS", "FAIL", 0.02)
    assert (got["a"].per_subject, got["a"].subject_mean, got["a"].run_name) == ({"s1": 0.4, "s2": 0.7}, 0.55, "first")
    assert {r.verdict for r in report(spark, root, reference=0.5).values()} == {"PASS"}
    assert {r.verdict for r in report(spark, root, reference=0.0, tolerance=0.3).values()} == {"FAIL"}
    R.write_run_artefacts(tables(spark, metrics=[("d", "loss", 1.0)]), root)
    assert report(spark, root, reference=0.5)["d"].verdict == "FAIL"  # a reference, but no value


def test_a_run_written_again_replaces_its_rows_only(spark, root):
    R.write_run_artefacts(tables(spark, parcels=[("a", 0, 0.5), ("a", 1, 0.7), ("b", 0, 0.5)]), root)
    R.write_run_artefacts(tables(spark, parcels=[("a", 0, 0.1)]), root)
    got = report(spark, root)
    assert (got["a"]["mean"], got["b"]["mean"]) == (0.1, 0.5)
    with pytest.raises(ValueError, match="unknown artefacts"):
        R.write_run_artefacts({"plots": None}, root)
