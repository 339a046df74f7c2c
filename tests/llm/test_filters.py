"""The filter audit against filters that are run one after another, and awkward rows."""

import random
from itertools import permutations

import numpy as np
import regex
from pyspark.sql import functions as F

from gridwise.llm import filteraudit as audit

DOC = "doc_id long, text string, source string, part string, mask int, h string"


def plain_audit(docs, labels):
    """(part, order, step) -> the seven counts, filter after filter over every document."""
    fails = []
    for i, text, part in docs:
        t = text or ""
        w = regex.findall(r"[^\x20\x09-\x0D]+", t)
        fails.append({
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(regex.findall("[A-Z]", t)) > 2 * len(t), "D": any(c in t for c in "#$%&*|"),
            "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs),
        })
    said = lambda i, k: any(j is not None and j == i and row[k] == 1 for j, *row in labels)
    out, removed_by = {}, {}
    for part in {p or "" for *_, p in docs}:
        mine = [k for k, d in enumerate(docs) if (d[2] or "") == part]
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [k for k in left if fails[k][f]]
                failing = [k for k in mine if fails[k][f]]
                left = [k for k in left if not fails[k][f]]
                only = sum(sum(fails[k].values()) == 1 for k in failing)
                out[part, "".join(order), step] = [len(left), len(gone), len(failing) - len(gone), only, sum(said(docs[k][0], 0) for k in gone), sum(said(docs[k][0], 1) for k in gone)]
                removed_by[part, f] = removed_by.get((part, f), 0) + len(gone)
    return {k: (*v, removed_by[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def run(spark, docs, labels):
    df = spark.createDataFrame([(*d, "p", 7, "h") for d in docs], DOC).withColumn("id", F.lit("other"))
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return audit.audit(audit.mask_cells(df, said))


def test_equals_filters_run_in_turn(spark):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(400)]
    docs = []
    for i in range(60):
        t = " ".join(rng.choices(words[: rng.choice((5, 80, 400))], k=rng.choice((0, 3, 199, 200, 230))))
        if rng.random() < 0.3:
            t = t.upper()
        if rng.random() < 0.3:
            t += rng.choice("#$%&*|") + "\t\n"
        docs.append((rng.choice((i, i, i, 3, None)), rng.choice((t, t, t, None, "", docs[0][1] if docs else t)), rng.choice(("a", "b", None, ""))))
    docs += docs[:9]  # repeated rows
    labels = [(rng.choice((i, None)), rng.choice((0, 1, None)), rng.choice((0, 1, None))) for i in range(40) for _ in range(rng.choice((1, 1, 2)))]
    got = run(spark, docs, labels)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = got.collect()
    assert len(rows) == 3 * 600
    assert {tuple(r)[:3]: tuple(r)[3:] for r in rows} == plain_audit(docs, labels)


def test_empty_tables(spark):
    assert run(spark, [], [(1, 1, 0)]).collect() == []
    rows = run(spark, [(1, None, None)], []).collect()
    assert len(rows) == 600 and {r.part for r in rows} == {""}


def test_gray_walk_equals_every_subset():
    steps = audit.gray_toggles(5)
    assert len(steps) == 31 and sorted(s for *_, s in steps) == list(range(1, 32))
    cells = np.random.default_rng(1).integers(0, 50, (4, 3, 32))
    want = np.stack([cells[..., [m for m in range(32) if not m & s]].sum(-1) for s in range(32)], axis=-1)
    assert (audit.survivors(cells, 5) == want).all()


def test_long_text_and_hot_copies(spark):
    long = "Wort " * 400_000
    docs = [(i, "same text here", "hot") for i in range(300)] + [(900, long, "hot"), (901, long, "hot")]
    last = {r.filter_order: r for r in run(spark, docs, []).collect() if r.step == 5}
    assert {r.kept for r in last.values()} == {0}
    first = next(r for r in run(spark, docs, []).collect() if r.filter_order == "EABCD" and r.step == 1)
    assert (first.kept, first.removed) == (2, 300)
