"""The pipeline against a brute-force version that shares no code with it: SQL for the rules and leaks, plain Python for lines, near copies and (through the tokenizers library) tokens."""

import hashlib
import os
import random
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridwise.llm import bpe, linetree, q_decontam, q_quality

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def near_copy_roots(texts):
    """Components of the pairs with a 5-word Jaccard similarity of 0.8 or more: each text's first one."""
    sets, root = [], list(range(len(texts)))
    for t in texts:
        w = t.encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


def one_of_each_near_copy(docs):
    return [d for i, (d, r) in enumerate(zip(docs, near_copy_roots([t for _, t in docs]), strict=True)) if r == i]


def line_templates(kinds):
    """Template of each kind of line (tuples of tokens, None for a field) of one leaf, by the rule of the docstring."""
    counts = Counter((p, t) for k in kinds for p, t in enumerate(k))
    out = {}
    for k in kinds:
        own = [(p, t, counts[p, t]) for p, t in enumerate(k) if p >= 3 and t is not None]
        if own:
            middle = sorted(n for *_, n in own)[len(own) // 2]
            fixed = tuple((p, t) for p, t, n in own if 2 * n > middle)
            out[k] = (len(k), k[:3], fixed) if 10 * len(fixed) >= 7 * len(own) else k
        else:
            out[k] = k
    return out


def lines_kept(docs):
    """Recurring lines go everywhere; near copies count as one document, and two are enough for over 50 tokens."""
    rows, leaves = [], defaultdict(set)
    for (i, t), cls in zip(docs, near_copy_roots([t for _, t in docs]), strict=True):
        for n, line in enumerate(t.split("\n")):
            if k := tuple(None if any(c in b"0123456789" for c in w) else w for w in line.encode().split()):
                rows.append((i, n, cls, k))
                leaves[len(k), k[:3]].add(k)
    template = {k: x for kinds in leaves.values() for k, x in line_templates(kinds).items()}
    support, gone = defaultdict(set), defaultdict(set)
    for _, _, cls, k in rows:
        support[template[k]].add(cls)
    for i, n, _, k in rows:
        if len(support[template[k]]) >= (2 if len(k) > 50 else 3):
            gone[i].add(n)
    return [(i, "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i])) for i, t in docs]


def test_pipeline(spark):
    tokenizers = pytest.importorskip("tokenizers")
    con = duckdb.connect()
    kept = con.execute(f"WITH {q_quality.RATED % f"'{SF}/documents.parquet'"} SELECT doc_id, kept_text FROM rated WHERE kept ORDER BY doc_id").fetchall()
    docs = one_of_each_near_copy(lines_kept(kept))
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{SF}/benchmark.parquet'")
    bad = {r[0] for r in con.execute(q_decontam.SQL).fetchall()}
    tk = tokenizers.Tokenizer.from_file(bpe.default_path())
    want = set()
    for i, t in docs:
        if i not in bad:
            ids = tk.encode(t, add_special_tokens=False).ids
            want.add((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()))
    got = {(r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and bad


def test_line_templates_equal_brute_force(spark):
    """Few leaves, many fields, copies and edited copies: every document is as the rule says."""
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    names = [word() for _ in range(60)]
    frames = [["hello", "dear", "reader", *[word() for _ in range(n)]] for n in (4, 6, 8, 8, 57, 57)]
    texts = []
    for i in range(150):
        lines = []
        for frame in rng.sample(frames, 2):
            w = list(frame)
            for at in rng.sample(range(3, len(w)), 1 if len(w) < 12 else 2):
                w[at] = rng.choice(names)
            lines.append(" ".join(w))
        lines += [" ".join(["hello", "dear", "reader", *[rng.choice(names[:9]) for _ in range(rng.choice((4, 8)))]]), f"page {i} of {rng.randrange(9)}", " ".join(word() for _ in range(40))]
        rng.shuffle(lines)
        texts.append("\n".join(lines))
    texts += [texts[0], texts[0], texts[1].replace("hello", "Hello", 1), "", "\n\n \t\n", " \n".join(texts[2].split("\n"))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in linetree.drop_recurring(docs.withColumns({"n_lines": F.lit("x"), "n_dropped": F.lit(1)})).collect()}
    want = lines_kept(list(enumerate(texts)))
    assert [(i, rows[i].text) for i in range(len(texts))] == want
    assert sum(t == x for (_, t), x in zip(want, texts, strict=True)) < 20
    assert rows[0].n_lines == 5


def test_stages_keep_the_columns_and_take_empty_tables(spark):
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, SF)
        assert out.count() == 0
        assert name == "tokenize" or out.columns == empty.columns
