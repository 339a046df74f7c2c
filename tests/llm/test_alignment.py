"""Alignment of two tokenizers against the libraries on whole texts and a plain count of links."""

import hashlib
import os
import random
from collections import Counter

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from gridwise.llm import q_align, tokenalign

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def plain(libraries, text):
    """(ids of A, ids of B, groups, links) of one text by both libraries and a walk over byte ends."""
    a, b = libraries
    if not text:
        return [], [], [], []
    value = {}
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    for i in shown:
        value[chr(i)] = i
    for k, i in enumerate([i for i in range(256) if i not in shown]):
        value[chr(256 + k)] = i
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(value[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return [], [], [], []
    ends_a, ends_b, at = {}, {}, 0
    for k, t in enumerate(bytes_a):
        at += len(t)
        ends_a[at] = k
    at = 0
    for k, t in enumerate(bytes_b):
        at += len(t)
        ends_b[at] = k
    groups, links, i, j = [], [], 0, 0
    for end in sorted(ends_a.keys() & ends_b.keys()):
        k, m = ends_a[end], ends_b[end]
        groups.append(",".join(map(str, ids_a[i : k + 1])) + "|" + ",".join(map(str, ids_b[j : m + 1])))
        links.append((ids_a[k], ids_b[m]))
        i, j = k + 1, m + 1
    return ids_a, ids_b, groups, links


def expected(libraries, texts):
    done = [plain(libraries, t) for t in texts]
    count = Counter(link for *_, links in done for link in links)
    top = {}
    for (_, b), n in count.items():
        top[b] = max(top.get(b, 0), n)
    return [
        (len(a), len(b), len(groups), len(links), sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else "")
        for a, b, groups, links in done
    ]


ODD = [
    None, "", " ", "  ", "a", " a", "a ", "  two  blanks  ", "\n", "x\n y", "tab\t tab", "a  b", "a 　b", "\u0085 x", "▁", "a ▁b", "<|endoftext|> <s> </s> <unk>", "don't I'll we've",
    "漢字かな", "é é", "🙂🙃 👩‍👩‍👧", "\x00 \x01", "﻿ x ﻿y", "a᠎ b", "​ ‍", "1234567 12 3", "x" * 3000, "a  b   c    d", "end\n", "ﷺ ﬁ ½", "\r\n a", "İI ıi",
]


def random_texts(n, seed=11):
    rng = random.Random(seed)
    signs = ["the", "Ungeheuer", " ", " ", " ", "  ", "\n", "\t", "'s", "é", "漢", "1", "_", "-", " ", "🙂", "<s>", "ing", "A", ".", " ", "\x1c"]
    return ["".join(rng.choices(signs, k=rng.randrange(40))) for _ in range(n)]


def columns(df):
    return [tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in df.collect()]


def test_equals_libraries_on_odd_texts(spark, libraries, monkeypatch):
    texts = ODD + random_texts(600)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, groups string, pairs int").repartition(3)
    rows = tokenalign.alignment(docs).orderBy("doc_id")
    assert columns(rows) == expected(libraries, texts)
    groups = {r.doc_id: r.groups for r in tokenalign.aligned(docs).collect()}
    assert all(groups[i] == ";".join(plain(libraries, t)[2]) for i, t in enumerate(texts))


def test_small_stretches_and_forgotten_words(libraries, monkeypatch):
    """Cut texts, words and windows that are dropped and met again, and hashes that collide change nothing."""
    import pyarrow as pa

    texts = ODD + random_texts(200, 3) + ["one two three four five six seven eight " * 5] * 3
    want = [plain(libraries, t) for t in texts]
    for chunk, kept, collide in ((7, 5, False), (50, 300_000, True), (1, 0, False)):
        monkeypatch.setattr(tokenalign, "CHUNK", chunk)
        monkeypatch.setattr(tokenalign, "_WORDS", kept)
        monkeypatch.setattr(tokenalign, "_WINDOWS", kept)
        if collide:
            monkeypatch.setattr(tokenalign.vector, "sequence_hashes", lambda h, first: first[1:].astype("uint64") % 3)
        known = tokenalign.aligner.__wrapped__(*tokenalign.default_paths())
        names = ["k", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"]
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["k", "text"])
        got = [r for b in tokenalign._align_batch(known, batch, names) for r in b.to_pylist()]
        assert [r["k"] for r in got] == list(range(len(texts)))
        for r, (a, b, groups, links) in zip(got, want, strict=True):
            pairs = Counter(x * 32_000 + y for x, y in links)
            assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups"]) == (len(a), len(b), len(groups), len(links), ";".join(groups))
            assert dict(zip(r["pairs"], r["times"], strict=True)) == pairs


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_query_equals_libraries(spark, libraries):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    rows = q_align.op11_token_alignment(spark, SF).orderBy("doc_id")
    assert [r.doc_id for r in rows.select("doc_id").collect()] == [r.doc_id for r in docs]
    assert columns(rows) == expected(libraries, [r.text for r in docs])


def test_repeated_rows_ties_and_empty_tables(spark, libraries):
    texts = ["same words", "same words", None, "other words"]
    docs = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    assert sorted(columns(tokenalign.alignment(docs))) == sorted(expected(libraries, texts))
    none = tokenalign.alignment(docs.limit(0))
    assert none.collect() == [] and tokenalign.aligned(docs.limit(0)).columns[5] == "groups"


def test_pairs_of_vocabularies_are_bounded(libraries):
    assert tokenalign.pair_bound([b"ab", b"b", b"c"], [b"b", b"xab", b"ab"]) == 6  # all but those with c
    known = tokenalign.aligner(*tokenalign.default_paths())
    assert tokenalign.pair_bound(known.a.tokens, known.b.tokens) == 324_302
    met = {x for t in ODD + random_texts(600) for x in plain(libraries, t)[3]}
    assert all(known.a.tokens[a].endswith(known.b.tokens[b]) or known.b.tokens[b].endswith(known.a.tokens[a]) for a, b in met)
