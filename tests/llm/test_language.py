"""Language identification against a plain version of the method, held-out accuracy and awkward rows."""

import os
import unicodedata
import zlib
from collections import Counter

import pytest
import regex

from gridwise.llm import langid, q_language

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain_ngrams(text):
    text = unicodedata.normalize("NFC", text or "").lower()
    found = Counter()
    for word in regex.findall(r"[\p{L}\p{M}]+", text):
        padded = f" {word} "
        for n in (1, 2, 3):
            found.update(g for i in range(len(padded) - n + 1) if (g := padded[i : i + n]) != " ")
    return found if regex.search(r"\p{L}", text) else Counter()


def ranked(counts, size):
    key = lambda g: sum(ord(c) << 21 * i for i, c in enumerate(reversed(g)))
    return sorted(counts, key=lambda g: (-counts[g], key(g)))[:size]


def plain_prediction(text, profiles, size):
    top = ranked(plain_ngrams(text), size)
    if not top or not profiles:
        return "und", 0.0
    far = {}
    for lang, profile in profiles.items():
        place = {g: i for i, g in enumerate(profile)}
        far[lang] = sum(abs(place[g] - i) if g in place else size for i, g in enumerate(top))
    best = min(sorted(far), key=far.get)
    return best, 1 - far[best] / (len(top) * size)


def gram(g):
    return sum(ord(c) << 21 * i for i, c in enumerate(reversed(g)))


TEXTS = ["", None, "12 34 !", "a", "Ab ab ABA", "Ünï été ete", "漢字 かな", "İstanbul DŽ ǅ", "क्षत्रिय", "́", "x" * 50, "a\u0000b ퟿ z", "the cat\nthe hat", "o'clock don't"]


@pytest.mark.parametrize("piece", [2, 7, 1_000_000])
def test_ngrams_equal_plain_counts(monkeypatch, piece):
    monkeypatch.setattr(langid, "_PIECE", piece)
    for text in [*TEXTS, "so many words that the pieces cut them " * 5]:
        keys, counts = langid.ngrams(text)
        assert list(keys) == sorted(keys)
        assert dict(zip(keys.tolist(), counts.tolist(), strict=True)) == {gram(g): n for g, n in plain_ngrams(text).items()}, text


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_query_equals_plain_method_and_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    fold = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 4 for r in docs}
    counts = {}
    for r in docs:
        if fold[r.doc_id] != 2 and r.lang is not None:
            counts.setdefault(r.lang, Counter()).update(plain_ngrams(r.text))
    profiles = {lang: ranked(c, langid.SIZE) for lang, c in counts.items()}
    got = {r.doc_id: r for r in q_language.op13_language_id(spark, SF).collect()}
    assert len(got) == len(docs)
    for r in docs:
        lang, score = plain_prediction(r.text, profiles, langid.SIZE)
        assert got[r.doc_id].lang_pred == lang and abs(got[r.doc_id].score - score) < 1e-12 and got[r.doc_id].held_out == (fold[r.doc_id] == 2)
    held = [r for r in docs if fold[r.doc_id] == 2]
    assert held and sum(got[r.doc_id].lang_pred == r.lang for r in held) >= 0.97 * len(held)


def test_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(langid, "_HELD", 5)  # counts are handed on in many parts
    schema = "gram string, text string, lang string, rank int, lang_pred int"
    rows = [("g", t, lang, 1, 2) for t in TEXTS for lang in ("xx", "yy", None)] * 2
    docs = spark.createDataFrame(rows, schema)
    learned = langid.profiles(docs, size=20)
    want = ranked(sum((plain_ngrams(t) for t in TEXTS for _ in range(2)), Counter()), 20)
    by = {}
    for r in learned.collect():
        by.setdefault(r.lang, {})[r["rank"]] = r.gram
    assert {k: [v[i] for i in range(len(v))] for k, v in by.items()} == {"xx": [gram(g) for g in want], "yy": [gram(g) for g in want]}
    out = langid.predict(docs, learned, size=20)
    assert out.columns == ["gram", "text", "lang", "rank", "lang_pred", "score"]
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:  # equal profiles tie, the first name wins
        assert r.lang_pred == ("xx" if regex.search(r"\p{L}", r.text or "") else "und") and 0 <= r.score <= 1
    nothing = langid.profiles(docs.limit(0), size=20)
    assert nothing.count() == 0 and {r.lang_pred for r in langid.predict(docs, nothing).collect()} == {"und"}
    assert langid.predict(docs.limit(0), learned).collect() == []
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 1)
    with pytest.raises(ValueError):
        langid.predict(docs, learned)


def test_scores_reach_both_ends(spark):
    docs = spark.createDataFrame([("abc abd",), ("xyz",)], "text string")
    learned = langid.profiles(docs.limit(1).selectExpr("text", "'k' as lang"))
    assert {r.text: r.score for r in langid.predict(docs, learned).collect()} == {"abc abd": 1.0, "xyz": 0.0}


def test_queries_without_an_id_are_not_held_out(spark, tmp_path):
    spark.createDataFrame([(None, "abc", "k"), (3, None, None), (None, "", None)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {(r.doc_id, r.held_out, r.lang_pred) for r in q_language.op13_language_id(spark, str(tmp_path)).collect()} == {(None, False, "und"), (3, zlib.crc32(b"3") % 4 == 2, "und")}
