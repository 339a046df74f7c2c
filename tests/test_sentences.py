"""Sentences and the match of two word lists: hand cases, brute force and both forms of the ordered operators."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from gridwise.operators import ordered
from gridwise.operators import sentences as S

WORDS, TEXT = "item long, word_idx long, word string", "item long, text_idx long, word string, sentence_idx long"


def words(spark, *items):
    return spark.createDataFrame([(i, n, w) for i, ws in enumerate(items) for n, w in enumerate(ws)], WORDS)


def text(spark, *items):
    """Items are lists of (word, sentence)."""
    return spark.createDataFrame([(i, n, w, s) for i, ws in enumerate(items) for n, (w, s) in enumerate(ws)], TEXT)


def matched(spark, a, b):
    rows = S.match_words(words(spark, a), text(spark, [(w, 0) for w in b])).collect()
    return sorted((r.word_idx, r.text_idx) for r in rows)


@pytest.fixture(params=[1_000_000, 5], ids=["windows", "spread"])
def form(request, monkeypatch):
    monkeypatch.setattr(ordered, "TASK_ROWS", request.param)


def test_sentences_end_with_their_marks(spark, form):
    said = ["So", "it", 'ends."', None, "does", "it?)", "yes", "...", "a", "b", "c", "d", "e"]
    rows = S.split_sentences(words(spark, said, [], ["one"]), longest=3).orderBy("item", "word_idx").collect()
    assert [r.sentence_idx for r in rows] == [0, 0, 0, 1, 1, 1, 2, 2, 3, 3, 3, 4, 4, 0]
    assert S.split_sentences(words(spark)).count() == 0


def test_sentence_texts_have_one_capital(spark):
    said = ["hELLO", "World.", "ßa", "b...", "x"]
    rows = S.sentence_texts(S.split_sentences(words(spark, said))).orderBy("sentence_idx").collect()
    assert [(r.n_words, r.text) for r in rows] == [(2, "Hello world"), (2, "Ssa b"), (1, "X")]
    assert rows[0].text == "hELLO World.".capitalize().rstrip(".") and rows[1].text == "ßa b...".capitalize().rstrip(".")


def test_equal_lists_match_whole_whatever_repeats(spark):
    for a in (["a"], ["a"] * 7, "the cat the cat the dog the cat the".split(), ["", ".", "x"]):
        assert matched(spark, a, a) == [(i, i) for i in range(len(a))]
    assert matched(spark, [], ["a"]) == [] and matched(spark, ["a"], []) == [] and matched(spark, ["a"], ["b"]) == []


def test_normalised_words_meet_around_edits(spark):
    a = 'He said: "well, the house is red", and left at noon'.split()
    b = "he said: well the old house is green and left at noon.".split()
    got = matched(spark, a, b)
    assert [(a[i], b[j]) for i, j in got if i in (3, 4)] == [("the", "the"), ("house", "house")]
    assert {a[i] for i in range(len(a))} - {a[i] for i, _ in got} == {'red",'}


def test_moved_passages_do_not_cross(spark):
    a = "one two three four five six seven eight nine ten".split()
    got = matched(spark, a, a[5:] + a[:5])
    assert got == sorted(got) and [j for _, j in got] == sorted(j for _, j in got)
    assert all((a[5:] + a[:5])[j] == a[i] for i, j in got)


def test_random_edits_against_the_longest_match(spark, form):
    rng = random.Random(5)
    items_a, items_b = [], []
    for _ in range(25):
        a = [rng.choice("abcdefghijklmnop") + rng.choice("xyz") for _ in range(80)]
        b = []
        for w in a:
            k = rng.random()
            b += [] if k < 0.04 else [w, "new"] if k < 0.08 else ["other"] if k < 0.12 else [w]
        items_a.append(a)
        items_b.append(b)
    got = {}
    for r in S.match_words(words(spark, *items_a), text(spark, *[[(w, 0) for w in b] for b in items_b])).collect():
        got.setdefault(r.item, []).append((r.word_idx, r.text_idx))
    n = best = 0
    for i, (a, b) in enumerate(zip(items_a, items_b, strict=True)):
        pairs = sorted(got[i])
        assert all(a[x] == b[y] for x, y in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        n += len(pairs)
        best += sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
    assert n >= 0.97 * best


def test_unmatched_words_within_a_sentence_take_it(spark):
    b = [(w, 0) for w in "this is the first of all.".split()] + [(w, 1) for w in "here comes another one now.".split()]
    a = "this is XX first of all YY here comes ZZ one now".split()
    rows = S.word_sentences(words(spark, a), text(spark, b)).orderBy("word_idx").collect()
    assert [r.sentence_idx for r in rows] == [0] * 6 + [None] + [1] * 5
    rows = S.word_sentences(words(spark, a).withColumn("sentence_idx", F.lit("x")).withColumn("more", F.lit(1)), text(spark, b))
    assert rows.columns == ["item", "word_idx", "word", "more", "sentence_idx"] and rows.filter("sentence_idx = 1").count() == 5


def test_null_words_and_items(spark):
    a = spark.createDataFrame([(None, 0, "a"), (1, 0, None), (1, 1, "b")], WORDS)
    b = spark.createDataFrame([(None, 0, "a", 0), (1, 0, None, 0), (1, 1, "b", 0)], TEXT)
    assert sorted(map(tuple, S.match_words(a, b).collect())) == [(1, 0, 0), (1, 1, 1)]
    assert S.word_sentences(a, b).count() == 3
