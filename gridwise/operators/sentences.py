"""Sentences of transcripts, and the sentence of every word of another transcript of the same item.

Words are (keys..., word_idx, word), text words (keys..., text_idx, word). All
steps are equi-joins and running sums (ordered.py), so an item may have any
number of words. While every item fits a task, the match is a chain of windows
over both lists in one table, which is shuffled once and not written.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridwise.functions.session import checkpointed
from gridwise.operators.intervals import normalise_word
from gridwise.operators import ordered
from gridwise.operators.ordered import blocks, dealt, load, running, settled


def _one() -> Column:
    return F.lit(1).cast("long")


def ends_sentence(word: Column) -> Column:
    """Whether a word ends in . ! ? or an ellipsis, closing quotes and brackets after it included; a null word does not."""
    return F.coalesce(F.rlike(word, F.lit(r"""[.!?…]["'”’)\]]*$""")), F.lit(False))


def split_sentences(words: DataFrame, keys: Sequence[str] = ("item",), longest: int = 1000, small: bool | None = None) -> DataFrame:
    """words with sentence_idx, from 0 in each item.

    A sentence ends with a word that ends_sentence; one of more than ``longest`` words is cut into sentences of that many, so that
    its text is bounded. Null words belong to the sentence about them; null keys are an item. small: as for ordered.running.
    """
    if small is None:
        words, small = settled(words, keys)
    small = small or None  # a run of a large item may be small
    ends = ends_sentence(F.col("word")).cast("long")
    runs = running(words, keys, ["word_idx"], {"__run": ends}, small=small).withColumn("__run", F.col("__run") - ends)
    placed = running(runs, [*keys, "__run"], ["word_idx"], {"__at": _one()}, small=small)
    starts = ((F.col("__at") - 1) % longest == 0).cast("long")
    return running(placed, keys, ["word_idx"], {"sentence_idx": starts}, small=small).withColumn("sentence_idx", F.col("sentence_idx") - 1).select(*words.columns, "sentence_idx")


def sentence_texts(words: DataFrame, keys: Sequence[str] = ("item",)) -> DataFrame:
    """(keys..., sentence_idx, n_words, text) of words with sentence_idx: capital first, the rest in lower case, without full stops at the end."""
    held = F.sort_array(F.collect_list(F.struct("word_idx", "word")))  # of one sentence, which split_sentences bounds
    joined = words.groupBy(*keys, "sentence_idx").agg(F.count(F.lit(1)).alias("n_words"), F.array_join(F.transform(held, lambda x: x["word"]), " ").alias("text"))
    first = F.upper(F.left("text", F.lit(1)))  # of one letter two may come
    capital = F.concat(F.left(first, F.lit(1)), F.lower(F.concat(F.substring(first, 2, 3), F.substring("text", 2, 1 << 30))))
    return joined.withColumn("text", F.rtrim(capital, F.lit(".")))


def _grams(df: DataFrame, idx: str, keys: Sequence[str], gram: int) -> DataFrame:
    """(keys..., idx, n, g): the word, and with it the next ones of its stretch; beyond the end they are empty."""
    if gram == 1:
        return df.withColumn("g", F.array("n"))
    by = W.partitionBy(*keys, "__block").orderBy("__n")
    ahead = [F.coalesce(F.lead("n", i).over(by), F.lit("")) for i in range(1, gram)]
    return checkpointed(blocks(df, keys, [idx], ahead=gram - 1).withColumn("g", F.array("n", *ahead)).filter("__own").select(*keys, idx, "n", "g"))


def _anchors(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., i, j): grams that stand once in either side, without those that cross another one.

    By rank in both orders, a pair crosses none if its ranks are equal, r, and the pairs up to it are the first r of the other side:
    different ranks that add up to 1 + ... + r.
    """
    once = lambda df, idx, out: df.filter("n <> ''").groupBy(*keys, "g").agg(F.min(idx).alias(out), F.count(F.lit(1)).alias("c")).filter("c = 1").drop("c")
    pairs = once(a, "word_idx", "i").hint("merge").join(once(b, "text_idx", "j"), [*keys, "g"]).select(*keys, "i", "j")
    ranked = running(running(pairs, keys, ["j"], {"__t": _one()}), keys, ["i"], {"__w": _one(), "__s": F.col("__t")})
    return checkpointed(ranked.filter("__t = __w and 2 * __s = __w * (__w + 1)").select(*keys, "i", "j"))


def _cut(df: DataFrame, idx: str, marks: DataFrame, at: str, keys: Sequence[str], name: str) -> DataFrame:
    """df with the number of the stretch that a row is in: anchors up to it."""
    marked = df.select(*keys, idx, "n").hint("merge").join(marks.select(*keys, F.col(at).alias(idx), _one().alias("__a")), [*keys, idx], "left")
    return checkpointed(running(marked, keys, [idx], {name: F.col("__a")}).select(*keys, name, idx, "n"))


def _side_by_side(words: DataFrame, text_words: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Both lists in one table: words as they are (__side 0) and the text's words (__side 1), with __idx, the normalised word __n and the text's sentence_idx as __held."""
    plain = F.coalesce(normalise_word(F.col("word")), F.lit("")).alias("__n")
    held = [F.col("sentence_idx").alias("__held")] if "sentence_idx" in text_words.columns else [F.lit(None).cast("long").alias("__held")]
    a = words.drop("sentence_idx").select("*", F.lit(0).alias("__side"), F.col("word_idx").cast("long").alias("__idx"), plain)
    b = text_words.select(*keys, F.lit(1).alias("__side"), F.col("text_idx").cast("long").alias("__idx"), plain, *held)
    return a.unionByName(b, allowMissingColumns=True)


def _matched(rows: DataFrame, keys: Sequence[str], grams: Sequence[int]) -> DataFrame:
    """The words of _side_by_side with __to, the text_idx of their match, and its __held; NULL where there is none. rows are dealt by keys."""
    at, text = list(keys), F.col("__side") == 1
    upto, before = (W.unboundedPreceding, 0), (W.unboundedPreceding, -1)
    own, back = (lambda: W.partitionBy(*at, "__side").orderBy("__idx")), (lambda: W.partitionBy(*at, "__side").orderBy(F.desc("__idx")))
    for k, gram in enumerate(grams):
        rows = rows.withColumn("__g", F.array("__n", *[F.coalesce(F.lead("__n", i).over(own()), F.lit("")) for i in range(1, gram)])).withColumn("__h", F.xxhash64("__g"))
        same = W.partitionBy(*at, "__h", "__g")
        once = (F.col("__n") != "") & (F.count(F.lit(1)).over(same) == 2) & (F.sum("__side").over(same) == 1)
        rows = rows.withColumn("__o", F.when(once, F.sum("__idx").over(same) - F.col("__idx")))  # an anchor's place on the other side
        rows = rows.withColumn("__q", F.min("__o").over(back().rowsBetween(*before))).withColumn("__p", F.max("__o").over(own().rowsBetween(*before)))
        kept = F.col("__o").isNotNull() & F.coalesce(F.col("__p") < F.col("__o"), F.lit(True)) & F.coalesce(F.col("__q") > F.col("__o"), F.lit(True))
        rows = rows.withColumn("__kept", kept.cast("long")).withColumn(f"__seg{k}", F.sum("__kept").over(own().rowsBetween(*upto))).drop("__g", "__h", "__o", "__p", "__q", "__kept")
        at.append(f"__seg{k}")
    rows = rows.withColumns({"__f": F.row_number().over(own()), "__m": F.count(F.lit(1)).over(W.partitionBy(*at, "__side"))}).withColumn("__e", F.col("__m") - F.col("__f"))
    for end, order in (("f", own), ("e", back)):  # pairs from the start of a stretch, and from its end
        pair = W.partitionBy(*at, f"__{end}")
        alike = (F.count(F.lit(1)).over(pair) == 2) & (F.min("__n").over(pair) == F.max("__n").over(pair))
        rows = rows.withColumns({
            f"__bad_{end}": (~alike).cast("long"), f"__to_{end}": F.max(F.when(text, F.col("__idx"))).over(pair),
            f"__held_{end}": F.max(F.when(text, F.col("__held"))).over(pair), f"__least_{end}": F.min("__m").over(pair),
        })
        rows = rows.withColumn(f"__bad_{end}", F.sum(f"__bad_{end}").over(order().rowsBetween(*upto)))
        if end == "f":
            rows = rows.withColumn("__done", F.sum((F.col("__bad_f") == 0).cast("long")).over(W.partitionBy(*at, "__side")))
    known = reduce(and_, [F.col(k).isNotNull() for k in keys])
    start, stop = known & (F.col("__bad_f") == 0), known & (F.col("__bad_e") == 0) & (F.col("__e") < F.col("__least_e") - F.col("__done"))
    found = {c: F.when(start, F.col(f"{c}_f")).when(stop, F.col(f"{c}_e")) for c in ("__to", "__held")}
    return rows.filter("__side = 0").withColumns(found)


def _windowed(words: DataFrame, text_words: DataFrame, keys: Sequence[str], most: tuple[int, int] | None) -> DataFrame | None:
    """_side_by_side dealt by keys, or None if an item has more than TASK_ROWS words on both sides. most: load of both sides, else they are written out and counted."""
    rows = _side_by_side(words, text_words, keys)
    if most is None:
        rows = checkpointed(rows)
        most = load(rows, keys)
    return dealt(rows, keys, most[1]) if most[0] <= ordered.TASK_ROWS else None


def match_words(words: DataFrame, text_words: DataFrame, keys: Sequence[str] = ("item",), grams: Sequence[int] = (3, 1), most: tuple[int, int] | None = None) -> DataFrame:
    """(keys..., word_idx, text_idx): an alignment of two word lists of an item, growing on both sides, of equal normalised words.

    Anchors are grams that stand once on either side and cross no other anchor. They cut both sides into the same stretches, and these
    are cut again by the anchors of the next gram size. Each stretch is matched from its start as long as words are equal, then from
    its end. Words between two edits without an anchor stay unmatched, where an edit distance might match some.
    A null word is empty; rows with a null key match nothing; word_idx and text_idx are different in an item.
    most: (words of the largest item on both sides, all words), or more, where that is known; else both sides are written out and counted.
    """
    both = _windowed(words.select(*keys, "word_idx", "word"), text_words, keys, most)
    if both is not None:
        kind = text_words.schema["text_idx"].dataType
        return _matched(both, keys, grams).filter("__to is not null").select(*keys, "word_idx", F.col("__to").cast(kind).alias("text_idx"))
    plain = lambda df, idx: df.select(*keys, idx, F.coalesce(normalise_word(F.col("word")), F.lit("")).alias("n"))
    a, b, at = plain(words, "word_idx"), plain(text_words, "text_idx"), list(keys)
    for gram in grams:
        a, b, name = _grams(a, "word_idx", at, gram), _grams(b, "text_idx", at, gram), f"__seg{len(at)}"
        kept = _anchors(a, b, at)
        a, b = _cut(a, "word_idx", kept, "i", at, name), _cut(b, "text_idx", kept, "j", at, name)
        at.append(name)

    def placed(df: DataFrame, idx: str, side: str) -> DataFrame:
        rows = running(df, at, [idx], {"f": _one()}, {"f": "m"})
        return checkpointed(rows.select(*at, idx, F.col("n").alias(f"n{side}"), F.col("m").alias(f"m{side}"), (F.col("f") - 1).alias("f"), (F.col("m") - F.col("f")).alias("e")))

    sa, sb = placed(a, "word_idx", "a"), placed(b, "text_idx", "b")

    def equal_run(by: str, other: str) -> DataFrame:
        pairs = sa.drop(other).hint("merge").join(sb.drop(other), [*at, by])
        return running(pairs, at, [by], {"bad": (F.col("na") != F.col("nb")).cast("long")}).filter("bad = 0")

    forward = checkpointed(equal_run("f", "e").select(*at, "word_idx", "text_idx"))
    done = forward.groupBy(*at).agg(F.count(F.lit(1)).alias("__done"))
    backward = equal_run("e", "f").hint("merge").join(done, at, "left").filter(F.col("e") < F.least("ma", "mb") - F.coalesce("__done", F.lit(0)))
    both = [*keys, "word_idx", "text_idx"]
    return forward.select(both).unionByName(backward.select(both))


def word_sentences(words: DataFrame, text_words: DataFrame, keys: Sequence[str] = ("item",), grams: Sequence[int] = (3, 1), most: tuple[int, int] | None = None) -> DataFrame:
    """words with sentence_idx: that of the matching text word (text_words has sentence_idx).

    An unmatched word between two words of one sentence belongs to it; others have NULL, which sentence_context takes as such. most: as for match_words.
    """
    sides = _windowed(words, text_words, keys, most)
    if sides is not None:
        near = lambda order: F.last("__held", ignorenulls=True).over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
        gaps = _matched(sides, keys, grams).withColumn("__next", near(F.desc("word_idx"))).withColumn("__last", near(F.col("word_idx")))
        filled = F.coalesce("__held", F.when(F.col("__last") == F.col("__next"), F.col("__last"))).alias("sentence_idx")
        return gaps.select(*[c for c in words.columns if c != "sentence_idx"], filled)
    matched = match_words(words, text_words, keys, grams, (ordered.TASK_ROWS + 1, 0))
    known = matched.hint("merge").join(text_words.select(*keys, "text_idx", "sentence_idx"), [*keys, "text_idx"]).select(*keys, "word_idx", "sentence_idx")
    both = words.drop("sentence_idx").hint("merge").join(known, [*keys, "word_idx"], "left")
    numbered = checkpointed(running(both, keys, ["word_idx"], {"__c": F.col("sentence_idx").isNotNull().cast("long")}))
    at = numbered.filter("sentence_idx is not null").select(*keys, "__c", F.col("sentence_idx").alias("__last"))
    after = at.select(*keys, (F.col("__c") - 1).alias("__c"), F.col("__last").alias("__next"))
    gaps = numbered.hint("merge").join(at, [*keys, "__c"], "left").hint("merge").join(after, [*keys, "__c"], "left")
    filled = F.coalesce("sentence_idx", F.when(F.col("__last") == F.col("__next"), F.col("__last")))
    return gaps.withColumn("sentence_idx", filled).select(*[c for c in words.columns if c != "sentence_idx"], "sentence_idx")
