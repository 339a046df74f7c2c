"""Line-first quality rules, in DataFrame functions only.

Every line with a word is held against three rules: punctuation (a tenth of its
visible characters are symbols or exclamation marks, or it ends without a
sentence mark), navigation (three or more separators) and boilerplate (a stock
phrase). Failing lines are removed; a document that loses more than
``max_loss`` of its line characters, or fails the base rules (under ten words,
or over a fifth of its words in repeated five-word windows), is rejected.

All is computed inside the row: no shuffle, no Python. Defined results: null
text has no words and no lines (base_failed, not kept); documents without lines
are rejected; very long texts cost n log n at most; repeated rows give repeated
results; columns besides the text pass through and may have any name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwise.llm._common import SPACE, let, words

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Rule parameters; the SQL in q_quality uses the same ones.
SYMBOL_SHARE, MIN_SEPARATORS, MAX_LOSS, MIN_WORDS, MAX_REPEAT = 10, 3, 0.5, 10, 20
#: Last marks of a line that ends as a sentence or a heading does, and what may close after them.
TERMINAL, CLOSING = ".!?:;…。！？", "\"'”’»)]"
#: Stock phrases of web pages, in lower case.
BOILERPLATE = (
    "cookie policy", "privacy policy", "terms of use", "terms of service", "all rights reserved", "accept cookies", "accept all cookies",
    "javascript is disabled", "javascript is required", "subscribe to our newsletter", "click here", "sign in to", "sign up for",
    "lorem ipsum", "skip to content", "skip to main content",
)


def _count(text: Column, chars: str) -> Column:
    """Occurrences of any of the characters (one fast byte search for each of them)."""
    return F.length(text) - F.length(reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), chars, text))


def repeated_words(w: Column, n: int = WINDOW) -> Column:
    """Words of the array w that lie in n-word windows found twice or more in it."""
    def windows(h: Column) -> Column:
        size = F.size(h)
        at = F.sequence(F.lit(0), F.greatest(size - n, F.lit(0)))
        return F.when(size >= n, F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(n)]))).otherwise(F.array().cast("array<bigint>"))

    def covered(h: Column) -> Column:
        at = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))

        def twice(s: Column) -> Column:
            same = lambda k, j: F.get(s, k)["h"].eqNullSafe(F.get(s, j)["h"])
            ks = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: same(k, k - 1) | same(k, k + 1))
            places = F.sort_array(F.transform(ks, lambda k: F.get(s, k)["i"]))
            start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
            step = lambda acc, p: F.struct((acc["n"] + p + n - F.greatest(p, acc["end"])).alias("n"), (p + n).alias("end"))
            return F.aggregate(places, start, step, lambda acc: acc["n"])

        return F.when(F.size(F.array_distinct(h)) < F.size(h), let(F.sort_array(at), twice)).otherwise(0)

    return let(let(F.transform(w, lambda x: F.xxhash64(x)), windows), covered).cast("long")


def lines_of(text: Column) -> Column:
    """The \\n-split lines that have a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")


def line_ok(line: Column) -> Column:
    marks = _count(line, SYMBOLS + "!") * SYMBOL_SHARE >= F.length(line)
    ended = F.right(F.rtrim(line, F.lit(SPACE + CLOSING)), F.lit(1)).isin(*TERMINAL)
    navigation = _count(line, "|»›·") >= MIN_SEPARATORS
    stock = let(F.lower(line), lambda low: reduce(lambda a, b: a | b, [low.contains(x) for x in BOILERPLATE]))
    return ~(marks | ~ended | navigation | stock)


def rate(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with a struct column ``quality``: the base counts, base_failed, line_chars, kept_lines, kept_chars, kept."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    counts = let(
        words(F.col(text_col)),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x)).cast("long").alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
        ),
    )
    lines = let(
        lines_of(F.col(text_col)),
        lambda ls: F.struct(
            (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
            F.aggregate(ls, F.lit(0), lambda a, x: a + F.length(x)).cast("long").alias("line_chars"),
            F.filter(ls, line_ok).alias("kept_lines"),
        ),
    )
    rated = docs.withColumn("quality", F.struct(counts.alias("c"), lines.alias("l")))
    c, ls = F.col("quality")["c"], F.col("quality")["l"]
    failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT * c["n_words"])
    kept_chars = F.aggregate(ls["kept_lines"], F.lit(0), lambda a, x: a + F.length(x)).cast("long")
    return rated.withColumn(
        "quality",
        F.struct(
            c["n_words"].alias("n_words"),
            c["word_chars"].alias("word_chars"),
            _count(text, SYMBOLS).cast("long").alias("n_symbols"),
            ls["n_dup_lines"].alias("n_dup_lines"),
            c["n_repeat_words"].alias("n_repeat_words"),
            failed.alias("base_failed"),
            ls["line_chars"].alias("line_chars"),
            ls["kept_lines"].alias("kept_lines"),
            kept_chars.alias("kept_chars"),
            (~failed & (kept_chars >= (1 - MAX_LOSS) * ls["line_chars"])).alias("kept"),
        ),
    )


def clean(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The kept documents with their failing lines removed; the columns stay as they are (n_chars follows the text)."""
    names = docs.columns
    whole = docs.select(F.col(text_col), F.struct("*").alias("__row"))  # so that a column of any name stays
    kept = rate(whole, text_col).filter("quality.kept").withColumn(text_col, F.array_join("quality.kept_lines", "\n"))
    own = lambda c: F.col("__row").getField(c)
    out = {text_col: F.col(text_col)}
    if "n_chars" in names:
        out["n_chars"] = F.length(text_col).cast(docs.schema["n_chars"].dataType)
    return kept.select(*[out.get(c, own(c)).alias(c) for c in names])
