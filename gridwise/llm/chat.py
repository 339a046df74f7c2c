"""Chat formatting in budgeted windows, in DataFrame functions only.

A turn is written ``### role: text</turn>`` and a line feed. Inside roles and
texts a backslash becomes ``\\b``, ``<`` becomes ``\\l`` and ``#`` becomes ``\\h``
(and ``:`` becomes ``\\c`` in roles), so no control string can occur in them and
reading back is a plain split and replace.

Prefix sums of the turns' tokens choose the windows. A turn over ``STRETCH``
tokens has a window of its own; the other turns between two such turns share a
window if they end in one stretch of ``STRETCH`` tokens, so their window holds
at most 2 * ``STRETCH`` tokens, and the turn across an edge starts the next one.
A window repeats the conversation's first system turn, if that came before it,
and the turns that start at most ``HISTORY`` tokens before it; these repeats
come first and are left out of the loss mask, so every assistant text is a
target once. So the budget is 2 * ``STRETCH`` tokens of own turns (or one turn,
which is never cut), the turns that start in ``HISTORY`` tokens, and the system
turn.

Sums are taken over chunks of turn numbers and carried on by the sums of the
chunks before, which gives the same as one pass over the conversation, while no
task holds a conversation's texts.

Defined results: null texts and roles are empty; turns with equal numbers are
ordered by role and text; rows without a turn number come first, in the order of
a hash of role and text; rows without a conversation id are one conversation; an
empty table gives no rows; extra columns are ignored; texts of any length are
kept whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridwise.llm._common import checkpointed, let, stored, words

CHUNK, STRETCH, HISTORY, OVERHEAD = 256, 256, 128, 4
_HEAD, _TAIL = "### ", "</turn>\n"
_ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))
_CONV = ["ck", "nk"]  # a conversation's id (something else for null) and whether it is null


def _replace(text: Column, pairs) -> Column:
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, text)


def escape(text: Column, role: bool = False) -> Column:
    return _replace(text, [*_ESCAPES, *([(":", "\\c")] if role else [])])


def unescape(text: Column) -> Column:
    """Inverse of escape: the backslash's own code is undone last, so nothing is read twice."""
    return _replace(text, [("\\c", ":"), *[(b, a) for a, b in reversed(_ESCAPES)]])


def _placed(turns: DataFrame) -> DataFrame:
    """(ck, nk, start, ws, role, body, system): turns with the tokens before them and before their window."""
    kind = turns.schema["conv_id"].dataType
    rows = turns.select(
        F.coalesce("conv_id", F.lit("0").cast(kind)).alias("ck"), F.col("conv_id").isNull().alias("nk"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    unplaced = F.when(F.col("turn").isNull(), F.xxhash64("role", "text"))
    rows = rows.withColumns({"unplaced": unplaced, "tokens": F.size(words(F.col("text"))).cast("long") + OVERHEAD})
    rows = rows.withColumns(
        {
            "chunk": F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(-(1 << 62))), "part": F.coalesce(F.shiftright("unplaced", 56), F.lit(0)),
            "long": (F.col("tokens") > STRETCH).cast("long"), "sys": (F.col("role") == "system").cast("long"),
        }
    )
    chunk = [*_CONV, "chunk", "part"]
    sums = rows.groupBy(*chunk).agg(*[F.sum(c).alias(c) for c in ("tokens", "long", "sys")])
    before = W.partitionBy(*_CONV).orderBy("chunk", "part").rowsBetween(W.unboundedPreceding, -1)
    carried = checkpointed(sums.select(*chunk, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_0") for c in ("tokens", "long", "sys")]))
    inside = W.partitionBy(*chunk).orderBy("turn", "unplaced", "role", "text").rowsBetween(W.unboundedPreceding, 0)
    up_to = lambda c: F.col(f"{c}_0") + F.sum(c).over(inside)
    summed = rows.hint("merge").join(carried, chunk).withColumns({"stop": up_to("tokens"), "n_long": up_to("long"), "n_sys": up_to("sys")})
    window = [*_CONV, "n_long", "long", F.when(F.col("long") == 0, F.floor((F.col("stop") - 1) / STRETCH)).otherwise(F.lit(-1))]
    summed = summed.withColumn("start", F.col("stop") - F.col("tokens"))
    return summed.select(
        *_CONV, "start", F.min("start").over(W.partitionBy(*window)).alias("ws"), "role", escape(F.col("text")).alias("body"), ((F.col("sys") == 1) & (F.col("n_sys") == 1)).alias("system")
    )


def _formatted(turns: Column) -> Column:
    """Struct (formatted, loss, n_repeated) of a window's turns, repeats first."""
    turn = lambda t: F.concat(F.lit(_HEAD), escape(t["role"], True), F.lit(": "), t["body"], F.lit(_TAIL))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        body = acc["at"] + len(_HEAD) + F.length(escape(t["role"], True)) + 2
        span = F.struct(body.alias("start"), F.length(t["body"]).alias("length"))
        spans = F.when((t["own"] == 1) & (t["role"] == "assistant"), F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct((body + F.length(t["body"]) + len(_TAIL)).alias("at"), spans.alias("spans"))

    return F.struct(
        F.array_join(F.transform(turns, turn), "").alias("formatted"), F.aggregate(turns, none, step, lambda a: a["spans"]).alias("loss"), F.size(F.filter(turns, lambda t: t["own"] < 1)).alias("n_repeated")
    )


def windows(turns: DataFrame) -> DataFrame:
    """(conv_id, window, formatted, loss array<struct<start, length>>, n_repeated) from (conv_id, turn, role, text).

    window is the number of tokens before its own turns; loss has the character ranges of the targets in formatted; the
    first n_repeated turns of formatted are repeats.
    """
    placed = stored(_placed(turns))
    begun = checkpointed(placed.filter("start = ws").select(*_CONV, "ws"))
    own = placed.select(*_CONV, "ws", F.lit(1).alias("own"), "start", "role", "body")
    cell = F.floor(F.col("start") / HISTORY)  # a window begins in the cell of its history's turns or in the next one
    earlier = placed.filter("not system").select(*_CONV, "start", "role", "body", F.explode(F.array(cell, cell + 1)).alias("cell"))
    starts = begun.withColumn("cell", F.floor(F.col("ws") / HISTORY))
    history = earlier.hint("merge").join(starts, [*_CONV, "cell"]).filter(f"ws > start and start >= ws - {HISTORY}")
    history = history.select(*_CONV, "ws", F.lit(0).alias("own"), "start", "role", "body")
    first = checkpointed(placed.filter("system").select(*_CONV, "start", "role", "body"))  # one for each conversation at most
    system = begun.hint("merge").join(first, _CONV).filter("ws > start").select(*_CONV, "ws", F.lit(-1).alias("own"), "start", "role", "body")
    rows = own.union(history).union(system)
    made = rows.groupBy(*_CONV, "ws").agg(F.sort_array(F.collect_list(F.struct("own", "start", "role", "body"))).alias("turns"))  # of one window
    made = made.select(F.when(~F.col("nk"), F.col("ck")).alias("conv_id"), F.col("ws").alias("window"), let(F.col("turns"), _formatted).alias("w"))
    return made.select("conv_id", "window", "w.*")


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns, loss, formatted_chars): what the windows hold, without repeats, by conversation."""
    pieces = F.filter(F.split("formatted", "</turn>\n"), lambda p: p != "")
    own = F.slice(pieces, F.col("n_repeated") + 1, F.size(pieces))

    def turn(p: Column) -> Column:
        rest = F.substr(p, F.lit(len(_HEAD) + 1))
        cut = F.locate(":", rest)
        return F.concat(unescape(F.substr(rest, F.lit(1), cut - 1)), F.lit("\n"), unescape(F.substr(rest, cut + 2)), F.lit("\n"))

    loss = F.array_join(F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    one = formatted.select(
        "conv_id",
        F.size(own).alias("n"),
        F.length("formatted").alias("chars"),
        F.struct("window", F.array_join(F.transform(own, turn), "").alias("turns"), loss.alias("loss")).alias("x"),
    )
    whole = one.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.sort_array(F.collect_list("x")).alias("x"))
    joined = lambda name: F.array_join(F.transform("x", lambda x: x[name]), "")
    return whole.select("conv_id", "n_turns", joined("turns").alias("turns"), joined("loss").alias("loss"), "formatted_chars")
