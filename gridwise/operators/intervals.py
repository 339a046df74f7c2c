"""Interval, as-of and lookback joins between words, samples and grids.

Words are (item, word_idx, word, onset_s, duration_s). Ranges become frame or
sample numbers, or one union ordered by time, before anything is joined.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridwise.functions.session import checkpointed, measured, sized
from gridwise.operators.ordered import blocks, running, settled


def interval_frames(onset: Column, duration: Column, n_frames: Column, hz: float, out_start: float = 0.0, out_duration: Column | None = None) -> Column:
    """Frame numbers that an interval overlaps; NULL where it lies outside; a zero-length interval marks one frame."""
    out_stop = F.lit(out_start) + (out_duration if out_duration is not None else n_frames / hz)
    low, high = F.greatest(onset, F.lit(out_start)), F.least(onset + duration, out_stop)
    inside = (low < high) | ((duration == 0) & (onset >= out_start) & (onset <= out_stop))
    length = F.greatest(F.lit(1.0), F.rint((high - low) * hz)).cast("int")
    start = F.least(F.greatest(F.rint((low - out_start) * hz).cast("int"), F.lit(0)), F.greatest(n_frames - length, F.lit(0)))
    return F.when(inside, F.sequence(start, F.least(start + length, n_frames) - 1))


def interval_to_frames(words: DataFrame, frames: DataFrame, hz: float) -> DataFrame:
    """words (a row for each overlapped frame); frames: (item, n_frames)."""
    spans = interval_frames(F.col("onset_s"), F.col("duration_s"), F.col("n_frames").cast("int"), hz)
    return words.join(measured(frames), "item").select("item", "word_idx", F.explode(spans).alias("frame"))


def asof_prefix(words: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """cutoffs (item, cutoff_s) with n_words: words that end at or before the cutoff (as-of join by one ordered union)."""
    ends = words.select("item", (F.col("onset_s") + F.col("duration_s")).alias("t"), F.lit(0).alias("kind"))
    both = ends.union(cutoffs.select("item", F.col("cutoff_s").alias("t"), F.lit(1).alias("kind")))
    counted = running(both, ["item"], ["t", "kind"], {"n_words": (1 - F.col("kind")).cast("long")})
    return counted.filter("kind = 1").select("item", F.col("t").alias("cutoff_s"), "n_words")


def lookback_range(samples: DataFrame, cutoffs: DataFrame, rate: float, span_s: float = 60.0) -> DataFrame:
    """(item, cutoff_s, n, total): samples numbered floor(max(0, c - span) rate) to max(that + 1, ceil(c rate)) - 1.

    A range is the difference of two prefix sums, each found by an as-of join: no range is expanded.
    """
    low = F.floor(F.greatest(F.lit(0.0), F.col("cutoff_s") - span_s) * rate).cast("long")
    high = F.greatest(low + 1, F.ceil(F.col("cutoff_s") * rate).cast("long"))
    bounds = cutoffs.select("item", "cutoff_s", F.explode(F.array(F.struct(low.alias("s"), F.lit(-1).alias("sign")), F.struct(high.alias("s"), F.lit(1).alias("sign")))).alias("b"))
    points = samples.select("item", F.col("sample").cast("long").alias("s"), F.lit(1).alias("kind"), F.col("value"), F.lit(None).cast("double").alias("cutoff_s"), F.lit(0).alias("sign"))
    asks = bounds.select("item", "b.s", F.lit(0).alias("kind"), F.lit(None).cast("double").alias("value"), "cutoff_s", "b.sign")
    run = running(points.union(asks), ["item"], ["s", "kind"], {"__n": F.col("kind"), "__v": F.col("value")}).filter("sign <> 0")  # samples below the bound
    return run.groupBy("item", "cutoff_s").agg(F.sum(F.col("sign") * F.col("__n")).alias("n"), F.sum(F.col("sign") * F.col("__v")).alias("total"))


def lookback_capped(frames: DataFrame, cutoffs: DataFrame, source_fps: float, sample_fps: float = 2.0, span_s: float = 4.0, keep: int = 8) -> DataFrame:
    """(item, cutoff_s, pick, frame, value): the last ``keep`` frames of [max(0, c - span), c] sampled at sample_fps."""
    last = frames.groupBy("item").agg(F.max("frame").alias("__last"))
    low = F.greatest(F.lit(0.0), F.col("cutoff_s") - span_s)
    n = F.greatest(F.lit(1.0), F.ceil((F.col("cutoff_s") - low) * sample_fps)).cast("int")
    picks = cutoffs.withColumns({"__low": low, "__n": n}).select("item", "cutoff_s", "__low", F.explode(F.sequence(F.greatest(F.lit(0), F.col("__n") - keep), F.col("__n") - 1)).alias("pick"))
    at = picks.join(measured(last), "item").withColumn("frame", F.least(F.floor((F.col("__low") + F.col("pick") / sample_fps) * source_fps).cast("int"), F.col("__last").cast("int")))
    return at.hint("merge").join(frames, ["item", "frame"]).select("item", "cutoff_s", "pick", "frame", "value")


def lookback_subtimes(steps: DataFrame, frames: DataFrame, fps: float, n: int = 8, span_s: float = 4.0) -> DataFrame:
    """(item, step, k, frame, value): n frames nearest to the times max(0, t - j span / n), oldest first, of each step's end t."""
    last = frames.groupBy("item").agg(F.max("frame").alias("__last"))
    k = steps.join(measured(last), "item").select("item", "step", "cutoff_s", "__last", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k"))
    t = F.greatest(F.lit(0.0), F.col("cutoff_s") - (n - 1 - F.col("k")) * (span_s / n))
    at = k.withColumn("frame", F.least(F.greatest(F.rint(t * fps).cast("int"), F.lit(0)), F.col("__last").cast("int")))
    return at.hint("merge").join(frames, ["item", "frame"]).select("item", "step", "k", "frame", "value")


def word_spans(words: DataFrame, keys: Sequence[str] = ("item",)) -> DataFrame:
    """words with start and stop: character span of each word in the words joined by blanks."""
    upto = running(words, keys, ["word_idx"], {"stop": (F.length("word") + 1).cast("long")})
    start = F.col("stop") - F.coalesce(F.length("word") + 1, F.lit(0))
    return upto.withColumn("start", start).withColumn("stop", F.col("start") + F.length("word"))


def joined_text(words: DataFrame, keys: Sequence[str] = ("item",)) -> DataFrame:
    pairs = F.sort_array(F.collect_list(F.struct("word_idx", "word")))
    return words.groupBy(*keys).agg(F.array_join(F.transform(pairs, lambda x: x["word"]), " ").alias("text"))


def normalise_word(word: Column) -> Column:
    return F.btrim(F.lower(word), F.lit('",. ()?!\n\t'))


def span_overlap(tokens: DataFrame, words: DataFrame, bucket: int = 64, keys: Sequence[str] = ("item",)) -> DataFrame:
    """(keys..., token_idx, word_idx): tokens that share a character with a word. Spans meet in buckets of characters; empty tokens match nothing."""
    cells = lambda: F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor((F.col("stop") - 1) / bucket))).alias("cell")
    t = tokens.filter("stop > start").select(*keys, "token_idx", F.col("start").alias("t0"), F.col("stop").alias("t1"), cells())
    w = words.filter("stop > start").select(*keys, "word_idx", F.col("start").alias("w0"), F.col("stop").alias("w1"), cells())
    both = t.hint("merge").join(w, [*keys, "cell"]).filter("t0 < w1 and t1 > w0")
    return both.filter(F.col("cell") == F.floor(F.greatest("t0", "w0") / bucket)).select(*keys, "token_idx", "word_idx")


def joint_step_plan(words: DataFrame, grids: dict[str, DataFrame]) -> DataFrame:
    """(item, cutoff_s, n_words, has_<name>...): one row for each distinct cutoff (six places) of word ends and grids."""
    rows = words.select("item", F.round(F.col("onset_s") + F.col("duration_s"), 6).alias("cutoff_s"), F.lit("text").alias("kind"))
    for name, g in grids.items():
        rows = rows.union(g.select("item", F.round("cutoff_s", 6).alias("cutoff_s"), F.lit(name).alias("kind")))
    flags = [F.bool_or(F.col("kind") == n).alias(f"has_{n}") for n in grids]
    return rows.groupBy("item", "cutoff_s").agg(F.count_if(F.col("kind") == "text").alias("n_words"), *flags)


#: Grid cutoffs of an item that are made in one row, and of a task.
CELL, TASK_CUTOFFS = 1024, 2_000_000


def regular_step_plan(words: DataFrame, frames: DataFrame, steps: dict[str, float]) -> DataFrame:
    """joint_step_plan of regular grids: name -> step in seconds (whole microseconds), its first n_frames multiples being the cutoffs of an item.

    frames: (item, n_frames), a row an item. Whether a cutoff lies on a grid is worked out from its number, so that grids are
    made last, cell by cell, without the cutoffs of words, and are neither shuffled nor grouped.
    """
    micros = {name: round(step * 1e6) for name, step in steps.items()}
    if not micros or any(m <= 0 or abs(m - steps[name] * 1e6) > 1e-6 for name, m in micros.items()):
        raise ValueError(f"steps must be whole microseconds above zero: {steps}")
    width = CELL * min(micros.values())
    frames = checkpointed(frames.select("item", F.col("n_frames").cast("long").alias("n_frames")).filter("n_frames > 0"))
    total = frames.agg(F.sum(F.col("n_frames").cast("double"))).first()[0] or 0
    on = lambda m: F.coalesce((F.col("at") > 0) & (F.col("at") % m == 0) & (F.col("at") <= F.col("n_frames") * m), F.lit(False))
    flags = [on(m).alias(f"has_{name}") for name, m in micros.items()]
    columns = ["item", "cutoff_s", "n_words", *[f"has_{name}" for name in micros]]

    text = words.groupBy("item", F.round(F.col("onset_s") + F.col("duration_s"), 6).alias("cutoff_s")).agg(F.count(F.lit(1)).alias("n_words"))
    at = F.when(F.abs("cutoff_s") < 9e9, F.rint(F.col("cutoff_s") * 1e6).cast("long")).alias("at")  # beyond, doubles have no microseconds
    known = sized(frames.select(F.col("item").alias("__item"), "n_frames"))
    text = checkpointed(text.join(known, F.col("item").eqNullSafe(F.col("__item")), "left").select("item", "cutoff_s", "n_words", at, "n_frames").select(*columns[:3], "at", *flags))

    cell = lambda c: F.floor(c / F.lit(width)).cast("long")
    cells = frames.select("item", F.explode(F.sequence(F.lit(0).cast("long"), cell(F.col("n_frames") * max(micros.values())))).alias("cell"), "n_frames", F.lit(None).cast("long").alias("at"))
    taken = text.filter(" or ".join(columns[3:])).select("item", cell(F.col("at")).alias("cell"), F.lit(None).cast("long").alias("n_frames"), "at")
    tasks = max(1, min(10_000, int(total * len(micros) / TASK_CUTOFFS)))  # the few bytes of a cell say nothing about its cutoffs
    met = cells.union(taken).repartition(tasks, "item", "cell").groupBy("item", "cell").agg(F.max("n_frames").alias("n_frames"), F.collect_list("at").alias("taken"))

    def multiples(m: int) -> Column:
        low = F.greatest(F.ceil(F.col("cell") * width / F.lit(m)).cast("long"), F.lit(1))
        high = F.least(F.floor(((F.col("cell") + 1) * width - 1) / F.lit(m)).cast("long"), F.col("n_frames"))
        return F.when(low <= high, F.sequence(low * m, high * m, F.lit(m).cast("long"))).otherwise(F.array().cast("array<bigint>"))

    made = reduce(F.array_union, [multiples(m) for m in micros.values()])
    grid = met.filter("n_frames is not null").select("item", "n_frames", F.explode(F.array_except(made, F.col("taken"))).alias("at"))
    grid = grid.select("item", (F.col("at") / 1e6).alias("cutoff_s"), F.lit(0).cast("long").alias("n_words"), *flags)
    return text.select(*columns).union(grid)


def transcript_duration(words: DataFrame, rows: DataFrame | None = None, tr: float = 1.49) -> DataFrame:
    """(item, duration_s): latest word end (negative durations count as zero), and n_rows tr where rows (item, n_rows) are given."""
    ends = words.groupBy("item").agg(F.max(F.col("onset_s") + F.greatest("duration_s", F.lit(0.0))).alias("__e"))
    if rows is None:
        return ends.select("item", F.coalesce("__e", F.lit(0.0)).alias("duration_s"))
    return rows.hint("merge").join(ends, "item", "left").select("item", F.greatest(F.col("n_rows") * tr, F.coalesce("__e", F.lit(0.0))).alias("duration_s"))


def running_context(words: DataFrame, max_len: int, keys: Sequence[str] = ("item",)) -> DataFrame:
    """words with context: the last max_len + 1 words up to the current one."""
    by = W.partitionBy(*keys, "__block").orderBy("__n").rowsBetween(-max_len, 0)
    context = F.array_join(F.collect_list("word").over(by), " ")
    return blocks(words, keys, ["word_idx"], back=max_len).withColumn("context", context).filter("__own").select(*words.columns, "context")


def last_n_words(words: DataFrame, cutoffs: DataFrame, n: int) -> DataFrame:
    """(item, cutoff_s, n_words, window_start, text): the last n words that end at or before each cutoff. Ends must not decrease with word_idx."""
    prefix = asof_prefix(words, cutoffs).distinct()
    by = W.partitionBy("item", "__block").orderBy("__n").rowsBetween(-(n - 1), 0)
    texts = blocks(words, ["item"], ["word_idx"], back=n - 1).withColumn("text", F.array_join(F.collect_list("word").over(by), " ")).filter("__own").withColumn("n_words", F.col("__n") + 1)
    out = prefix.hint("merge").join(texts.select("item", "n_words", "text"), ["item", "n_words"], "left")
    return out.select("item", "cutoff_s", "n_words", F.greatest(F.col("n_words") - n, F.lit(0)).alias("window_start"), F.coalesce("text", F.lit("")).alias("text"))


def sentence_context(words: DataFrame, max_len: int, keys: Sequence[str] = ("item",), small: bool | None = None) -> DataFrame:
    """words (with sentence_idx, NULL for an unmatched word) with context: the words of the sentences so far, the last max_len + 1 of them.

    An unmatched word has the context '' and starts the context anew. small: as for running.
    """
    if small is None:
        words, small = settled(words, keys)
    small = small or None  # a part of a large item may be small
    runs = running(words, keys, ["word_idx"], {"__run": F.col("sentence_idx").isNull().cast("long")}, small=small)
    inner = W.partitionBy(*keys, "__run", "__block").orderBy("__n").rowsBetween(-max_len, 0)
    known = F.when(F.col("sentence_idx").isNotNull(), F.col("word"))
    context = F.when(F.col("sentence_idx").isNull(), "").otherwise(F.array_join(F.collect_list(known).over(inner), " "))
    return blocks(runs, [*keys, "__run"], ["word_idx"], back=max_len, small=small).withColumn("context", context).filter("__own").select(*words.columns, "context")


def sum_to_frames(words: DataFrame, frames: DataFrame, hz: float, value: str = "value") -> DataFrame:
    """(item, frame, value): the sum of the values of all words that overlap a frame; 0 where none does. frames: (item, n_frames)."""
    hits = interval_to_frames(words, frames, hz).hint("merge").join(words.select("item", "word_idx", value), ["item", "word_idx"])
    sums = hits.groupBy("item", "frame").agg(F.sum(value).alias(value))
    grid = frames.select("item", F.explode(F.sequence(F.lit(0), F.col("n_frames").cast("int") - 1)).alias("frame"))
    return grid.hint("merge").join(sums, ["item", "frame"], "left").select("item", "frame", F.coalesce(value, F.lit(0.0)).alias(value))


def merge_streams_mean(streams: Sequence[DataFrame]) -> DataFrame:
    """(item, frame, value): streams (item, frame, value) resampled to the longest one of each item, and averaged."""
    rows = streams[0].withColumn("stream", F.lit(0))
    for i, s in enumerate(streams[1:], 1):
        rows = rows.union(s.withColumn("stream", F.lit(i)))
    n = checkpointed(rows.groupBy("item", "stream").agg((F.max("frame") + 1).alias("n")))  # a few rows an item
    most = n.groupBy("item").agg(F.max("n").alias("m"))
    grid = n.hint("merge").join(most, "item").select("item", "stream", "n", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m").cast("long") - 1)).alias("i"))
    grid = grid.withColumn("frame", F.floor(F.col("i") * F.col("n") / F.col("m")))
    return grid.hint("merge").join(rows, ["item", "stream", "frame"]).groupBy("item", "i").agg(F.avg("value").alias("value")).withColumnRenamed("i", "frame")


def token_mean(overlaps: DataFrame, tokens: DataFrame, value: str = "value", keys: Sequence[str] = ("item",)) -> DataFrame:
    """(keys..., word_idx, value): mean over the tokens of each word."""
    return overlaps.hint("merge").join(tokens.select(*keys, "token_idx", value), [*keys, "token_idx"]).groupBy(*keys, "word_idx").agg(F.avg(value).alias(value))


def patch_mean(tokens: DataFrame, n_steps: int) -> DataFrame:
    """(item, step, value): mean of the tokens of each step; an item whose tokens can't be divided by n_steps is an error."""
    count = tokens.groupBy("item").agg(F.count(F.lit(1)).alias("__n"))
    bad = F.raise_error(F.concat(F.lit("tokens not divisible by steps in "), F.col("item").cast("string"))).cast("long")
    spatial = F.when(F.col("__n") % n_steps == 0, F.floor(F.col("__n") / n_steps)).otherwise(bad)
    return tokens.join(measured(count), "item").groupBy("item", F.floor(F.col("token") / spatial).alias("step")).agg(F.avg("value").alias("value"))


def strategy_counts(rows: DataFrame, strategy: str) -> DataFrame:
    return rows.groupBy(strategy).agg(F.count(F.lit(1)).alias("n"))
