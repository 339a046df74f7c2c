"""Alignment of two tokenizers' tokens of the same texts, and counts of linked pairs.

Every text is tokenized whole by a byte-level BPE (A, of a blank and the text)
and by a sentence-piece model (B, which puts the blank itself). Where the joined
token bytes of both equal the blank and the text, the ends that both share
before space-marked tokens are anchors. They cut the tokens into windows, mostly
of a word, and a window's alignment is kept by its tuples of ids: groups between
shared ends, and links between the tokens that end there together.

Both tokenizers are asked for each distinct word once in a while only: neither
joins what a single blank parts (A starts a new piece at a blank before a
visible character, no piece of B has a blank after another character), so the
ids of a text are the ids of its words. Tests hold that against whole texts.

Linked tokens end together, so one's bytes end in the other's: ``pair_bound``
counts such pairs of two vocabularies, and no corpus has more of them. For the
default files that is below half a million, which bounds the broadcast table.

Defined results: null and empty texts, and those whose joined bytes of A or B
differ from the blank and the text (a text with U+2581), have no tokens: zeros
and an empty string. Texts of over half a million characters are taken in
stretches between two words (a longer word stays whole). Repeated rows count as
often as they stand there, null ids are ids like others, tied counts are all
best, an empty table gives no rows; only the named columns are read, so extra
columns may have any name.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwise.llm import _vector as vector
from gridwise.llm._common import BROADCAST_ROWS, stored
from gridwise.llm.bpe import byte_symbols

CHUNK = 500_000  # characters that are aligned at once
_WORDS = 300_000  # words whose ids a worker keeps
_WINDOWS = 150_000  # windows whose alignment a worker keeps
_JOINED = 256  # new words that the tokenizers get as one text
_WS = "\\s\u0085\u180e\ufeff"
_SPACES = frozenset([*filter(str.isspace, map(chr, range(0x3001))), "\u180e", "\ufeff"])
_BETWEEN = b"\xff" * 4  # no id
_CUT = re.compile(f"(?<=[^{_WS}]) (?=[^{_WS}])")


class Side:
    """A tokenizer with the bytes of its tokens; ``encode`` takes texts as they follow a blank."""

    def __init__(self, encode, tokens: list[bytes]):
        if not all(tokens):
            raise ValueError("a token without bytes")
        self.encode, self.tokens = encode, tokens
        self.size = np.array([len(t) for t in tokens], dtype=np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        self.data = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.spaced = np.array([t[:1] == b" " for t in tokens])
        self.flat, self.n = np.empty(0, np.int32), np.zeros(1, np.int64)  # ids of the words kept, and where each word's begin

    def take(self, words: list[str], joined: bool) -> None:
        """Keeps the ids of more words; joined ones are encoded many at a time and parted where their bytes end."""
        if not words:
            return
        flat, sizes = [self.flat], []
        groups = [words[i : i + _JOINED] for i in range(0, len(words), _JOINED)] if joined else []
        for group, ids in zip(groups, self.encode([" ".join(g) for g in groups]) if groups else (), strict=True):
            ids = np.array(ids, dtype=np.int32)
            ends = np.cumsum(self.size[ids])
            wanted = np.cumsum([len(w.encode()) + 1 for w in group])
            at = np.searchsorted(ends, wanted)
            if at[-1] == len(ids) - 1 and (ends[at] == wanted).all():
                flat.append(ids)
                sizes.append(np.diff(at, prepend=-1))
            else:
                self._one_by_one(group, flat, sizes)
        if not joined:
            self._one_by_one(words, flat, sizes)
        self.flat = np.concatenate(flat)
        self.n = np.concatenate([self.n, self.n[-1] + np.cumsum(np.concatenate(sizes))])

    def _one_by_one(self, words: list[str], flat: list, sizes: list) -> None:
        for ids in self.encode(words):
            flat.append(np.array(ids, dtype=np.int32))
            sizes.append([len(ids)])

    def forget(self) -> None:
        self.flat, self.n = np.empty(0, np.int32), np.zeros(1, np.int64)

    def ids(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the kept words in turn, number of ids before each word)."""
        return _gather(self.flat, self.n, words)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return _gather(self.data, self.at, ids)[0]


def _gather(flat: np.ndarray, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(flat[at[i]:at[i + 1]] of every i in which, one after another; the bounds of them)."""
    n = at[which + 1] - at[which]
    bounds = np.concatenate([[0], np.cumsum(n)])
    return flat[np.repeat(at[which] - bounds[:-1], n) + np.arange(bounds[-1])], bounds


def byte_tokens(path: str) -> tuple[object, list[bytes]]:
    """(encoder, bytes of each token) of a byte-level BPE file; special tokens' strings are plain text."""
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(path)
    known.no_truncation()
    known.no_padding()
    known.encode_special_tokens = True
    value = {s: i for i, s in enumerate(byte_symbols())}
    special = {i: t.content for i, t in known.get_added_tokens_decoder().items()}
    tokens = [b""] * known.get_vocab_size(with_added_tokens=True)
    for s, i in known.get_vocab(with_added_tokens=True).items():
        tokens[i] = s.encode() if i in special else bytes(value[c] for c in s)
    return lambda texts: [e.ids for e in known.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)], tokens


def piece_tokens(path: str) -> tuple[object, list[bytes]]:
    """(encoder, bytes of each token) of a sentence-piece file, which puts a blank before a text itself."""
    from sentencepiece import SentencePieceProcessor

    known = SentencePieceProcessor(model_file=path)
    pieces = [known.id_to_piece(i) for i in range(known.get_piece_size())]
    if any("\u2581" in p.lstrip("\u2581") for p in pieces):
        raise ValueError("a piece goes on after a blank: words can't be encoded one by one")
    tokens = [bytes([int(p[3:5], 16)]) if known.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(pieces)]
    return lambda texts: known.encode(texts, num_threads=1), tokens


def pair_bound(a: list[bytes], b: list[bytes]) -> int:
    """Pairs of a token of a and one of b where the bytes of one end in those of the other."""
    def ends_in(long: list[bytes], short: list[bytes], proper: int) -> int:
        n: dict[bytes, int] = {}
        for t in short:
            n[t] = n.get(t, 0) + 1
        return sum(n.get(t[i:], 0) for t in long for i in range(proper, len(t)))

    return ends_in(a, b, 0) + ends_in(b, a, 1)


def stretches(text: str, size: int):
    """The text in stretches of about ``size`` characters, cut at single blanks, which are left out."""
    at = 0
    while len(text) - at > size and (cut := _CUT.search(text, at + size - 1)):
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:]


def _edged(word: str) -> bool:
    return not word or word[0] in _SPACES or word[-1] in _SPACES


class Aligner:
    """Tokens, windows and alignments of many texts at once; keeps words and windows."""

    def __init__(self, a: Side, b: Side):
        self.a, self.b = a, b
        self.words: dict[str, int] = {}  # word between two single blanks -> its number
        self.others: dict[str, int] = {}  # words of texts with other white space around blanks
        self.windows: dict[bytes, tuple[str, bytes]] = {}  # both tuples of ids, packed -> groups as text, linked pairs, packed
        self.written = [f"{i}{sign}" for side, signs in ((a, ",|"), (b, ",;")) for sign in signs for i in range(len(side.tokens))]

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of each word of the texts in turn, words before each text): a text is cut at every single blank between visible characters."""
        if len(self.words) + len(self.others) > _WORDS:
            self.words.clear()
            self.others.clear()
            self.a.forget()
            self.b.forget()
        cut = [t.split(" ") for t in texts]
        ends = np.concatenate([[0], np.cumsum([len(c) for c in cut])])
        found = self._look_up(list(chain.from_iterable(cut)), self.words, _edged)
        if (odd := np.flatnonzero(found < 0)).size:  # some blanks stand beside white space: those texts once more
            again = np.unique(np.searchsorted(ends, odd, side="right") - 1).tolist()
            parts = [found[i:j] for i, j in zip(ends, ends[1:], strict=False)]
            for i in again:
                parts[i] = self._look_up(_CUT.split(texts[i]), self.others, None)
            found, ends = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(c) for c in parts])])
        return found, ends

    def _look_up(self, words: list[str], known: dict[str, int], odd) -> np.ndarray:
        """Numbers of the words; those that odd holds for have -1, those of texts with odd words are encoded one by one."""
        found = list(map(known.get, words))
        if None in found:
            new = list(dict.fromkeys(w for w, i in zip(words, found, strict=True) if i is None))
            if odd is not None:
                known.update((w, -1) for w in new if odd(w))
                new = [w for w in new if not odd(w)]
            known.update(zip(new, range(len(self.a.n) - 1, len(self.a.n) - 1 + len(new)), strict=True))
            for side in (self.a, self.b):
                side.take(new, joined=odd is not None)
            found = list(map(known.__getitem__, words))
        return np.array(found, dtype=np.int64)

    def align(self, a: np.ndarray, bounds_a: np.ndarray, b: np.ndarray, bounds_b: np.ndarray) -> list[tuple[str, bytes]]:
        """(groups as text, linked pairs as numbers, packed) of each window of a and b, of which both have equal bytes."""
        end_a, end_b = np.cumsum(self.a.size[a]), np.cumsum(self.b.size[b])
        near = np.searchsorted(end_a, end_b)
        last_b = np.flatnonzero(end_a[near] == end_b)  # the last tokens of the groups
        last_a = near[last_b]
        pairs = (a[last_a].astype(np.int64) * len(self.b.tokens) + b[last_b]).tobytes()
        # the ids as they are written: those of A of a group, then those of B, each with the sign that follows it
        after_a, after_b = np.zeros(len(a), np.int64), np.full(len(b), 2 * len(self.a.tokens), np.int64)
        after_a[last_a] = len(self.a.tokens)
        after_b[last_b] += len(self.b.tokens)
        group_a, group_b = np.searchsorted(last_a, np.arange(len(a))), np.searchsorted(last_b, np.arange(len(b)))
        written = np.empty(len(a) + len(b), np.int64)
        written[np.arange(len(a)) + np.concatenate([[0], last_b + 1])[group_a]] = a + after_a
        written[np.arange(len(b)) + last_a[group_b] + 1] = b + after_b
        signs = list(map(self.written.__getitem__, written.tolist()))
        at, link = (bounds_a + bounds_b).tolist(), (8 * np.searchsorted(last_a, bounds_a)).tolist()
        return [("".join(signs[i:j])[:-1], pairs[k:m]) for i, j, k, m in zip(at, at[1:], link, link[1:], strict=False)]

    def run(self, texts: list[str]) -> list[tuple | None]:
        """For each text (not empty): (tokens of A, tokens of B, groups as text, linked pairs: one a group), or None where the bytes differ."""
        numbers, ends = self.numbers(texts)
        whole = [(" " + t).encode() for t in texts]
        starts = np.concatenate([[0], np.cumsum([len(w) for w in whole])])
        data = np.frombuffer(b"".join(whole), dtype=np.uint8)
        tokens, good = [], np.ones(len(texts), dtype=bool)
        for side in (self.a, self.b):
            ids, bounds = side.ids(numbers)
            first = bounds[ends]  # tokens before each text
            places = np.concatenate([[0], np.cumsum(side.size[ids])])
            fits = np.diff(places[first]) == np.diff(starts)
            if fits.all():
                wrong = np.flatnonzero(side.bytes_of(ids) != data)
                fits[np.searchsorted(starts, wrong, side="right") - 1] = False
            good &= fits
            tokens.append((ids, first, places))
        if not good.all():  # the others once more, by themselves
            kept = [t for t, g in zip(texts, good, strict=True) if g]
            others = iter(self.run(kept) if kept else ())
            return [next(others) if g else None for g in good]

        (a, a_first, a_at), (b, b_first, b_at) = tokens
        spaced_a, spaced_b = np.flatnonzero(self.a.spaced[a]), np.flatnonzero(self.b.spaced[b])
        at_a, at_b = a_at[spaced_a], b_at[spaced_b]
        near = np.minimum(np.searchsorted(at_b, at_a), len(at_b) - 1)
        shared = at_b[near] == at_a  # both begin a space-marked token there, so both end before it
        bounds_a, bounds_b = np.append(spaced_a[shared], len(a)), np.append(spaced_b[near[shared]], len(b))
        own, which = self._distinct(a, bounds_a, b, bounds_b)
        if len(self.windows) > _WINDOWS:
            self.windows.clear()
        packed_a, packed_b = a.tobytes(), b.tobytes()
        cuts = zip((4 * bounds_a[own]).tolist(), (4 * bounds_a[own + 1]).tolist(), (4 * bounds_b[own]).tolist(), (4 * bounds_b[own + 1]).tolist(), strict=True)
        keys = [packed_a[i:j] + _BETWEEN + packed_b[k:m] for i, j, k, m in cuts]
        done = list(map(self.windows.get, keys))
        new = [i for i, d in enumerate(done) if d is None]
        if new:
            for i, found in zip(new, self.align(*_gather(a, bounds_a, own[new]), *_gather(b, bounds_b, own[new])), strict=True):
                done[i] = self.windows[keys[i]] = found
        named, linked = zip(*done, strict=True)
        pairs, pair_at = _gather(np.frombuffer(b"".join(linked), dtype=np.int64), np.cumsum([0, *map(len, linked)]) // 8, which)
        window = np.searchsorted(bounds_a, a_first)  # every text begins with a window
        listed = which.tolist()
        out = []
        for i in range(len(texts)):
            w, v = int(window[i]), int(window[i + 1])
            out.append((int(a_first[i + 1] - a_first[i]), int(b_first[i + 1] - b_first[i]), ";".join(map(named.__getitem__, listed[w:v])), pairs[pair_at[w] : pair_at[v]]))
        return out

    @staticmethod
    def _distinct(a, bounds_a, b, bounds_b) -> tuple[np.ndarray, np.ndarray]:
        """(one window of each kind, the kind of each window); equal hashes are compared in full."""
        h = vector.sequence_hashes(vector.mix(a.astype(np.uint64) + vector.P1), bounds_a) * vector.P2 + vector.sequence_hashes(vector.mix(b.astype(np.uint64) + vector.P2), bounds_b)
        _, own, which = np.unique(h, return_index=True, return_inverse=True)
        same = True
        for ids, bounds in ((a, bounds_a), (b, bounds_b)):
            n = np.diff(bounds)
            if same := same and bool((n == n[own][which]).all()):
                same = bool((ids == ids[np.repeat(bounds[own][which] - bounds[:-1], n) + np.arange(len(ids))]).all())
        every = np.arange(len(bounds_a) - 1)
        return (own, which) if same else (every, every)


@lru_cache(maxsize=1)
def aligner(a_path: str, b_path: str) -> Aligner:
    """One of a worker's, so that its words and windows serve the next task, too."""
    return Aligner(Side(*byte_tokens(a_path)), Side(*piece_tokens(b_path)))


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def aligned(docs: DataFrame, paths: tuple[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_a, n_b, n_groups, n_links, groups, pairs, times): alignment of each text.

    groups lists the ids of A and B between shared ends; pairs has each linked
    pair once, as id of A times the size of B's vocabulary plus id of B, and
    times how often.
    """
    paths = paths or default_paths()
    kind = docs.schema[id_col]
    schema = T.StructType([T.StructField(id_col, kind.dataType)] + [T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links")] + [
        T.StructField("groups", T.StringType()), T.StructField("pairs", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.LongType()))])

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        known = aligner(*paths)
        for batch in batches:
            yield from _align_batch(known, batch, schema.names)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def _align_batch(known: Aligner, batch, names):
    first = at = size = 0  # rows handed on, rows seen, characters waiting
    waiting: list[tuple[int, str]] = []
    found: dict[int, list] = {}

    def settle():
        for (i, _), one in zip(waiting, known.run([t for _, t in waiting]) if waiting else (), strict=True):
            found.setdefault(i, []).append(one)
        waiting.clear()

    def rows():
        columns = [[], [], [], [], [], [], []]
        for i in range(first, at):
            for column, value in zip(columns, _joined(found.pop(i, [])), strict=True):
                column.append(value)
        long = pa.int64()
        kinds = [long, long, long, long, pa.string(), pa.list_(long), pa.list_(long)]
        return pa.RecordBatch.from_arrays([batch.column(0).slice(first, at - first), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names)

    for text in batch.column(1):
        text = text.as_py()
        if text and "\u2581" not in text:
            for part in stretches(text, CHUNK):
                waiting.append((at, part))
                size += len(part)
                if size >= CHUNK:
                    settle()
                    size = 0
        at += 1
        if not waiting and first < at:
            yield rows()
            first = at
    settle()
    if first < at:
        yield rows()


def _joined(parts: list[tuple | None]) -> tuple:
    """A text's row from its stretches."""
    if not parts or None in parts:
        return 0, 0, 0, 0, "", [], []
    links = np.concatenate([p[3] for p in parts])  # as many as groups: no token is empty
    pairs, times = np.unique(links, return_counts=True)
    return sum(p[0] for p in parts), sum(p[1] for p in parts), len(links), len(links), ";".join(p[2] for p in parts), pairs, times


def pair_counts(rows: DataFrame, n_b: int) -> DataFrame:
    """(pair, n, best): how often each pair is linked, and whether its token of B is linked with no other one more often."""
    counts = rows.select(F.inline(F.arrays_zip("pairs", "times"))).groupBy("pairs").agg(F.sum("times").alias("n"))
    top = F.max("n").over(W.partitionBy(F.col("pairs") % n_b))  # at most as many rows as tokens of A
    return counts.select(F.col("pairs").alias("pair"), "n", (F.col("n") == top).alias("best"))


def scored(rows: DataFrame, counts: DataFrame, bound: int) -> DataFrame:
    """rows, a written table, with n_best and count_sum in place of pairs and times; bound is the most rows that counts can have."""
    own = [c for c in rows.columns if c not in ("pairs", "times")]
    links = rows.select(F.monotonically_increasing_id().alias("__row"), *own, "pairs", "times").select("__row", *own, F.inline_outer(F.arrays_zip("pairs", "times")))
    counts = counts.withColumnRenamed("pair", "pairs").hint("broadcast" if bound <= BROADCAST_ROWS else "merge")
    sums = {"n_best": F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)), "count_sum": F.sum(F.col("times") * F.col("n"))}
    return links.join(counts, "pairs", "left").groupBy("__row", *own).agg(*[F.coalesce(v, F.lit(0)).alias(k) for k, v in sums.items()]).drop("__row")


def alignment(docs: DataFrame, paths: tuple[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: tokens, groups and links, how many links are their B token's most frequent, the sum of their counts, and the digest of the groups."""
    paths = paths or default_paths()
    known = aligner(*paths)
    a, b = known.a.tokens, known.b.tokens
    rows = aligned(docs, paths, id_col, text_col)
    rows = stored(rows.withColumn("groups_sha256", F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")).drop("groups"))
    return scored(rows, stored(pair_counts(rows, len(b))), pair_bound(a, b))
