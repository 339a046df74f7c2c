"""BPE encoding and decoding with a tokenization automaton.

The merges of a public tokenizer file are compiled into a deterministic
automaton over tokens by one merge gadget after another. Each token has one
state (all arcs with its label lead there). Merge number k, (u, v) -> w, adds
arcs w where arcs u were (state s gets an arc w if it has an arc u, and u's
state an arc v), gives w the outgoing arcs of v, and takes the arc v from the
state of u. A word's BPE tokenization is the one path through the automaton
whose labels spell the word. The arcs are compiled on demand, as far as the
words need them, and kept in a transition table; ``eager_arcs`` does the whole
construction and serves the tests.

Defined results: null text is the empty text; an empty text has no tokens and
decodes to the empty text; rows are independent, so ties, repeated rows and
clashing column names change nothing (only ``id_col`` and ``text_col`` are read).
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Unicode White_Space, which the tokenizer's \s means (Python's also has U+001C to U+001F).
_WS = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_SPLIT = re.compile(f"[{_WS}]+")
_ODD = re.compile("[\x1c-\x1f]")
_KEEP = 100_000  # words in each of the two generations whose ids a worker keeps
_NEVER = 1 << 60


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in set(plain) else chr(256 + rest.index(b)) for b in range(256)]


class Automaton:
    """Tokenization automaton of a merge list, with arcs compiled on demand."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], base: list[str]):
        self.made, self.parts, self.rank = {}, {}, {}
        for s in base:
            self.made[vocab[s]] = 0
        for k, (a, b) in enumerate(merges, 1):
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            self.rank.setdefault((u, v), k)
            if w not in self.made:
                self.made[w], self.parts[w] = k, (u, v)
        self.tables: dict[int, dict[int, bool]] = {}  # state (its token) -> arc label -> there or not
        self._memo: dict[tuple[int, int], bool] = {}
        self._live: dict[int, bool] = {}

    def arc(self, s: int, t: int) -> bool:
        """Whether the finished automaton has an arc t from the state of s."""
        row = self.tables.setdefault(s, {})
        found = row.get(t)
        if found is None:
            found = row[t] = self._arc_before(s, t, _NEVER)
        return found

    def _arc_before(self, s: int, t: int, k: int) -> bool:
        """Whether the arc was there just before merge k."""
        if self.rank.get((s, t), _NEVER) < k:
            return False
        a, b = self.made[s], self.made[t]
        if not a and not b:
            return True
        key = (s, t)
        found = self._memo.get(key)
        if found is None:
            if b > a:  # t came later: it got an arc wherever its left part had one
                u, v = self.parts[t]
                found = not (u == v == s) and self._arc_before(s, u, b)
            elif a > b:  # s came later: its state copies that of its right part
                found = self._arc_before(self.parts[s][1], t, a)
            else:
                u, v = self.parts[s]
                found = self._arc_before(v, u, a)
            self._memo[key] = found
        return found

    def live(self, w: int) -> bool:
        """Whether merge w ever got arcs: its parts met in the automaton of that time."""
        if w not in self.parts:
            return True
        found = self._live.get(w)
        if found is None:
            u, v = self.parts[w]
            k = self.made[w]
            found = self._live[w] = self.live(u) and self.live(v) and self._met(u, v, k)
        return found

    def _met(self, u: int, v: int, k: int) -> bool:
        del_rank = self.rank[u, v]
        return del_rank == k and self._arc_before(u, v, k)

    def eager_arcs(self) -> set[tuple[int, int]]:
        """All arcs by the whole construction, merge after merge (quadratic: for small merge lists)."""
        states = [s for s, k in self.made.items() if not k]
        arcs = {(s, t) for s in states for t in states}
        for w, k in sorted(self.made.items(), key=lambda x: x[1]):
            if not k:
                continue
            u, v = self.parts[w]
            if (u, v) not in arcs:
                continue
            into = {s for s in states if (s, u) in arcs and not (u == v == s)}
            out = {t for t in states if (v, t) in arcs}
            loop = (v, u) in arcs
            states.append(w)
            arcs |= {(s, w) for s in into} | {(w, t) for t in out} | ({(w, w)} if loop else set())
            arcs.discard((u, v))
        return arcs


class WordBpe:
    """Encoder and decoder of a word-end BPE tokenizer file (lower case, white space dropped)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pre = regex.compile(pattern.replace(r"\s", _WS))
        self.symbols = byte_symbols()
        base = [*self.symbols, *(s + self.end for s in self.symbols)]
        self.auto = Automaton(vocab, [tuple(m) for m in model["merges"]], base)
        # trie over symbols; a last symbol with the word end is a symbol of its own
        self.trie: dict = {}
        for s, i in vocab.items():
            if i in self.auto.made and self.auto.live(i):
                body = s[: -len(self.end)] if self.end and s.endswith(self.end) and len(s) > len(self.end) else s
                path_ = [*body[:-1], body[-1] + (self.end if body is not s else "")]
                node = self.trie
                for c in path_:
                    node = node.setdefault(c, {})
                node[0] = i
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.seen: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def word(self, word: str) -> list[int]:
        """Tokens of one pre-split word: the one path of the automaton that spells it."""
        s = [self.symbols[b] for b in word.encode("utf-8")]
        s[-1] += self.end
        n = len(s)
        tables, trie = self.auto.tables, self.trie
        path: list[int] = []  # tokens so far
        tries: list[list[tuple[int, int]]] = []  # arcs not yet tried at each step, shortest first
        j, at = 0, None
        while True:
            node, i, arcs = trie, j, []
            while i < n:
                node = node.get(s[i])
                if node is None:
                    break
                i += 1
                t = node.get(0)
                if t is not None:
                    arcs.append((t, i))
            while True:  # the longest arc that the state has, else back
                found = False
                while arcs:
                    t, i = arcs.pop()
                    if at is None:
                        found = True
                    else:
                        found = at.get(t)
                        if found is None:
                            found = self.auto.arc(path[-1], t)
                    if found:
                        break
                if found:
                    break
                arcs = tries.pop()
                path.pop()
                at = tables[path[-1]] if path else None
            path.append(t)
            if i == n:
                return path
            tries.append(arcs)
            at = tables.get(t)
            if at is None:
                at = tables[t] = {}
            j = i

    def chunk(self, chunk: str) -> tuple[int, ...]:
        """Tokens of a stretch without white space."""
        if chunk.isascii():
            low = chunk.lower()
        else:
            low = "".join(c.lower() for c in unicodedata.normalize("NFC", chunk))
        return tuple(t for w in self.pre.findall(low) for t in self.word(w))

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        seen = self.seen
        for part in self.cut.split(text) if self.cut and "<|" in (text or "") else (text or "",):
            if part in self.special:
                out.append(self.special[part])
                continue
            for c in _SPLIT.split(part) if _ODD.search(part) else part.split():
                ids = seen.get(c)
                if ids is None:
                    ids = self.older.get(c) or self.chunk(c)
                    if len(c) < 48:
                        if len(seen) >= _KEEP:
                            self.older, self.seen = seen, {}
                            seen = self.seen
                        seen[c] = ids
                out += ids
        if len(self.auto._memo) > 300_000:
            self.auto._memo.clear()
        return out


def decoder(path: str):
    """ids -> arc labels in order, one blank between two (the file names no decoder)."""
    label = _labels(path).__getitem__
    return lambda ids: " ".join(map(label, ids))


@lru_cache(maxsize=2)
def _labels(path: str) -> dict[int, str]:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return {i: s for s, i in [*spec["model"]["vocab"].items(), *((t["content"], t["id"]) for t in spec["added_tokens"])]}


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordBpe:
    return WordBpe(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>) for every row of docs."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        bpe = tokenizer(path)
        for batch in batches:
            ids, ends = [], [0]
            flat: list[np.ndarray] = []
            for t in batch.column(1):
                one = np.array(bpe.encode(t.as_py()), dtype=np.int32)
                flat.append(one)
                ends.append(ends[-1] + len(one))
                if ends[-1] > 1_000_000:  # hand on before the batch grows large
                    yield _ids_batch(batch.column(0).slice(len(ids), len(ends) - 1), flat, ends)
                    ids += [None] * (len(ends) - 1)
                    flat, ends = [], [0]
            if flat:
                yield _ids_batch(batch.column(0).slice(len(ids), len(ends) - 1), flat, ends)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def _ids_batch(keys, flat, ends):
    values = pa.array(np.concatenate(flat) if flat else np.empty(0, np.int32))
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
    return pa.RecordBatch.from_arrays([keys, lists], ["k", "ids"])


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """encoded with a column ``decoded`` more; null ids decode to the empty text."""
    if "decoded" in encoded.columns:
        encoded = encoded.drop("decoded")
    at = encoded.columns.index(ids_col)
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches):
        label = decoder(path)
        for whole, i in ((b, i) for b in batches for i in range(0, max(1, b.num_rows), 256)):
            batch = whole.slice(i, 256)
            column = batch.column(at)
            texts = [label(x.values.to_numpy(zero_copy_only=False).tolist() if x.is_valid else []) for x in column]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, schema)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document: token count and digests of the ids and of the decoded text."""
    path = path or default_path()
    both = decode(encode(docs, path), path)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
