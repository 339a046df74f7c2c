"""License scans: winnowed fingerprints pick candidates, hits are chained, and the gaps between them aligned in bands.

Of every ``WINDOW`` grams in a row the one with the smallest hash is a
fingerprint, so a run of WINDOW + GRAM - 1 equal words shares one for sure. A
template of 16 words or more of which 0.8 stand in a text without others between
them keeps a run of four, which is what GRAM 3 and WINDOW 2 need; shorter
notices keep two words together and have all their pairs as fingerprints. The
templates are few, so their inverted index (fingerprint -> template, place)
travels with the tasks.

The hits of a template are chained in order of both places, over several
diagonals: words put in or left out cost a little by their number, so that two
copies in a row stay two. A chain goes on over at most ``GAP`` words of the text.
What lies between two hits, before the first and after the last is aligned word
by word in a band of ``BAND`` words about the gap's own shift. A template of
which ``MIN_COVERAGE`` of the words match in order is reported with its span.

Defined results: null and empty texts match nothing; occurrences of a template
don't overlap, the fuller one stands, of equals the first; different templates
over the same words are all reported, by place and then by name, but of short
notices only those with the fewest words missed or put in, ties all; repeated
rows are scanned alike; an empty table gives no rows; long texts are scanned
whole; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, insort
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwise.llm import _vector as vector

BAND, GAP, MIN_COVERAGE, SHORT = 8, 512, 0.8, 16
#: (words in a gram, grams in a window) of long templates and of short ones.
LONG_PRINTS, SHORT_PRINTS = (3, 2), (2, 1)
_SHIFT_COST = 0.01  # a word put in or left out, in words that a chain gains
_WORD = re.compile(r"\w+")

#: Notices and permission texts of public licenses.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "mit-notice": "Released under the MIT License.",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        'substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, '
        "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
        "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING "
        "FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "mpl-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
        "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
        "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
        "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
        "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
        "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
        "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
        "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "agpl-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "lgpl-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "gpl-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
}
_KINDS = {"by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nc": "Attribution-NonCommercial", "by-nd": "Attribution-NoDerivatives", "by-nc-sa": "Attribution-NonCommercial-ShareAlike", "by-nc-nd": "Attribution-NonCommercial-NoDerivatives"}
TEMPLATES |= {f"cc-{k}-4.0-short": f"Licensed under CC {k.upper()} 4.0." for k in _KINDS}
TEMPLATES |= {f"cc-{k}-4.0-notice": f"This work is licensed under a Creative Commons {v} 4.0 International License." for k, v in _KINDS.items()}
#: Whole texts of the longer licenses, one file each.
TEMPLATES |= {p.stem.lower(): p.read_text(encoding="utf-8") for p in sorted((Path(__file__).parent / "licenses").glob("*.txt"))}


def tokens(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]  # word by word: lower case may lengthen a text, which must not move its words


def winnow(h: np.ndarray, window: int) -> np.ndarray:
    """Places of the smallest hash, the last of equals, of every ``window`` hashes in a row (of all of them where there are fewer)."""
    if len(h) <= 1 or window == 1:
        return np.arange(len(h))
    if len(h) < window:
        return np.array([len(h) - 1 - int(h[::-1].argmin())])
    rows = np.lib.stride_tricks.sliding_window_view(h, window)
    return np.unique(np.arange(len(rows)) + window - 1 - rows[:, ::-1].argmin(axis=1))


def fingerprints(codes: np.ndarray, base: int, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(grams, places) of the winnowed fingerprints of a sequence of word codes."""
    n = len(codes) - gram + 1
    if n < 1:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    grams = codes[:n].copy()
    for i in range(1, gram):
        grams = grams * base + codes[i : n + i]
    at = winnow(vector.mix(grams.astype(np.uint64) * vector.P1), window)
    return grams[at], at


class Prints:
    """Inverted index of the fingerprints of some templates: sorted fingerprints, and the (template, place) entries of each."""

    def __init__(self, codes: list[np.ndarray], which: list[int], base: int, kind: tuple[int, int]):
        self.base, (self.gram, self.window) = base, kind
        found = [(g, t, q) for t in which for g, q in zip(*map(np.ndarray.tolist, fingerprints(codes[t], base, *kind)), strict=True)]
        found.sort()
        self.key = np.array([g for g, _, _ in found], dtype=np.int64)
        self.template = np.array([t for _, t, _ in found], dtype=np.int64)
        self.place = np.array([q for _, _, q in found], dtype=np.int64)

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(template, place in the text, place in the template) of every shared fingerprint."""
        grams, at = fingerprints(codes, self.base, self.gram, self.window)
        low, high = np.searchsorted(self.key, grams), np.searchsorted(self.key, grams, side="right")
        n = high - low
        entry = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.empty(0, np.int64)
        return self.template[entry], np.repeat(at, n), self.place[entry]


class Index:
    """The templates in one vocabulary, with their inverted indexes."""

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        self.words = [tokens(templates[n]) for n in self.names]
        self.code = {w: i + 1 for i, w in enumerate(sorted({w for ws in self.words for w in ws}))}
        self.codes = [np.array([self.code[w] for w in ws], dtype=np.int64) for ws in self.words]
        base = len(self.code) + 1
        short = [t for t, ws in enumerate(self.words) if len(ws) < SHORT]
        self.prints = [Prints(self.codes, [t for t in range(len(self.words)) if t not in set(short)], base, LONG_PRINTS), Prints(self.codes, short, base, SHORT_PRINTS)]
        self.need = [math.ceil(MIN_COVERAGE * len(ws)) for ws in self.words]

    def scan(self, text: str) -> list[tuple[str, int, int, int, int]]:
        """(template, words matched, words, start, stop) of every occurrence in text."""
        words = tokens(text)
        get = self.code.get
        codes = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        found = []
        for prints in self.prints:
            template, p, q = prints.hits(codes)
            for t in np.unique(template).tolist():
                own = template == t
                found += self._occurrences(t, codes, p[own], q[own], prints)
        if not found:
            return []
        spans = [m.span() for m in _WORD.finditer(text)]
        kept = sorted(_fewest_errors(found, [len(ws) for ws in self.words]), key=lambda x: (x[2], self.names[x[0]]))
        return [(self.names[t], n, len(self.words[t]), spans[first][0], spans[last][1]) for t, n, first, last in kept]

    def _occurrences(self, t: int, codes: np.ndarray, p: np.ndarray, q: np.ndarray, prints: Prints) -> list[tuple[int, int, int, int]]:
        """(template, words matched, first, last place) of the template's occurrences, none over another."""
        own, need, gram = self.codes[t], self.need[t], prints.gram
        m, longest = len(own), prints.gram + prints.window - 2  # words that can match in a row without a hit
        own_counts = np.bincount(own, minlength=len(self.code) + 1)
        out, kept = [], []
        for chain in chains(p, q, gram):
            at = np.array(chain)
            p0, q0, p1, q1 = chain[0][0], chain[0][1], chain[-1][0] + gram, chain[-1][1] + gram
            gaps = np.concatenate([[q0], np.maximum(np.diff(at[:, 1]) - gram, 0), [m - q1]])
            most = m - gaps.sum() + np.minimum(gaps, gaps * longest // (longest + 1) + longest).sum()
            if most < need or any(y[2] <= p0 and p1 - 1 <= y[3] for y in _beside(kept, (t, 0, p0, p1 - 1))):
                continue  # too few hits, or an occurrence that is found already
            low, high = max(0, p0 - q0 - BAND), min(len(codes), p1 + m - q1 + BAND)
            if np.minimum(np.bincount(codes[low:high], minlength=len(own_counts)), own_counts)[1:].sum() < need:
                continue  # not enough of the template's words are there
            n, first, last = _aligned(own, codes, chain, gram, low, high)
            if n >= need:
                out.append((t, n, first, last))
                if all(last < y[2] or y[3] < first for y in _beside(kept, out[-1])):
                    insort(kept, out[-1], key=lambda y: y[2])
        kept = []
        for x in sorted(out, key=lambda x: (-x[1], x[3] - x[2], x[2])):
            if all(x[3] < y[2] or y[3] < x[2] for y in _beside(kept, x)):
                insort(kept, x, key=lambda y: y[2])
        return kept


def _beside(kept: list, x: tuple) -> list:
    """Of occurrences sorted by place, none over another, those next to x's first place."""
    i = bisect_left(kept, x[2], key=lambda y: y[2])
    j = bisect_left(kept, x[3] + 1, key=lambda y: y[2])
    return kept[max(0, i - 1) : j]


def chains(p: np.ndarray, q: np.ndarray, gram: int) -> list[list[tuple[int, int]]]:
    """Hits (place in the text, place in the template) in chains that grow in both, the best ones first; a hit is in one chain at most.

    A chain's worth is the words that its hits cover, less a little for every word of shift between two hits.
    """
    order = np.lexsort((q, p))
    p, q = p[order], q[order]
    worth, before = np.full(len(p), float(gram)), np.full(len(p), -1)
    start = np.searchsorted(p, p - GAP - gram)
    for i in range(1, len(p)):
        j = slice(int(start[i]), i)
        dp, dq = p[i] - p[j], q[i] - q[j]
        gain = worth[j] + np.minimum(np.minimum(dp, dq), gram) - _SHIFT_COST * np.abs(dp - dq)
        gain[(dp <= 0) | (dq <= 0)] = -1
        if len(gain) and (best := int(len(gain) - 1 - gain[::-1].argmax())) >= 0 and gain[best] > gram:
            worth[i], before[i] = gain[best], j.start + best
    used = np.zeros(len(p), dtype=bool)
    out = []
    for i in np.argsort(-worth, kind="stable").tolist():
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append((int(p[i]), int(q[i])))
            i = int(before[i])
        if chain:
            out.append(chain[::-1])
    return out


def _aligned(own: np.ndarray, codes: np.ndarray, chain: list[tuple[int, int]], gram: int, low: int, high: int) -> tuple[int, int, int]:
    """(words matched, first, last place) of a template along a chain: the hits' words, and banded alignments before, between and after."""
    p, q = chain[0]
    n, first = align(own[:q][::-1], codes[low:p][::-1])
    first = p - first
    n += gram
    p, q = p + gram, q + gram
    for p1, q1 in chain[1:]:
        if p1 >= p and q1 >= q:
            n += align(own[q:q1], codes[p:p1])[0] + gram
        else:  # grams that share words
            n += min(p1 + gram - p, q1 + gram - q)
        p, q = p1 + gram, q1 + gram
    more, last = align(own[q:], codes[p:high])
    return n + more, first, p + last - 1


def align(a: np.ndarray, b: np.ndarray, band: int = BAND) -> tuple[int, int]:
    """(most words of a matched in order in b, words of b up to the last match, the fewest of equals), in a band about the shift of their ends."""
    if not len(a) or not len(b):
        return 0, 0
    low, high = min(0, len(b) - len(a)) - band, max(0, len(b) - len(a)) + band
    a, b = a.tolist(), b.tolist()
    row = {}  # place in b, from 1 -> (matches, minus the place of the last one), so far in a
    none = (0, 0)
    for i, x in enumerate(a):
        new, left = {}, row.get(max(0, i + low), none)  # what the band leaves behind is carried along its edge
        for j in range(max(0, i + low), min(len(b), i + high + 1)):
            best = max(left, row.get(j + 1, none))
            if x == b[j]:
                best = max(best, (row.get(j, none)[0] + 1, -(j + 1)))
            new[j + 1] = left = best
        row = new
    best = max(row.values(), default=none)
    return best[0], -best[1]


def _fewest_errors(found: list[tuple[int, int, int, int]], sizes: list[int]) -> list[tuple[int, int, int, int]]:
    """Of short notices over the same words, those with the fewest words missed or put in: CC BY-NC is no CC BY."""
    errors = lambda x: (sizes[x[0]] - x[1]) + (x[3] - x[2] + 1 - x[1])
    short = sorted((x for x in found if sizes[x[0]] < SHORT), key=lambda x: x[2])
    out, open_ = [x for x in found if sizes[x[0]] >= SHORT], []
    beaten = set()
    for i, x in enumerate(short):
        open_ = [k for k in open_ if short[k][3] >= x[2]]  # a notice is a few words long, so few are open at once
        for k in open_:
            if errors(short[k]) != errors(x):
                beaten.add(i if errors(short[k]) < errors(x) else k)
        open_.append(i)
    return out + [x for i, x in enumerate(short) if i not in beaten]


@lru_cache(maxsize=4)
def _index(items: tuple[tuple[str, str], ...]) -> Index:
    return Index(dict(items))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, license, n_matched, n_words, start, stop): every occurrence of a template; start and stop count characters."""
    kind = docs.schema[id_col].dataType.simpleString()
    items = tuple(sorted((templates or TEMPLATES).items()))

    def run(batches):
        index = _index(items)
        for batch in batches:
            owner, rows = [], []
            for i, text in enumerate(batch.column(1)):
                for row in index.scan(text.as_py() or ""):
                    owner.append(i)
                    rows.append(row)
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owner, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                ["k", "license", "n_matched", "n_words", "start", "stop"],
            )

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, license string, n_matched long, n_words long, start long, stop long")
