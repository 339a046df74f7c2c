"""Words of whole Arrow batches in numpy: no Python object for a word, a line or a text.

Words are the maximal runs of bytes other than ASCII white space. A word's hash
is a polynomial of its bytes modulo 2^64, mixed at the end: a difference of
running sums over the piece, taken back to the word's start by an inverse power.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 18  # bytes of text that are worked on at once (more only for a longer text)
P1, P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_BYTE = np.random.default_rng(42).integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * P2
    return x ^ (x >> np.uint64(29))


class _Powers:
    """Powers of one odd number, as many as were asked for; those of four pieces are kept for the next call."""

    def __init__(self, base: np.uint64):
        self.base, self.held = base, np.ones(1, dtype=np.uint64)

    def __call__(self, n: int) -> np.ndarray:
        if n <= len(self.held):
            return self.held
        out = np.full(max(n, min(2 * len(self.held), 4 * PIECE)), self.base, dtype=np.uint64)
        out[0] = 1
        np.multiply.accumulate(out, out=out)
        if len(out) <= 4 * PIECE:
            self.held = out
        return out


_in_word, _back, _in_text = _Powers(P1), _Powers(np.uint64(pow(int(P1), -1, 1 << 64))), _Powers(P2)


def pieces(column: pa.Array):
    """(first row, bytes, row bounds in them) of stretches of a text column; null is the empty text."""
    data = pc.fill_null(column.cast(pa.large_binary()), b"")
    bounds = np.frombuffer(data.buffers()[1], dtype=np.int64)[data.offset : data.offset + len(data) + 1]
    held = data.buffers()[2]
    held = np.frombuffer(held, dtype=np.uint8) if held is not None else np.empty(0, np.uint8)
    at = 0
    while at < len(data):
        stop = max(at + 1, int(np.searchsorted(bounds, bounds[at] + PIECE, side="right")) - 1)
        yield at, held[bounds[at] : bounds[stop]], bounds[at : stop + 1] - bounds[at]
        at = stop


def words(data: np.ndarray, bounds: np.ndarray, lower: bool = False):
    """(hash, place, has a digit) of each word, and the number of words before each row bound."""
    inside = ~((data == 32) | (data - np.uint8(9) < 5))
    head, tail = inside.copy(), inside.copy()
    head[1:] &= ~inside[:-1]
    tail[:-1] &= ~inside[1:]
    edges = bounds[(bounds > 0) & (bounds < len(data))]  # a word ends where its text ends
    head[edges], tail[edges - 1] = inside[edges], inside[edges - 1]
    at, last = np.flatnonzero(head), np.flatnonzero(tail)
    if not len(at):
        return np.empty(0, np.uint64), at, np.empty(0, bool), np.zeros(len(bounds), dtype=np.int64)
    sums = (_LOWER if lower else _BYTE)[data]
    sums *= _in_word(len(data))[: len(data)]
    np.cumsum(sums, out=sums)
    before = np.where(at > 0, sums[at - 1], np.uint64(0))
    digit = np.zeros(len(at), dtype=bool)
    digit[np.searchsorted(at, np.flatnonzero(data - np.uint8(48) < 10), side="right") - 1] = True
    return mix((sums[last] - before) * _back(int(at[-1]) + 1)[at]), at, digit, np.searchsorted(at, bounds)


def sequence_hashes(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hash of the sequence h[first[i]:first[i + 1]] for each i; an empty one has zero."""
    n = np.diff(first)
    some = np.flatnonzero(n)
    out = np.zeros(len(n), dtype=np.uint64)
    if len(some):
        local = np.arange(first[0], first[-1]) - np.repeat(first[:-1], n)
        out[some] = mix(np.add.reduceat(h[first[0] : first[-1]] * _in_text(int(n.max()))[local], (first[:-1] - first[0])[some]) + n[some].astype(np.uint64) * P1)
    return out


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds) of the k-word shingles of each text, repeats included; a shorter text has one, a text without words none."""
    n, w = np.diff(first), len(h)
    if not w:
        return h, np.zeros(len(first), dtype=np.int64)
    end, begin, i = np.repeat(first[1:], n), np.repeat(first[:-1], n), np.arange(w)
    out = np.zeros(w, dtype=np.uint64)
    for j in range(k):
        out = mix(out * P1 + np.where(i + j < end, h[np.minimum(i + j, w - 1)], np.uint64(0)))
    counts = np.where(n > 0, np.maximum(n - k + 1, 1), 0)
    return out[i <= np.maximum(end - k, begin)], np.concatenate([[0], np.cumsum(counts)])
