"""Loss and score terms by name, and weighted sums of them, over samples of vectors.

Samples are (group, i, x, y): prediction x and target y of sample i, arrays of one
length in a group. A term names the states that it is read from; a state is a list of
numbers that adds up over parts of a group, whatever its shape is:

* ``columns``: rows, then the sums of x, y, xx, yy, xy of each column,
* ``products``: z'z of z = (1, |x|^2, |y|^2, x, y), from which kernels are aligned,
* ``pairs``: number and moments of the two dissimilarities of all pairs of samples,
  left by tasks that hold two blocks of samples.

All states of a composite are summed by group in one aggregation, each state once even
where several terms read it, and the terms of a group are finished from its sums alone.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwise.operators import pairwise as P

EPS = 1e-8


class States:
    """The summed states of one group, by name."""

    def __init__(self, held: dict[str, np.ndarray], dx: int):
        self.held, self.dx = held, dx

    @property
    def products(self) -> np.ndarray:
        s = self.held["products"]
        return s.reshape(int(np.sqrt(s.size)), -1)

    @property
    def columns(self) -> tuple[float, np.ndarray]:
        """(rows, the five sums by column); the products hold them, too."""
        if "columns" in self.held:
            s = self.held["columns"]
            return s[0], s[1:].reshape(5, -1)
        s, d = self.products, self.dx
        x, y = slice(3, 3 + d), slice(3 + d, None)
        return s[0, 0], np.stack([s[0, x], s[0, y], np.diag(s[x, x]), np.diag(s[y, y]), np.diag(s[x, y])])


def _mse(s: States) -> float:
    n, (_, _, xx, yy, xy) = s.columns
    return float((xx + yy - 2 * xy).sum() / (n * len(xx)))


def _pearson(s: States) -> float:
    n, (x, y, xx, yy, xy) = s.columns
    norm = lambda sq, total: np.maximum(np.sqrt(np.maximum(sq - total * total / n, 0)), EPS)
    return float(((xy - x * y / n) / (norm(xx, x) * norm(yy, y))).mean())


def _ev(s: States) -> float:
    n, (x, y, xx, yy, xy) = s.columns
    left = n * (xx + yy - 2 * xy) - (y - x) ** 2
    return float(np.minimum(1 - left / np.maximum(n * yy - y * y, EPS), 1).mean())


def _rsa(s: States) -> float:
    n, a, b, ab, aa, bb = s.held["pairs"]
    if not n:
        return 0.0
    norm = lambda sq, total: np.sqrt(max(sq - total * total / n, 0.0))
    return float((ab - a * b / n) / max(norm(aa, a) * norm(bb, b), EPS))


def _cka(s: States) -> float:
    return float(P._linear(s.products, s.dx))


def _cka_unbiased(s: States) -> float | None:
    return P._unbiased(s.products, s.dx)


@dataclass(frozen=True)
class Score:
    states: frozenset[str]
    finish: Callable[[States], float | None]


#: Scores by name.
SCORES = {
    "mse": Score(frozenset({"columns"}), _mse),
    "pearson": Score(frozenset({"columns"}), _pearson),
    "ev": Score(frozenset({"columns"}), _ev),
    "rsa": Score(frozenset({"pairs"}), _rsa),
    "cka": Score(frozenset({"products"}), _cka),
    "cka_unbiased": Score(frozenset({"products"}), _cka_unbiased),
}
#: Loss terms by name: the score that each is made of, and how.
TERMS: dict[str, tuple[str, Callable[[Column], Column]]] = {
    "mse": ("mse", lambda v: v),
    "pearson": ("pearson", lambda v: 1 - v),
    "rsa": ("rsa", lambda v: 1 - v),
    "cka": ("cka", lambda v: 1 - v),
    "rsa_log": ("rsa", lambda v: F.log(1 - v + F.lit(EPS))),
    "cka_log": ("cka", lambda v: F.log(1 - v + F.lit(EPS))),
}
#: Weights of two-term composites; other composites weigh every term 1.
DEFAULT_WEIGHTS = {("mse", "pearson"): (1.0, 0.03), ("pearson", "mse"): (0.03, 1.0)}
_TERM = re.compile(r"(?:log_(?P<before>rsa|cka)|(?P<after>rsa|cka)_log|(?P<plain>[^_]+))(?:_+|\Z)")


def term_names(name: str) -> list[str]:
    """Terms of a composite's name, joined by underscores: log_rsa and rsa_log are one spelling each of the same term."""
    found = [f"{m['before'] or m['after']}_log" if m["plain"] is None else m["plain"] for m in _TERM.finditer(name.strip("_"))]
    if unknown := sorted(set(found) - set(TERMS)):
        raise ValueError(f"no loss terms {unknown} (in {name!r}); there are {sorted(TERMS)}")
    if not found or len({TERMS[t][0] for t in found}) < len(found):
        raise ValueError(f"{name!r} must name one or more terms, none of them twice")
    return found


def term_weights(name: str, weights: Mapping[str, float | None] | Sequence[float] | None = None) -> dict[str, float]:
    """Weight of each term; given by the score's name (None: the default) or in the order of the terms."""
    terms = term_names(name)
    default = dict(zip(terms, DEFAULT_WEIGHTS.get(tuple(terms), (1.0,) * len(terms)), strict=True))
    if weights is None:
        return default
    if not isinstance(weights, Mapping):
        if len(weights) != len(terms):
            raise ValueError(f"{len(terms)} weights are needed for {name!r}")
        weights = {TERMS[t][0]: w for t, w in zip(terms, weights, strict=True)}
    own = {TERMS[t][0]: t for t in terms}
    if stray := sorted(k for k, w in weights.items() if w is not None and k not in own):
        raise ValueError(f"weights {stray} belong to no term of {name!r}")
    made = default | {own[k]: float(w) for k, w in weights.items() if w is not None}
    if min(made.values()) < 0 or not any(made.values()):
        raise ValueError(f"weights of {name!r} must not be negative, nor all be zero: {made}")
    return made


def samples(df: DataFrame, row: str = "row", parcel: str = "parcel", group: str | None = None) -> DataFrame:
    """(group, i, x, y) of long rows (row, parcel, pred, target): a sample's vectors in the order of its parcels, which every sample must have.

    A vector has as many numbers as there are parcels; samples are numbered in any order.
    """
    key = [F.lit(0).alias("group") if group is None else F.col(group).alias("group"), F.col(row).alias("i")]
    cells = F.array_sort(F.collect_list(F.struct(F.col(parcel).alias("p"), F.col("pred").cast("double").alias("x"), F.col("target").cast("double").alias("y"))))
    return df.filter("pred is not null and target is not null").groupBy(*key).agg(cells.alias("c")).select("group", "i", F.col("c.x").alias("x"), F.col("c.y").alias("y"))


def _row_states(rows: DataFrame, kinds: frozenset[str], schema: str) -> DataFrame:
    """States that are sums over samples, one a group and Arrow batch."""

    def run(frames):
        for pdf in frames:
            for g, p in pdf.groupby("group", sort=False, dropna=False):
                x, y = np.stack(p["x"]).astype(float), np.stack(p["y"]).astype(float)
                made = {}
                if "products" in kinds:
                    z = np.hstack([np.ones((len(x), 1)), (x * x).sum(1)[:, None], (y * y).sum(1)[:, None], x, y])
                    made["products"] = (z.T @ z).ravel()
                elif "columns" in kinds:
                    made["columns"] = np.concatenate([[len(x)], x.sum(0), y.sum(0), (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)])
                yield pd.DataFrame({"group": [g] * len(made), "kind": list(made), "dx": x.shape[1], "state": list(made.values())})

    return rows.select("group", "x", "y").mapInPandas(run, schema)


def _pair_states(rows: DataFrame, dissimilarity: str, schema: str) -> DataFrame:
    """Moments of the pairs of two blocks of samples, one row a pair of tiles."""
    origin = 1.0 if dissimilarity in ("correlation", "cosine") else 0.0  # moments about the middle of the scale lose fewer digits

    def task(pdf, low, high):
        states = []
        for _, _, d in P._met(low, high, {"x": dissimilarity, "y": dissimilarity}):
            a, b = d["x"] - origin, d["y"] - origin
            states.append([len(a), a.sum(), b.sum(), a @ b, a @ a, b @ b])
        return pd.DataFrame({"group": [pdf["group"].iloc[0]] * len(states), "kind": "pairs", "dx": 0, "state": states})

    return P._blocks(P._placed(rows), ["x", "y"], task, schema)


def evaluate(rows: DataFrame, scores: Sequence[str], dissimilarity: str = "correlation") -> DataFrame:
    """(group, a column for each named score): all states of all scores in one aggregation. A score may be NULL (too few samples)."""
    if unknown := sorted(set(scores) - set(SCORES)):
        raise KeyError(f"unknown scores {unknown}; there are {sorted(SCORES)}")
    kinds = frozenset().union(*(SCORES[s].states for s in scores))
    kind = rows.schema["group"].dataType.simpleString()
    schema = f"group {kind}, kind string, dx int, state array<double>"
    parts = []
    if kinds & {"columns", "products"}:
        parts.append(_row_states(rows, kinds, schema))
    if "pairs" in kinds:
        parts.append(_pair_states(rows, dissimilarity, schema))
    states = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    summed = states.select("group", "kind", "dx", F.posexplode("state").alias("p", "v")).groupBy("group", "kind", "dx", "p").agg(F.sum("v").alias("v"))
    packed = summed.groupBy("group", "kind", "dx").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "v"))), lambda q: q["v"]).alias("state"))  # of a size set by the columns

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        held = States({k: np.asarray(s, dtype=float) for k, s in zip(pdf["kind"], pdf["state"], strict=True)}, int(pdf["dx"].max()))
        return pd.DataFrame({"group": pdf["group"].iloc[:1].tolist(), **{s: [SCORES[s].finish(held)] for s in scores}}).astype({s: float for s in scores})

    out = packed.groupBy("group").applyInPandas(finish, f"group {kind}, " + ", ".join(f"{s} double" for s in scores))
    return out.select("group", *[F.nanvl(s, F.lit(None).cast("double")).alias(s) for s in scores])


def composite(rows: DataFrame, name: str, weights: Mapping[str, float | None] | Sequence[float] | None = None, dissimilarity: str = "correlation") -> DataFrame:
    """(group, a column for each term with a weight, loss): the weighted sum of the named terms by group."""
    used = {t: w for t, w in term_weights(name, weights).items() if w}
    scored = evaluate(rows, [TERMS[t][0] for t in used], dissimilarity)
    made = {t: TERMS[t][1](F.col(TERMS[t][0])) for t in used}
    terms = [v.alias(t) for t, v in made.items()]
    total = sum((made[t] * w for t, w in used.items()), F.lit(0.0))
    return scored.select("group", *terms, total.alias("loss"))
