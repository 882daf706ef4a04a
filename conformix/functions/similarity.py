"""Similarity of names, types, parameters and features.

Scores are IEEE doubles added in a fixed order, so thresholds decide alike
everywhere. Kernels work on plain Python values; within a module they run once
for each pair of distinct values and are then gathered into matrices.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.assignment import best_assignment

EARLY_EXIT = 0.8


@dataclass(frozen=True)
class Weights:
    """Shares of the parts of a feature's score."""

    name: float = 0.30
    member_of: float = 0.30
    namespace: float = 0.15
    parameters: float = 0.15
    return_type: float = 0.10

    @classmethod
    def of(cls, values: dict[str, float]) -> Weights:
        """From a mapping that must name all five parts."""
        missing = {"name", "member_of", "namespace", "parameters", "return_type"} - set(values)
        if missing:
            raise ValueError(f"weights lack {sorted(missing)}")
        return cls(**{k: values[k] for k in cls.__dataclass_fields__})

    def for_class(self, kind: str) -> tuple[float, float, float]:
        """Weights of name, class and namespace for a pair of one class of kinds."""
        if kind == "C":
            return 0.0, self.member_of + self.name, self.namespace
        if kind == "F":
            half = self.member_of / 2
            return self.name + half, half, self.namespace
        return self.name, self.member_of, self.namespace


@lru_cache(maxsize=1 << 16)
def jaro_winkler(a: str, b: str, both_empty: float = 0.0) -> float:
    """Jaro-Winkler similarity: prefix scale 0.1 up to 4 characters, only above 0.7.

    Two empty strings give `both_empty`; one gives 0.
    """
    n, m = len(a), len(b)
    if not n or not m:
        return both_empty if n == m else 0.0
    reach = max(0, max(n, m) // 2 - 1)
    free = [True] * m
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(m, i + reach + 1)):
            if free[j] and b[j] == c:
                free[j] = False
                left.append(c)
                break
    k = len(left)
    if not k:
        return 0.0
    right = [c for c, f in zip(b, free) if not f]
    swaps = sum(x != y for x, y in zip(left, right)) // 2
    score = (k / n + k / m + (k - swaps) / k) / 3
    if score > 0.7:
        same = 0
        for x, y in zip(a[:4], b[:4]):
            if x != y:
                break
            same += 1
        score += same * 0.1 * (1 - score)
    return score


class Names:
    """Names of at most 64 characters, to be compared with others all at once.

    For each character the places where a name has it are the bits of a number, so
    the search for matches runs over all names at a time. Scores are those of jaro_winkler.
    """

    MAX = 64

    def __init__(self, names: list[str]):
        self.lengths = np.array([len(x) for x in names], np.int64)
        self.sizes, self.size_of = np.unique(self.lengths, return_inverse=True)
        self.places: dict[str, np.ndarray] = {}
        for i, name in enumerate(names):
            for p, c in enumerate(name):
                if c not in self.places:
                    self.places[c] = np.zeros(len(names), np.uint64)
                self.places[c][i] |= np.uint64(1 << p)

    def scores(self, name: str, above: float) -> np.ndarray:
        """Similarity of a name, not empty, with each of these; 0 for those that don't exceed `above`, which isn't negative."""
        n, m = len(name), self.lengths
        none = np.zeros(len(m), np.uint64)
        at = [self.places.get(c, none) for c in name]
        one, used, hits = np.uint64(1), none.copy(), []
        for i in range(n):
            windows = []
            for size in self.sizes.tolist():
                reach = max(0, max(n, size) // 2 - 1)
                windows.append((1 << min(size, i + reach + 1)) - (1 << max(0, i - reach)) if i - reach < size else 0)
            window = np.array(windows, np.uint64)[self.size_of if len(windows) > 1 else 0]
            free = at[i] & ~used & window
            hit = free & (~free + one)
            used |= hit
            hits.append(hit)
        k = np.bitwise_count(used).astype(np.int64)
        prefix, same = np.zeros(len(m)), np.ones(len(m), bool)
        for p in range(min(4, n)):
            same &= (at[p] >> np.uint64(p)) & one != 0
            prefix += same
        with np.errstate(divide="ignore", invalid="ignore"):
            most = (k / n + k / m + 1) / 3
            most = np.where(most > 0.7, most + prefix * 0.1 * (1 - most), most)
            left = np.flatnonzero((k > 0) & (most + 1e-9 > above))
        rest, wrong = used[left], np.zeros(len(left), np.int64)
        for i in range(n):
            matched = hits[i][left] != 0
            low = np.where(matched, rest & (~rest + one), np.uint64(0))
            wrong += matched & (at[i][left] & low == 0)
            rest ^= low
        k, m = k[left], m[left]
        score = (k / n + k / m + (k - wrong // 2) / k) / 3
        score = np.where(score > 0.7, score + prefix[left] * 0.1 * (1 - score), score)
        out = np.zeros(len(self.lengths))
        out[left] = np.where(score > above, score, 0.0)
        return out


@F.pandas_udf(T.DoubleType())
def jaro_winkler_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_winkler(x, y) for x, y in zip(a, b)], dtype="float64")


def type_set_score(a: frozenset[str], b: frozenset[str]) -> float:
    """Best score of any pair of types; a closed form of the pairwise maximum."""
    if not a or not b:
        return 1.0 if not a and not b else 0.0
    if a & b:
        return 1.0
    if ("MAP" in a and b & {"OBJECT", "ANY"}) or ("MAP" in b and a & {"OBJECT", "ANY"}):
        return 0.4
    both = a | b
    if both & {"UNKNOWN", "ANY"}:
        return 0.3
    return 0.2 if "OBJECT" in both else 0.0


Param = tuple[str, frozenset[str], bool]


@lru_cache(maxsize=1 << 15)
def param_score(a: Param, b: Param) -> float:
    return 0.5 * jaro_winkler(a[0], b[0]) + 0.4 * type_set_score(a[1], b[1]) + 0.1 * (1.0 if a[2] == b[2] else 0.0)


@lru_cache(maxsize=1 << 13)
def params_score(a: tuple[Param, ...], b: tuple[Param, ...]) -> float:
    """Dice-like score of the best assignment of parameters to one another."""
    if not a or not b:
        return 1.0 if not a and not b else 0.0
    matrix = np.array([[param_score(x, y) for y in b] for x in a])
    rows, cols = best_assignment(matrix)
    return 2.0 * float(matrix[rows, cols].sum()) / (len(a) + len(b))


@lru_cache(maxsize=1 << 13)
def return_score(a: frozenset[str], async_a: bool, b: frozenset[str], async_b: bool) -> float:
    return type_set_score(a, b) * 0.7 + (1.0 if async_a == async_b else 0.0) * 0.3


def kind_class(kind: str) -> str:
    """C, F or M for kinds that can be compared with each other; else the kind itself."""
    return {"CONSTRUCTOR": "C", "FUNCTION": "F", "CLASS_METHOD": "F", "INSTANCE_METHOD": "M"}.get(kind, kind)


@dataclass(frozen=True)
class Side:
    """What the score needs of one feature."""

    kind: str
    name: str
    member_of: str
    namespace: str
    params: tuple[Param, ...] = ()
    returns: frozenset[str] = frozenset()
    is_async: bool = False

    @classmethod
    def of(cls, row) -> Side:
        """From a mapping or Row with feature columns."""
        params = tuple((p["normalized_name"], frozenset(t.upper() for t in p["normalized_types"]), bool(p["is_optional"])) for p in row["parameters"])
        return cls(row["type"], row["normalized_name"], row["normalized_member_of"], row["normalized_namespace"], params, frozenset(t.upper() for t in row["normalized_return_types"]), bool(row["async"]))


def _codes(values: list) -> tuple[list, np.ndarray]:
    known: dict = {}
    codes = np.array([known.setdefault(v, len(known)) for v in values], np.int64)
    return list(known), codes


def _table(a: list, b: list, score) -> np.ndarray:
    """score of each pair of values, computed for distinct ones only."""
    x, i = _codes(a)
    y, j = _codes(b)
    grid = np.array([[score(p, q) for q in y] for p in x]).reshape(len(x), len(y))
    return grid[i][:, j]


def name_scores(base: list[Side], target: list[Side], kind: str, weights: Weights = Weights(), both_empty: float = 0.0) -> np.ndarray:
    """Weighted sums of the similarities of names, classes and namespaces, for pairs of one class of kinds."""
    w_name, w_member, w_space = weights.for_class(kind)
    jw = lambda x, y: jaro_winkler(x, y, both_empty)
    score = _table([f.name for f in base], [f.name for f in target], jw) * w_name
    score += _table([f.member_of for f in base], [f.member_of for f in target], jw) * w_member
    score += _table([f.namespace for f in base], [f.namespace for f in target], jw) * w_space
    return score


def class_scores(base: list[Side], target: list[Side], kind: str, weights: Weights = Weights(), both_empty: float = 0.0) -> np.ndarray:
    """Scores of all pairs of features of one class of kinds: C, F or M.

    Where the weighted names, classes and namespaces stay below 0.8 of their
    weights, that sum is the score; only the other pairs have parameters and
    return types compared.
    """
    score = name_scores(base, target, kind, weights, both_empty)
    i, j = np.nonzero(score >= EARLY_EXIT * sum(weights.for_class(kind)))
    if not len(i):
        return score
    pa, pi = _codes([f.params for f in base])
    pb, pj = _codes([f.params for f in target])
    ra, ri = _codes([(f.returns, f.is_async) for f in base])
    rb, rj = _codes([(f.returns, f.is_async) for f in target])
    pair, at = np.unique(pi[i] * len(pb) + pj[j], return_inverse=True)
    params = np.array([params_score(pa[p // len(pb)], pb[p % len(pb)]) for p in pair])[at]
    pair, at = np.unique(ri[i] * len(rb) + rj[j], return_inverse=True)
    returns = np.array([return_score(*ra[p // len(rb)], *rb[p % len(rb)]) for p in pair])[at]
    score[i, j] += params * weights.parameters + returns * weights.return_type
    return score


def feature_score(base: Side, target: Side, weights: Weights = Weights(), both_empty: float = 0.0) -> float:
    """Score of one pair of features; 0 for kinds of different classes."""
    kind = kind_class(base.kind)
    if kind != kind_class(target.kind) or kind not in ("C", "F", "M"):
        return 0.0
    return float(class_scores([base], [target], kind, weights, both_empty)[0, 0])
