"""Second-order boosted trees on one app's rows: the numbers inside a grouped task.

A feature is a sorted list of cuts and, for the rows above its lowest cut, their place among them; rows at or below it are
not listed, so a rule feature costs what its occurrences cost. Gradient and hessian of the asymmetric squared loss are
``w * (f - y)`` and ``w``, where ``w`` is the row's weight, times ``asymmetric_alpha`` if ``f`` is too low. Splits and
leaves take the L1 and L2 penalties, ``min_child_weight`` bounds the hessian of a side, ``gamma`` the gain.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tidemark.operators.boosting import BoostParams

MAX_CUTS = 31


@dataclass
class Columns:
    """Entries of all features, one feature after another: ``rows`` and, counted from 0, the ``slots`` (cuts) below them."""

    n_rows: int
    rows: np.ndarray
    slots: np.ndarray
    starts: np.ndarray
    cuts: np.ndarray
    first_cut: np.ndarray

    @classmethod
    def of(cls, dense: np.ndarray, sparse: list[tuple[np.ndarray, np.ndarray]]) -> Columns:
        """``dense`` holds a column per feature; each of ``sparse`` its (rows, values), zero elsewhere."""
        n, rows, slots, cuts = len(dense), [], [], []
        everywhere = np.arange(n)
        features = [(everywhere, column, False) for column in dense.T] + [(r, v, True) for r, v in sparse]
        first_cut = [0]
        for own, values, with_zero in features:
            levels = np.unique(np.append(values, 0.0) if with_zero else values)
            if len(levels) > MAX_CUTS + 1:
                levels = np.unique(np.quantile(values, np.linspace(0, 1, MAX_CUTS + 1), method="nearest"))
            between = levels[:-1] / 2 + levels[1:] / 2
            above = np.searchsorted(between, values)
            rows.append(own[above > 0])
            slots.append(first_cut[-1] + above[above > 0] - 1)
            cuts.append(between)
            first_cut.append(first_cut[-1] + len(between))
        return cls(n, np.concatenate(rows), np.concatenate(slots), np.cumsum([0, *map(len, rows)]),
                   np.concatenate(cuts), np.array(first_cut))


@dataclass
class Trees:
    """Complete trees of one depth: per inner node a feature (-1: everything goes left) and its cut, per leaf a value."""

    depth: int
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    base: float

    def predict(self, values: np.ndarray) -> np.ndarray:
        """``values`` has a row per sample and a column per feature."""
        at = np.zeros((len(values), len(self.leaf)), np.int64)
        trees, samples = np.arange(len(self.leaf))[None, :], np.arange(len(values))[:, None]
        for level in range(self.depth):
            node = (1 << level) - 1 + at
            feature = self.feature[trees, node]
            at = 2 * at + ((feature >= 0) & (values[samples, feature] > self.cut[trees, node]))
        return self.base + self.leaf[trees, at].sum(axis=1)


def _penalised(g: np.ndarray, h: np.ndarray, p: BoostParams) -> tuple[np.ndarray, np.ndarray]:
    """(gradient less L1, hessian plus L2); the second is never zero."""
    return np.sign(g) * np.maximum(np.abs(g) - p.reg_alpha, 0.0), np.maximum(h + p.reg_lambda, 1e-12)


def _score(g: np.ndarray, h: np.ndarray, p: BoostParams) -> np.ndarray:
    top, bottom = _penalised(g, h, p)
    return top * top / bottom


def _grow(x: Columns, g: np.ndarray, h: np.ndarray, usable: np.ndarray, p: BoostParams):
    n_slots, node = len(x.cuts), np.zeros(x.n_rows, np.int64)
    owner = np.repeat(np.arange(len(x.first_cut) - 1), np.diff(x.first_cut))
    last = x.first_cut[owner + 1]
    entry_g, entry_h = g[x.rows], h[x.rows]
    features, cuts = np.full((1 << p.max_depth) - 1, -1), np.zeros((1 << p.max_depth) - 1)
    for level in range(p.max_depth):
        width = 1 << level
        whole_g, whole_h = (np.bincount(node, v, width)[:, None] for v in (g, h))
        place = node[x.rows] * n_slots + x.slots
        sums = []
        for v in (entry_g, entry_h):
            at = np.bincount(place, v, width * n_slots).reshape(width, n_slots)
            # of every cut, the sum over its own and the higher places of its feature
            upward = np.append(np.cumsum(at[:, ::-1], axis=1)[:, ::-1], np.zeros((width, 1)), axis=1)
            sums.append(upward[:, :-1] - upward[:, last])
        right_g, right_h = sums
        gain = _score(right_g, right_h, p) + _score(whole_g - right_g, whole_h - right_h, p) - _score(whole_g, whole_h, p)
        least = max(p.min_child_weight, 1e-9)
        allowed = usable[owner] & (right_h >= least) & (whole_h - right_h >= least)
        gain = np.where(allowed, gain, -np.inf)
        best = gain.argmax(axis=1)
        split = np.flatnonzero(gain[np.arange(width), best] > 2 * p.gamma + 1e-12)
        if not len(split):
            node <<= p.max_depth - level
            break
        goes_right = np.zeros(x.n_rows, bool)
        for k in split.tolist():
            slot, feature = best[k], owner[best[k]]
            features[width - 1 + k], cuts[width - 1 + k] = feature, x.cuts[slot]
            own = slice(x.starts[feature], x.starts[feature + 1])
            higher = x.rows[own][x.slots[own] >= slot]
            goes_right[higher[node[higher] == k]] = True
        node = 2 * node + goes_right
    return features, cuts, node


def fit_trees(x: Columns, y: np.ndarray, weight: np.ndarray, p: BoostParams, asymmetric: bool = True) -> tuple[Trees, np.ndarray]:
    """(trees, fitted values)."""
    rng = np.random.default_rng(p.seed)
    n_features, n_leaves = len(x.first_cut) - 1, 1 << p.max_depth
    base = float(y.mean())
    fitted = np.full(len(y), base)
    grown = []
    for _ in range(p.n_estimators):
        h = weight * np.where(fitted < y, p.asymmetric_alpha, 1.0) if asymmetric else weight.copy()
        g = h * (fitted - y)
        if p.subsample < 1.0:
            drawn = rng.random(len(y)) < p.subsample
            g, h = g * drawn, h * drawn
        usable = np.ones(n_features, bool)
        if p.colsample_bytree < 1.0:
            usable[:] = False
            usable[rng.choice(n_features, max(1, round(p.colsample_bytree * n_features)), replace=False)] = True
        features, cuts, node = _grow(x, g, h, usable, p)
        top, bottom = _penalised(np.bincount(node, g, n_leaves), np.bincount(node, h, n_leaves), p)
        leaf = -p.learning_rate * top / bottom
        grown.append((features, cuts, leaf))
        fitted += leaf[node]
    feature, cut, leaf = (np.array(v) for v in zip(*grown, strict=True))
    return Trees(p.max_depth, feature, cut, leaf, base), fitted
