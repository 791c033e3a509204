"""Gradient-boosted trees on binned features with monotonic constraints, kept as
flat node arrays and scored level by level for all rows at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """``feature, cut, left, right, value`` of all nodes; a leaf is its own child.
    ``roots`` are the trees' first nodes."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        at = np.repeat(self.roots[None, :], len(x), axis=0)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            low = x[rows, self.feature[at]] <= self.cut[at]
            at = np.where(low, self.left[at], self.right[at])
        return self.value[at].sum(axis=1) + self.bias

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def _best_split(g, h, codes, edges, signs, low, high, least, reg):
    """``(gain, feature, bin, left value, right value)`` of the best allowed split."""
    best = (1e-6, None, None, 0.0, 0.0)
    total_g, total_h = g.sum(), h.sum()
    whole = total_g ** 2 / (total_h + reg)
    for f in range(codes.shape[1]):
        n_bins = len(edges[f])
        if not n_bins:
            continue
        sums = [np.cumsum(np.bincount(codes[:, f], w, n_bins + 1))[:-1]
                for w in (g, h, np.ones(len(g)))]
        gl, hl, nl = sums
        gr, hr = total_g - gl, total_h - hl
        vl, vr = (np.clip(-a / (b + reg), low, high) for a, b in ((gl, hl), (gr, hr)))
        # gain of the clipped values: what they take off the second-order loss
        gain = -(2 * (gl * vl + gr * vr) + (hl + reg) * vl ** 2 + (hr + reg) * vr ** 2) - whole
        ok = (nl >= least) & (len(g) - nl >= least)
        if signs[f]:
            ok &= signs[f] * (vr - vl) >= 0
        gain = np.where(ok, gain, -np.inf)
        i = int(gain.argmax())
        if gain[i] > best[0]:
            best = (gain[i], f, i, vl[i], vr[i])
    return best


def fit_trees(x: np.ndarray, y: np.ndarray, signs: np.ndarray, n_trees: int = 80, depth: int = 3,
              rate: float = 0.15, bins: int = 48, least: int = 20, reg: float = 1.0) -> Trees:
    """Logistic boosting.  ``signs[f]`` is +1 or -1 where the score may only rise or
    fall with feature ``f``, else 0: a split against the sign is refused, and its
    children's values are bounded by the mean of the two sides."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    codes = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
    share = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    bias = float(np.log(share / (1 - share)))
    margin = np.full(len(y), bias)
    nodes: list[list] = []
    roots = []

    def grow(rows, g, h, low, high, level):
        me = len(nodes)
        value = float(np.clip(-g[rows].sum() / (h[rows].sum() + reg), low, high))
        nodes.append([0, np.inf, me, me, rate * value])
        if level < depth:
            gain, f, i, vl, vr = _best_split(g[rows], h[rows], codes[rows], edges, signs, low,
                                             high, least, reg)
            if f is not None:
                side = codes[rows, f] <= i
                mid = (vl + vr) / 2
                bounds = {1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid)),
                          0: ((low, high),) * 2}[int(signs[f])]
                nodes[me][:2] = [f, edges[f][i]]
                nodes[me][2] = grow(rows[side], g, h, *bounds[0], level + 1)
                nodes[me][3] = grow(rows[~side], g, h, *bounds[1], level + 1)
                return me
        margin[rows] += nodes[me][4]
        return me

    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-margin))
        roots.append(grow(np.arange(len(y)), p - y, np.maximum(p * (1 - p), 1e-6), -np.inf,
                          np.inf, 0))
    cols = list(zip(*nodes))
    return Trees(np.array(cols[0], np.int64), np.array(cols[1], np.float64),
                 np.array(cols[2], np.int64), np.array(cols[3], np.int64),
                 np.array(cols[4], np.float64), np.array(roots, np.int64), depth, bias)
