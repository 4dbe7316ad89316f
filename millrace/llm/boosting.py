"""Gradient-boosted trees on numeric features, with monotonic constraints, as flat numpy arrays."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Trees(NamedTuple):
    """Perfect binary trees of one depth: node k of a level has children 2k and 2k + 1 of the next.

    ``feature`` and ``threshold`` are (trees, 2^depth - 1), ``leaf`` is (trees, 2^depth).
    """

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        row = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while inner and node[:1].size and node[0] < inner:
                node = 2 * node + 1 + (x[row, feature[node]] > threshold[node])
            total += leaf[node - inner]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(
    x: np.ndarray,
    y: np.ndarray,
    direction: np.ndarray,
    rounds: int = 80,
    depth: int = 4,
    rate: float = 0.15,
    bins: int = 64,
    l2: float = 1.0,
    least_weight: float = 4.0,
) -> Trees:
    """Logistic boosting of ``y`` (0 or 1).  ``direction``: per feature 1 or -1 where the score may only
    rise or fall with it, 0 where it is free.

    Each level is split at once from histograms of gradients.  A split against the direction is not
    taken, and both sides of a constrained one keep bounds at the middle of their values, so that no
    later split breaks it.
    """
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    code = np.column_stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)])
    rate_of_one = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(rate_of_one / (1 - rate_of_one)))
    margin = np.full(n, base)
    inner, leaves = 2**depth - 1, 2**depth
    feature, threshold, leaf = np.zeros((rounds, inner), np.int64), np.full((rounds, inner), np.inf), np.zeros((rounds, leaves))
    for t in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        low, high = np.array([-np.inf]), np.array([np.inf])
        for level in range(depth):
            width_l = 2**level
            best = np.full(width_l, 1e-6)
            pick = np.full((width_l, 2), -1)
            for f in range(width):
                size = len(cuts[f]) + 1
                if size < 2:
                    continue
                at = node * size + code[:, f]
                gs = np.bincount(at, g, width_l * size).reshape(width_l, size).cumsum(1)
                hs = np.bincount(at, h, width_l * size).reshape(width_l, size).cumsum(1)
                gl, hl, gt, ht = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                value_l = np.clip(-gl / (hl + l2), low[:, None], high[:, None])
                value_r = np.clip(-(gt - gl) / (ht - hl + l2), low[:, None], high[:, None])

                def loss(v: np.ndarray, g_: np.ndarray, h_: np.ndarray) -> np.ndarray:
                    return g_ * v + 0.5 * (h_ + l2) * v * v

                whole = np.clip(-gt / (ht + l2), low[:, None], high[:, None])
                gain = loss(whole, gt, ht) - loss(value_l, gl, hl) - loss(value_r, gt - gl, ht - hl)
                bad = (hl < least_weight) | (ht - hl < least_weight) | (direction[f] * (value_r - value_l) < 0)
                gain = np.where(bad, 0, gain)
                k = gain.argmax(1)
                top = gain[np.arange(width_l), k]
                better = top > best
                best[better] = top[better]
                pick[better, 0], pick[better, 1] = f, k[better]
            first = width_l - 1
            new_low, new_high = np.repeat(low, 2), np.repeat(high, 2)
            for k in np.flatnonzero(pick[:, 0] >= 0):
                f = int(pick[k, 0])
                feature[t, first + k], threshold[t, first + k] = f, cuts[f][pick[k, 1]]
                if direction[f]:
                    mine = node == k
                    left = mine & (code[:, f] <= pick[k, 1])
                    right = mine & ~left
                    both = [np.clip(-g[m].sum() / (h[m].sum() + l2), low[k], high[k]) for m in (left, right)]
                    middle = float(np.mean(both))
                    up = direction[f] > 0
                    new_high[2 * k if up else 2 * k + 1] = middle
                    new_low[2 * k + 1 if up else 2 * k] = middle
            low, high = new_low, new_high
            f_of, k_of = feature[t, first + node], threshold[t, first + node]
            node = 2 * node + (x[np.arange(n), f_of] > k_of)
        gs, hs = np.bincount(node, g, leaves), np.bincount(node, h, leaves)
        leaf[t] = rate * np.clip(-gs / (hs + l2), low, high)
        margin += leaf[t][node]
    return Trees(feature, threshold, leaf, base)
