"""Gradient-boosted regression trees for a 0/1 label over few dense features, and isotonic calibration, in numpy."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Trees(NamedTuple):
    feature: np.ndarray  # (trees, nodes): -1 at a leaf; node i has children 2i+1 and 2i+2
    bound: np.ndarray  # (trees, nodes): values up to it go left
    value: np.ndarray  # (trees, nodes)
    start: float


def fit_trees(x: np.ndarray, y: np.ndarray, *, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, shrink: float = 2.0, least: int = 8) -> Trees:
    """Trees of the logistic loss, split by second-order gain over quantile bins of each feature."""
    n, width = x.shape
    nodes = 2 ** (depth + 1) - 1
    feature, bound, value = np.full((trees, nodes), -1), np.zeros((trees, nodes)), np.zeros((trees, nodes))
    share = np.clip((y.sum() + 0.5) / (n + 1), 1e-6, 1 - 1e-6)
    start = float(np.log(share / (1 - share)))
    if n < 2 * least:
        return Trees(feature, bound, value, start)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(width)]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(width)])
    score = np.full(n, start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        at = {0: np.arange(n)}
        for node in range(nodes):
            if node not in at:
                continue
            rows = at.pop(node)
            value[t, node] = -rate * g[rows].sum() / (h[rows].sum() + shrink)
            best, total_g, total_h = (1e-6, -1, 0), g[rows].sum(), h[rows].sum()
            if 2 * node + 2 < nodes and len(rows) >= 2 * least:
                for f in range(width):
                    own = binned[f, rows]
                    size = len(edges[f]) + 1
                    left_n = np.bincount(own, minlength=size).cumsum()[:-1]
                    left_g, left_h = np.bincount(own, g[rows], size).cumsum()[:-1], np.bincount(own, h[rows], size).cumsum()[:-1]
                    gain = left_g**2 / (left_h + shrink) + (total_g - left_g) ** 2 / (total_h - left_h + shrink) - total_g**2 / (total_h + shrink)
                    gain[(left_n < least) | (len(rows) - left_n < least)] = 0
                    if len(gain) and gain.max() > best[0]:
                        best = (float(gain.max()), f, int(gain.argmax()))
            if best[1] < 0:
                score[rows] += value[t, node]
                continue
            _, f, cut = best
            feature[t, node], bound[t, node] = f, edges[f][cut]
            left = binned[f, rows] <= cut
            at[2 * node + 1], at[2 * node + 2] = rows[left], rows[~left]
    return Trees(feature, bound, value, start)


def margins(model: Trees, x: np.ndarray) -> np.ndarray:
    """The sum of the trees for each row."""
    out = np.full(len(x), model.start)
    row = np.arange(len(x))
    for feature, bound, value in zip(model.feature, model.bound, model.value, strict=True):
        node = np.zeros(len(x), np.int64)
        while (inner := feature[node] >= 0).any():
            f = np.maximum(feature[node], 0)
            node = np.where(inner, 2 * node + 1 + (x[row, f] > bound[node]), node)
        out += value[node]
    return out


def fit_isotonic(margin: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, levels) of the rising step function nearest to the labels, by pooling neighbours that go down."""
    if not len(margin):
        return np.zeros(1), np.full(1, 0.5)
    places, inverse = np.unique(margin, return_inverse=True)
    weight, total = np.bincount(inverse, weights), np.bincount(inverse, weights * y)
    blocks: list[list[float]] = []
    for i in range(len(places)):
        blocks.append([total[i], weight[i], i, i])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, w, _, last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + w, blocks[-1][2], last]
    xs, ys = [], []
    for s, w, first, last in blocks:
        xs += [places[int(first)], places[int(last)]]
        ys += [s / w, s / w]
    return np.array(xs), np.array(ys)


def calibrated(margin: np.ndarray, curve: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Levels at the margins, on straight lines between the steps."""
    return np.clip(np.interp(margin, *curve), 0.0, 1.0)
