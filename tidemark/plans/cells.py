"""Boosted regression trees over cells: rows that share all binned inputs.

With squared loss, rows that no split can tell apart matter only through their number and the sum of
their targets. So a series is first counted per combination of bins, by one aggregation with map-side
combining, and its trees are grown on those cells; however long the series, it has at most as many
cells as its inputs have combinations.
"""

from __future__ import annotations

import numpy as np


def best_splits(x: np.ndarray, n: np.ndarray, r: np.ndarray, node: np.ndarray, nodes: int, min_leaf: int):
    """Per node: input, last bin on the left, and gain of the best split (0: none).

    Gains are compared to six decimals; the first input and the lowest bin win ties.
    """
    all_n, all_r = np.bincount(node, n, nodes), np.bincount(node, r, nodes)
    gain, feature, cut = np.zeros(nodes), np.zeros(nodes, int), np.zeros(nodes, int)
    for j in range(x.shape[1]):
        width = int(x[:, j].max()) + 1
        at = node * width + x[:, j]
        left_n, left_r = (np.bincount(at, v, nodes * width).reshape(nodes, width).cumsum(1) for v in (n, r))
        right_n, right_r = all_n[:, None] - left_n, all_r[:, None] - left_r
        fits = (left_n >= min_leaf) & (right_n >= min_leaf)
        with np.errstate(divide="ignore", invalid="ignore"):
            won = left_r**2 / left_n + right_r**2 / right_n - (all_r**2 / all_n)[:, None]
        won = np.where(fits, np.round(won, 6), 0.0)
        b = won.argmax(1)
        here = won[np.arange(nodes), b]
        better = here > gain
        gain[better], feature[better], cut[better] = here[better], j, b[better]
    return feature, cut, gain


def boost_cells(
    x: np.ndarray, n: np.ndarray, total: np.ndarray, trees: int, rate: float, depth: int, min_leaf: int
) -> np.ndarray:
    """Estimate of every cell from its bins ``x``; cells with ``n`` = 0 are estimated, not learned from."""
    n = n.astype(float)
    f = np.full(len(n), total.sum() / n.sum())
    for _ in range(trees):
        r = total - n * f
        node, nodes, grew = np.zeros(len(n), int), 1, False
        for _ in range(depth):
            feature, cut, gain = best_splits(x, n, r, node, nodes, min_leaf)
            split = gain > 0
            if not split.any():
                break
            grew = True
            right = split[node] & (x[np.arange(len(x)), feature[node]] > cut[node])
            # Only nodes that hold cells keep a number.
            used, node = np.unique(2 * node + right, return_inverse=True)
            nodes = len(used)
        if not grew:
            break
        f = f + rate * (np.bincount(node, r, nodes) / np.bincount(node, n, nodes))[node]
    return f
