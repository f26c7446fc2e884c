"""Gradient-boosted trees for a bounded training sample, with monotonic features, scored from flat node arrays.

Training is histogram-based with logistic loss. A feature constrained to +1 never lowers the score
as it grows, one constrained to -1 never raises it: a split on it is taken only if the two values
are in order, and what lies below keeps to its side of their midpoint.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """All trees' nodes one after another; a leaf points to itself."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def margin(self, rows: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(rows), len(self.roots)))
        line = np.arange(len(rows))[:, None]
        for _ in range(self.depth):
            at = np.where(rows[line, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.base + self.value[at].sum(axis=1)

    def probability(self, rows: np.ndarray) -> np.ndarray:
        return sigmoid(self.margin(rows))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def constant(probability: float) -> Forest:
    """For samples with nothing to learn from: the same score for every row."""
    p = min(max(probability, 1e-3), 1 - 1e-3)
    none = np.zeros(0, dtype=np.int64)
    return Forest(none, none, np.zeros(0), none, none, np.zeros(0), float(np.log(p / (1 - p))), 0)


def fit(rows: np.ndarray, label: np.ndarray, monotone: list[int], trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 2.0, least: float = 2.0) -> Forest:
    """monotone: -1, 0 or 1 for each feature; least: sum of second derivatives that a child needs."""
    if len(label) < 8 or label.min() == label.max():
        return constant(float(label.mean()) if len(label) else 0.5)
    p = float(label.mean())
    n, width = rows.shape
    edges = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(e, rows[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    sign = np.asarray(monotone)
    margin = np.full(n, np.log(p / (1 - p)))
    nodes: list[tuple[int, float, int, int, float]] = []
    roots = []
    for _ in range(trees):
        q = sigmoid(margin)
        gradient, hessian = q - label, q * (1 - q)
        roots.append(len(nodes))
        nodes.append((0, np.inf, len(nodes), len(nodes), 0.0))
        open_nodes = [(roots[-1], np.arange(n), -np.inf, np.inf)]
        for level in range(depth + 1):
            grown = []
            for at, own, low, high in open_nodes:
                g, h = gradient[own], hessian[own]
                value = float(np.clip(-g.sum() / (h.sum() + l2), low, high))
                nodes[at] = (0, np.inf, at, at, rate * value)
                best = _split(binned[own], g, h, edges, sign, low, high, l2, least, bins) if level < depth else None
                if best is None:
                    margin[own] += rate * value
                    continue
                f, b, to_left, to_right = best
                left, right = len(nodes), len(nodes) + 1
                nodes += [(0, np.inf, left, left, 0.0), (0, np.inf, right, right, 0.0)]
                nodes[at] = (f, float(edges[f][b]), left, right, 0.0)
                middle, goes = (to_left + to_right) / 2, binned[own, f] <= b
                bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[int(sign[f])]
                grown += [(left, own[goes], *bounds[0]), (right, own[~goes], *bounds[1])]
            open_nodes = grown
    feature, threshold, left, right, value = (np.asarray(x) for x in zip(*nodes, strict=True))
    return Forest(np.asarray(roots), feature, threshold, left, right, value, float(np.log(p / (1 - p))), depth)


def _split(binned, g, h, edges, sign, low, high, l2, least, bins):
    """The best (feature, bin, left value, right value), or None if no split gains."""
    total_g, total_h = g.sum(), h.sum()

    def loss(gs, hs, v):
        return gs * v + 0.5 * (hs + l2) * v * v

    own = np.clip(-total_g / (total_h + l2), low, high)
    best, gain = None, 1e-6
    for f, edge in enumerate(edges):
        if not len(edge):
            continue
        left_g = np.cumsum(np.bincount(binned[:, f], weights=g, minlength=bins))[: len(edge)]
        left_h = np.cumsum(np.bincount(binned[:, f], weights=h, minlength=bins))[: len(edge)]
        right_g, right_h = total_g - left_g, total_h - left_h
        a, b = (np.clip(-gs / (hs + l2), low, high) for gs, hs in ((left_g, left_h), (right_g, right_h)))
        gains = loss(total_g, total_h, own) - loss(left_g, left_h, a) - loss(right_g, right_h, b)
        gains[(left_h < least) | (right_h < least) | ((b - a) * sign[f] < 0)] = -np.inf
        k = int(np.argmax(gains))
        if gains[k] > gain:
            best, gain = (f, k, float(a[k]), float(b[k])), gains[k]
    return best


def isotonic(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing steps that fit the labels best (pool adjacent violators), as points to interpolate.

    Each block is pulled a little towards 1/2, so that no score is a certainty.
    """
    if not len(score):
        return np.asarray([0.0, 1.0]), np.asarray([0.0, 1.0])
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum of labels, rows, lowest and highest score
    for s, y in zip(score[order], label[order], strict=True):
        blocks.append([float(y), 1.0, float(s), float(s)])
        while len(blocks) > 1 and (blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1] or blocks[-2][3] == blocks[-1][2]):
            y1, n1, _, top = blocks.pop()
            blocks[-1] = [blocks[-1][0] + y1, blocks[-1][1] + n1, blocks[-1][2], top]
    x = [v for b in blocks for v in (b[2], b[3])]
    y = [v for b in blocks for v in [(b[0] + 0.5) / (b[1] + 1)] * 2]
    return np.asarray(x), np.maximum.accumulate(np.asarray(y))
