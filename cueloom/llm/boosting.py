"""Gradient-boosted regression trees for a yes/no target, in numpy, with isotonic calibration."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    base: float = 0.0
    #: Each tree: feature, threshold and value of its nodes in heap order; a leaf has feature -1.
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    #: Isotonic steps: raw scores and the calibrated probability from each on.
    steps: tuple[np.ndarray, np.ndarray] = (np.zeros(1), np.full(1, 0.5))

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(len(feature).bit_length() - 1):
                f = feature[node]
                right = x[rows, np.maximum(f, 0)] > threshold[node]
                node = np.where(f < 0, node, 2 * node + 1 + right)
            out += value[node]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        at, p = self.steps
        return p[np.clip(np.searchsorted(at, self.raw(x), side="right") - 1, 0, len(p) - 1)]


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the best non-decreasing fit of y by score."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # start, sum, count
    for s, v in zip(score[order], y[order]):
        blocks.append([s, float(v), 1.0])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1][1] += last[1]
            blocks[-1][2] += last[2]
    return np.array([b[0] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, ridge: float = 1.0) -> Boosted:
    """Second-order boosting of the logistic loss over all split points that the data hold. Feature values are coded once; a node's sums for all split points of all features are one count."""
    model = Boosted(float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))))
    cuts = [np.unique(x[:, j])[:-1] for j in range(x.shape[1])]
    sizes = np.array([len(c) + 1 for c in cuts])
    offset = np.cumsum(sizes) - sizes
    code = np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(cuts)], axis=1) + offset
    feature_of, cut_of = np.repeat(np.arange(len(cuts)), sizes), np.concatenate([np.append(c, np.inf) for c in cuts])
    splits = np.isfinite(cut_of)
    score = np.full(len(y), model.base)
    size = 2 ** (depth + 1) - 1
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        feature, threshold, value = np.full(size, -1), np.zeros(size), np.zeros(size)
        node = np.zeros(len(y), np.int64)
        for k in range(size):
            own = np.flatnonzero(node == k)
            if not len(own):
                continue
            gs, hs = g[own].sum(), h[own].sum()
            value[k] = rate * gs / (hs + ridge)
            if 2 * k + 2 >= size or not splits.any():
                continue
            flat = code[own].ravel()
            gl, hl = (_within(np.bincount(flat, np.repeat(w[own], len(cuts)), len(cut_of)), offset, sizes) for w in (g, h))
            gain = np.where(splits, gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge), -np.inf)
            best = int(np.argmax(gain))
            if gain[best] > 1e-6:
                feature[k], threshold[k] = feature_of[best], cut_of[best]
                node[own] = 2 * k + 1 + (x[own, feature[k]] > threshold[k])
        model.trees.append((feature, threshold, value))
        score += value[node]
    return model


def _within(sums: np.ndarray, offset: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Running sums that begin anew at each feature."""
    total = np.cumsum(sums)
    return total - np.repeat(np.r_[0.0, total][offset], sizes)


@dataclass
class Judge:
    """Trees for all groups; a calibration and a threshold for each group."""

    model: Boosted
    steps: list[tuple[np.ndarray, np.ndarray]]
    thresholds: np.ndarray

    def probability(self, x: np.ndarray, group: np.ndarray) -> np.ndarray:
        raw, out = self.model.raw(x), np.zeros(len(x))
        for k in np.unique(group):
            at, p = self.steps[k]
            own = group == k
            out[own] = p[np.clip(np.searchsorted(at, raw[own], side="right") - 1, 0, len(p) - 1)]
        return out

    def accepts(self, x: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The calibrated probability of each row, and whether it reaches its group's threshold."""
        p = self.probability(x, group)
        return p, p >= self.thresholds[group]


def fit_judge(x: np.ndarray, y: np.ndarray, group: np.ndarray, groups: int, precision: float, seed: int = 7, **kw) -> Judge:
    """Half of the rows train the trees; a quarter calibrates each group by itself; on the last quarter each group gets the lowest threshold from 0.5 up whose accepted rows are right in at least ``precision`` of cases, or the one of the best F1 where none is."""
    order = np.random.default_rng(seed).permutation(len(y))
    train, held, last = np.split(order, [len(y) // 2, 3 * len(y) // 4])
    model = fit(x[train], y[train], **kw)
    raw = model.raw(x)
    steps, thresholds = [], np.full(groups, 2.0)  # a group without examples accepts nothing
    for k in range(groups):
        own = held[group[held] == k]
        steps.append(isotonic(raw[own], y[own]) if len(own) else (np.zeros(1), np.zeros(1)))
    judge = Judge(model, steps, thresholds)
    p = judge.probability(x[last], group[last])
    for k in range(groups):
        own = group[last] == k
        tried = []
        for t in np.unique(p[own]):
            hit = own & (p >= t)
            right = y[last][hit].sum()
            tried.append((right / hit.sum(), 2 * right / (hit.sum() + max(1, y[last][own].sum())), t))
        enough = [t for found, _, t in tried if t >= 0.5 and found >= precision]
        if tried:
            thresholds[k] = min(enough) if enough else max(tried, key=lambda x: x[1])[2]
    return judge
