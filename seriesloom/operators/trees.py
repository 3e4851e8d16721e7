"""Growing classification trees on binned rows, all nodes of a level of many trees at once.

A table is a matrix of bins (features x rows, one byte each). Trees of one forest share
it; a tree differs by how often it takes each row (a Poisson count from a hash of seed, tree
and row number) and by the features that a node may use (a hash of seed, tree and the
node's path), so that any task, at any time, gets the same tree. A node's path is 1 for
the root and 2p, 2p+1 for the children of p.

Counts are whole numbers and class weights are applied to sums of them, so a
split comes out the same however rows were dealt to tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

MAX_BINS = 32
ROOT = 1
MAX_DEPTH = 62  # a path is a long
PAIRS = 1 << 16  # (tree, row) held at a time, about
LEAST_GAIN = 1e-12  # of a node's weight
_GOLDEN, _ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Forest:
    """Settings of a forest; ``features`` is sqrt, log2, all, a share or a number per node."""

    num_trees: int = 100
    max_depth: int | None = None
    min_split: int = 2
    min_leaf: int = 1
    features: str | float | int = "sqrt"
    seed: int = 42

    def per_node(self, n_features: int) -> int:
        named = {"sqrt": math.sqrt(n_features), "log2": math.log2(max(n_features, 1)), "all": n_features, None: n_features}
        if self.features in named:
            n = named[self.features]
        else:
            n = self.features * n_features if isinstance(self.features, float) else self.features
        return min(n_features, max(1, int(n)))

    @property
    def depth(self) -> int:
        return MAX_DEPTH if self.max_depth is None else min(self.max_depth, MAX_DEPTH)


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit numbers (the finisher of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tree_key(seed: int, trees: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.uint64(seed & (1 << 63) - 1) + (trees.astype(np.uint64) + np.uint64(1)) * _GOLDEN)


_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(16)])


def taken(seed: int, trees: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """How often each tree takes each row: trees x rows, Poisson with mean 1."""
    with np.errstate(over="ignore"):
        h = mix(_tree_key(seed, trees)[:, None] ^ (rows.astype(np.uint64) * _ODD)[None, :])
    return np.searchsorted(_POISSON, (h >> np.uint64(11)) * 2.0**-53, side="right")


def usable_features(seed: int, trees: np.ndarray, paths: np.ndarray, n_features: int, count: int) -> np.ndarray:
    """The features that each node may split on, ascending: nodes x count."""
    if count >= n_features:
        return np.broadcast_to(np.arange(n_features), (len(trees), n_features))
    with np.errstate(over="ignore"):
        node = mix(_tree_key(seed, trees) ^ (paths.astype(np.uint64) * _ODD))
        h = mix(node[:, None] + np.arange(1, n_features + 1, dtype=np.uint64)[None, :] * _GOLDEN)
    return np.sort(np.argpartition(h, count - 1, axis=1)[:, :count], axis=1)


def purity(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sum of squared class weights over their sum, per node: larger is purer. counts: classes x ..."""
    total, squares = np.zeros(counts.shape[1:]), np.zeros(counts.shape[1:])
    for own, weight in zip(counts, weights):
        weighted = own * weight if weight != 1 else own
        total += weighted
        squares += weighted * weighted
    return squares / np.maximum(total, 1e-300)


def best_of_feature(hist: np.ndarray, weights: np.ndarray, min_leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """Best bin to split after, and its purity, for histograms classes x nodes x bins."""
    left = hist.cumsum(axis=2)
    whole = left[:, :, -1:]
    left = left[:, :, :-1]
    n_left = left.sum(axis=0)
    n_right = whole.sum(axis=0) - n_left
    score = purity(left, weights) + purity(whole - left, weights)
    score[(n_left < min_leaf) | (n_right < min_leaf)] = -np.inf
    at = score.argmax(axis=1)
    return at, score[np.arange(len(at)), at]


def may_split(counts: np.ndarray, paths: np.ndarray, forest: Forest) -> np.ndarray:
    """Nodes that are not pure, not too deep and not too small; counts: classes x nodes."""
    size = counts.sum(axis=0)
    depth = np.frexp(paths.astype(float))[1] - 1
    return (depth < forest.depth) & (size >= max(forest.min_split, 2 * forest.min_leaf)) & (counts.max(axis=0) < size)


@dataclass
class Nodes:
    """Nodes of trees: feature -1 for a leaf; counts: nodes x classes."""

    tree: np.ndarray
    path: np.ndarray
    feature: np.ndarray
    bin: np.ndarray
    counts: np.ndarray


def grow(
    bins: np.ndarray,
    y: np.ndarray,
    tree: np.ndarray,
    path: np.ndarray,
    pairs: tuple[np.ndarray, np.ndarray, np.ndarray],
    forest: Forest,
    weights: np.ndarray,
    n_bins: int,
    visit: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], None] | None = None,
) -> list[Nodes]:
    """Grow the nodes (tree, path) to the leaves.

    ``pairs`` are node, row and count of the rows that the nodes take. ``visit`` sees each
    level: whether nodes are leaves, their class weights, feature, bin and the
    place of their left child in the next level.
    """
    n_features, n = bins.shape
    flat, classes = bins.ravel(), len(weights)
    count = forest.per_node(n_features)
    node, row, times = pairs
    times = times.astype(float)
    out = []
    while len(tree):
        counts = np.bincount(y[row] * len(tree) + node, times, classes * len(tree)).reshape(classes, len(tree))
        inner = may_split(counts, path, forest)
        feature, cut = np.full(len(tree), -1), np.zeros(len(tree), np.int64)
        places = np.flatnonzero(inner)
        if len(places):
            number = np.full(len(tree), -1)
            number[places] = np.arange(len(places))
            use = inner[node]
            node, row, times = number[node[use]], row[use], times[use]
            usable = usable_features(forest.seed, tree[places], path[places], n_features, count)
            best = purity(counts[:, places], weights)
            best = best + LEAST_GAIN * np.maximum(best, 1)
            base = (y[row] * len(places) + node) * n_bins
            for j in range(count):
                own = usable[:, j]
                key = base + flat[own[node] * n + row]
                hist = np.bincount(key, times, classes * len(places) * n_bins).reshape(classes, len(places), n_bins)
                at, score = best_of_feature(hist, weights, forest.min_leaf)
                better = score > best
                best[better], feature[places[better]], cut[places[better]] = score[better], own[better], at[better]
        split = feature >= 0
        child = np.full(len(tree), -1)
        child[split] = 2 * np.arange(int(split.sum()))
        out.append(Nodes(tree, path, feature, cut, counts.T))
        if visit is not None:
            visit(~split, counts.T * weights, feature, cut, child)
        if not split.any():
            break
        use = split[places][node]
        node, row, times = places[node[use]], row[use], times[use]
        node = child[node] + (flat[feature[node] * n + row] > cut[node])
        tree, path = np.repeat(tree[split], 2), np.repeat(path[split], 2) * 2 + np.tile([0, 1], int(split.sum()))
    return out


class Votes:
    """Class shares of the leaves that rows reach, summed over trees while they grow."""

    def __init__(self, bins: np.ndarray, n_trees: int, classes: int):
        self.bins, self.n = bins.ravel(), bins.shape[1]
        self.sums = np.zeros((self.n, classes))
        self.node, self.row = np.repeat(np.arange(n_trees), self.n), np.tile(np.arange(self.n), n_trees)

    def __call__(self, leaf: np.ndarray, counts: np.ndarray, feature: np.ndarray, cut: np.ndarray, child: np.ndarray) -> None:
        done = leaf[self.node]
        share = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1e-300)
        for c in range(self.sums.shape[1]):
            self.sums[:, c] += np.bincount(self.row[done], share[self.node[done], c], self.n)
        node, row = self.node[~done], self.row[~done]
        self.node, self.row = child[node] + (self.bins[feature[node] * self.n + row] > cut[node]), row


def grow_trees(
    bins: np.ndarray, y: np.ndarray, rows: np.ndarray, trees: np.ndarray, forest: Forest, weights: np.ndarray, n_bins: int, test: np.ndarray | None = None
) -> tuple[list[Nodes], np.ndarray | None]:
    """Whole trees on one table, a few at a time; with ``test`` bins also the summed votes for these rows."""
    nodes, votes = [], None if test is None else np.zeros((test.shape[1], len(weights)))
    step = max(1, PAIRS // max(1, len(y)))
    for first in range(0, len(trees), step):
        some = trees[first : first + step]
        times = taken(forest.seed, some, rows)
        at = np.nonzero(times)
        visit = None if test is None else Votes(test, len(some), len(weights))
        grown = grow(bins, y, some, np.full(len(some), ROOT), (*at, times[at]), forest, weights, n_bins, visit)
        if visit is None:
            nodes += grown
        else:
            votes += visit.sums
    return nodes, votes
