"""Second-order boosting for several classes on binned tables.

Each round adds one tree per class to the margins. With softmax shares p, a row of weight w
has gradient w (p - [its class]) and hessian w 2 p (1 - p); a node is worth
G^2 / (H + l2), a split what its children are worth more than that, and a leaf adds
-rate G / (H + l2) to the margin. Rows and features may be sampled per tree, by
a hash of seed, tree and row or feature. A node is split only if that gains more than
``gamma`` and leaves each child a hessian of ``min_child_weight``.

A table of at most LOCAL_BYTES (its size is known) is brought to every task, and a task
boosts a whole setting and fold. Beyond that each level of a round is one pass: tasks
sum gradients and hessians of their blocks per node, feature and bin, and the sums meet per
node. Margins are written with the blocks every STATE_ROUNDS rounds, and made from the
few trees since then in between. Sums of doubles may differ in the last digits with the way
that rows are dealt; both ways agree but for that.

Missing values, labels, class weights and errors are as in ``forests``. One class alone has
margins 0.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..sources.staging import stage
from .forests import HIST_BYTES, HIST_ROWS, LOCAL_BYTES, NODE, Binned, Block, ForestModel, Unit, Upper, _confusion_of_votes, _local, _n_bins, _named, _node_batch, _pair_counts, _tests, _trains, _union
from .trees import ROOT, Nodes, _tree_key, mix, usable_features

STATE_ROUNDS = 8
LEAST_GAIN = 1e-6
ROUNDING = 1e-9
LEAST_HESSIAN = 1e-16
KEYS = 1 << 22  # (row, feature) counted at a time
_ODD = np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Boosting:
    """Settings; ``subsample`` and ``features`` are shares of rows and features per tree."""

    rounds: int = 100
    max_depth: int = 6
    rate: float = 0.3
    subsample: float = 1.0
    features: float = 1.0
    min_child_weight: float = 1.0
    gamma: float = 0.0
    l2: float = 1.0
    seed: int = 42

    @property
    def num_trees(self) -> int:
        return self.rounds

    def per_node(self, n_features: int) -> int:
        return min(n_features, max(1, int(self.features * n_features)))


def gradients(margins: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients and hessians, classes x rows, of margins (classes x rows)."""
    p = np.exp(margins - margins.max(axis=0))
    p /= p.sum(axis=0)
    own = np.arange(len(margins))[:, None] == y
    return weights * (p - own), np.maximum(2 * p * (1 - p), LEAST_HESSIAN) * weights


def sampled(setting: Boosting, trees: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Whether each tree takes each row: trees x rows."""
    if setting.subsample >= 1:
        return np.ones((len(trees), len(rows)), bool)
    with np.errstate(over="ignore"):
        h = mix(_tree_key(setting.seed, trees)[:, None] ^ (rows.astype(np.uint64) * _ODD)[None, :])
    return (h >> np.uint64(11)) * 2.0**-53 < setting.subsample


def usable(setting: Boosting, trees: np.ndarray, n_features: int) -> np.ndarray:
    """Whether each tree may use each feature: trees x features."""
    out = np.zeros((len(trees), n_features), bool)
    chosen = usable_features(setting.seed, trees, np.zeros(len(trees), np.int64), n_features, setting.per_node(n_features))
    np.put_along_axis(out, chosen, True, axis=1)
    return out


def sums(node: np.ndarray, row: np.ndarray, g: np.ndarray, h: np.ndarray, bins: np.ndarray, n_nodes: int, n_bins: int) -> np.ndarray:
    """Gradients and hessians per node, feature and bin: 2 x nodes x features x bins."""
    width = len(bins)
    out = np.zeros((2, n_nodes, width, n_bins))
    step = max(1, KEYS // max(1, len(row)))
    for first in range(0, width, step):
        some = bins[first : first + step, row] if len(row) else np.zeros((min(step, width - first), 0), np.int64)
        count = len(some)
        key = ((node * count + np.arange(count)[:, None]) * n_bins + some).ravel()
        for i, values in enumerate((g, h)):
            counted = np.bincount(key, np.broadcast_to(values, some.shape).ravel(), n_nodes * count * n_bins)
            out[i, :, first : first + step] = counted.reshape(n_nodes, count, n_bins)
    return out


def best_splits(both: np.ndarray, allowed: np.ndarray, setting: Boosting) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature (-1: none) and bin of the best split of each node, and its [gradient, hessian]."""
    left = both.cumsum(axis=3)
    whole = left[:, :, :1, -1:]
    left = left[:, :, :, :-1]
    worth = lambda g, h: g * g / np.maximum(h + setting.l2, 1e-300)
    right_h = whole[1] - left[1]
    gain = worth(left[0], left[1]) + worth(whole[0] - left[0], right_h) - worth(whole[0], whole[1])
    gain[(left[1] < setting.min_child_weight) | (right_h < setting.min_child_weight) | ~allowed[:, :, None]] = -np.inf
    flat = gain.reshape(len(gain), -1)
    best = flat.max(axis=1, initial=-np.inf)
    # of gains that rounding may tell apart the first: the same however sums were made
    at = (flat >= (best - ROUNDING * (1 + np.abs(best)))[:, None]).argmax(axis=1) if flat.shape[1] else np.zeros(len(gain), np.int64)
    feature = np.where(best > max(setting.gamma, LEAST_GAIN), at // max(1, gain.shape[2]), -1)
    return feature, at % max(1, gain.shape[2]), whole[:, :, 0, 0].T


def leaf_value(totals: np.ndarray, setting: Boosting) -> np.ndarray:
    return -setting.rate * totals[:, 0] / np.maximum(totals[:, 1] + setting.l2, 1e-300)


def add_round(bins: np.ndarray, y: np.ndarray, rows: np.ndarray, weights: np.ndarray, margins: np.ndarray, number: int, setting: Boosting, n_bins: int) -> list[Nodes]:
    """One tree per class; ``margins`` (classes x rows) are changed. Rows of weight 0 are carried along."""
    classes, n = margins.shape
    trees = number * classes + np.arange(classes)
    g, h = gradients(margins, y, weights)
    taken = sampled(setting, trees, rows)
    g, h = (g * taken).ravel(), (h * taken).ravel()
    allowed = usable(setting, trees, len(bins))
    pair = np.arange(classes * n)
    node, tree, path = pair // n, trees, np.full(classes, ROOT)
    flat, out, depth = margins.ravel(), [], 0
    while len(tree):
        row = pair % n
        totals = np.stack([np.bincount(node, v[pair], len(tree)) for v in (g, h)], axis=1)
        feature, cut = np.full(len(tree), -1), np.zeros(len(tree), np.int64)
        if depth < setting.max_depth:
            live = h[pair] > 0  # rows that are only carried count nowhere
            both = sums(node[live], row[live], g[pair[live]], h[pair[live]], bins, len(tree), n_bins)
            feature, cut, _ = best_splits(both, allowed[tree - trees[0]], setting)
        split = feature >= 0
        value = np.where(split, 0.0, leaf_value(totals, setting))
        done = ~split[node]
        flat[pair[done]] += value[node[done]]
        values = np.zeros((len(tree), classes))
        values[np.arange(len(tree)), tree - trees[0]] = value
        out.append(Nodes(tree, path, feature, cut, values))
        child = np.cumsum(split) * 2 - 2
        node, pair = node[~done], pair[~done]
        node = child[node] + (bins[feature[node], pair % n] > cut[node])
        tree, path = np.repeat(tree[split], 2), np.repeat(path[split], 2) * 2 + np.tile([0, 1], int(split.sum()))
        depth += 1
    return out


def boost(bins: np.ndarray, y: np.ndarray, rows: np.ndarray, weights: np.ndarray, classes: int, setting: Boosting, n_bins: int) -> tuple[np.ndarray, list[Nodes]]:
    """All rounds on one table: margins (classes x rows) and nodes. Rows of weight 0 are scored, not learned from."""
    margins, nodes = np.zeros((classes, len(y))), []
    if classes > 1:
        bins = bins.astype(np.int64)
        for number in range(setting.rounds):
            nodes += add_round(bins, y, rows, weights, margins, number, setting, n_bins)
    return margins, nodes


def _joined(train: Block, test: Block, weights: np.ndarray) -> tuple[np.ndarray, ...]:
    w = np.concatenate([weights[train.y], np.zeros(len(test.y))])
    return np.concatenate([train.bins, test.bins], axis=1), np.concatenate([train.y, test.y]), np.concatenate([train.rows, test.rows]), w


def _boost_confusion(unit: Unit, train: Block, test: Block, weights: np.ndarray, n_bins: int) -> pa.RecordBatch:
    margins, _ = boost(*_joined(train, test, weights), len(weights), unit.forest, n_bins)
    return _pair_counts(unit, test.y, margins[:, len(train.y) :].T, len(weights))


def _boost_nodes(unit: Unit, train: Block, test: Block, weights: np.ndarray, n_bins: int) -> pa.RecordBatch:
    _, nodes = boost(train.bins, train.y, train.rows, weights[train.y], len(weights), unit.forest, n_bins)
    none = Nodes(*(np.zeros(0, np.int64) for _ in range(4)), np.zeros((0, len(weights))))
    return _node_batch(nodes or [none])


def cross_validate(table: Binned, settings: Sequence[Boosting], folds: Sequence[int], weighted: bool = False, local_bytes: int = LOCAL_BYTES) -> DataFrame:
    """Rows per (setting, fold, truth, prediction) of every setting on every fold."""
    units = [Unit(0, s, fold, 0, s.rounds) for s in settings for fold in folds]
    units = [replace(u, number=i) for i, u in enumerate(units)]
    weights = {fold: table.weights(fold, weighted) for fold in folds}
    if table.bytes <= local_bytes:
        votes = _local(table, units, weights, _boost_confusion, "unit int, truth int, prediction int, n long")
    else:
        parts = []
        for u in units:
            state, _ = _boost_spread(table, u.forest, u.fold, weights[u.fold])
            parts.append(stage(_confusion_of_votes(_margins_of(state, u.fold, len(weights[u.fold])), u.number), "votes"))
        votes = _union(parts)
    return _named(votes, table.labels, len(folds), folds)


@dataclass
class BoostModel(ForestModel):
    """Nodes of boosted trees; the values of reached leaves add up to margins."""

    def shares(self, values: np.ndarray) -> np.ndarray:
        return values


def train(table: Binned, setting: Boosting, weighted: bool = False, fold: int | None = None, local_bytes: int = LOCAL_BYTES) -> BoostModel:
    weights = table.weights(fold, weighted)
    if table.bytes <= local_bytes:
        nodes = _local(table, [Unit(0, setting, fold, 0, setting.rounds)], {fold: weights}, _boost_nodes, NODE)
    else:
        _, grown = _boost_spread(table, setting, fold, weights)
        nodes = table.blocks.sparkSession.createDataFrame([(int(t), int(p), int(f), int(b), v.tolist()) for g in grown for t, p, f, b, v in zip(g.tree, g.path, g.feature, g.bin, g.counts)], NODE)
    return BoostModel(nodes, setting, table.features, table.edges, table.labels, weights)


# ---- tables beyond one task


def _routed(block: Block, upper: Upper, first: int, classes: int) -> np.ndarray:
    """The node that each (tree, row) of ``classes`` trees whose roots are the nodes from ``first`` on comes to."""
    n = len(block.y)
    return upper.reached(np.repeat(first + np.arange(classes), n), np.tile(np.arange(n), classes), block.bins)


def _margins(block: Block, stored: np.ndarray, recent: list[tuple[Upper, np.ndarray]]) -> np.ndarray:
    """Stored margins and what the trees since then add."""
    margins = stored.copy()
    for upper, value in recent:
        margins += value[_routed(block, upper, 0, len(margins))].reshape(margins.shape)
    return margins


def _stored(batch, width: int, classes: int) -> Iterator[tuple[Block, np.ndarray]]:
    for i in range(batch.num_rows):
        one = batch.slice(i, 1)
        block = Block.of(one, width)
        yield block, np.frombuffer(one.column(5)[0].as_py()).reshape(classes, len(block.y))


def _boost_spread(table: Binned, setting: Boosting, fold: int | None, weights: np.ndarray) -> tuple[DataFrame, list[Nodes]]:
    """Blocks with their final margins, and the trees."""
    width, classes = len(table.features), len(weights)

    def zero(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            empty = [np.zeros((classes, len(Block.of(batch.slice(i, 1), width).y))).tobytes() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(empty, pa.binary())], [*batch.schema.names, "margins"])

    schema = "block long, bins binary, y binary, part binary, only binary, margins binary"
    state, recent, grown = table.blocks.mapInArrow(zero, schema), [], []
    for number in range(setting.rounds if classes > 1 else 0):
        upper, totals = _boost_round(table, state, recent, number, setting, fold, weights)
        value = np.where(np.array(upper.left) >= 0, 0.0, leaf_value(totals, setting))
        values = np.zeros((len(value), classes))
        values[np.arange(len(value)), np.array(upper.tree) - number * classes] = value
        grown.append(Nodes(np.array(upper.tree), np.array(upper.path), np.where(np.array(upper.left) >= 0, upper.feature, -1), np.array(upper.bin), values))
        recent.append((upper, value))
        if len(recent) == STATE_ROUNDS or number == setting.rounds - 1:
            state, recent = stage(_with_margins(state, recent, schema, width, classes), "margins"), []
    return state, grown


def _with_margins(state: DataFrame, recent: list, schema: str, width: int, classes: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [_margins(block, stored, recent).tobytes() for block, stored in _stored(batch, width, classes)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(new, pa.binary())], batch.schema.names)

    return state.mapInArrow(run, schema)


def _boost_round(table: Binned, state: DataFrame, recent: list, number: int, setting: Boosting, fold: int | None, weights: np.ndarray) -> tuple[Upper, np.ndarray]:
    width, classes, n_bins = len(table.features), len(weights), _n_bins(table)
    trees = [number * classes + c for c in range(classes)]
    upper = Upper(trees[:], [ROOT] * classes, [-1] * classes, [0] * classes, [-1] * classes, {})
    totals = [np.zeros(2)] * classes
    open_nodes, depth = list(range(classes)), 0
    step = max(1, HIST_BYTES // (16 * width * n_bins))
    while open_nodes:
        following = []
        for first in range(0, len(open_nodes), step):
            some = open_nodes[first : first + step]
            found = {r.node: r for r in _boost_level(state, recent, upper, some, number, setting, fold, weights, width, n_bins).collect()}
            for i in some:
                if i not in found:  # no row is there
                    continue
                r = found[i]
                totals[i] = np.array(r.totals)
                if r.feature >= 0 and depth < setting.max_depth:
                    upper.feature[i], upper.bin[i], upper.left[i] = r.feature, r.bin, len(upper.tree)
                    for side in (0, 1):
                        upper.tree.append(upper.tree[i])
                        upper.path.append(2 * upper.path[i] + side)
                        upper.feature.append(-1)
                        upper.bin.append(0)
                        upper.left.append(-1)
                        totals.append(np.zeros(2))
                        following.append(len(upper.tree) - 1)
        open_nodes, depth = following, depth + 1
    return upper, np.array(totals)


def _boost_level(state, recent, upper, open_nodes, number, setting, fold, weights, width, n_bins) -> DataFrame:
    classes = len(weights)
    place = np.full(len(upper.tree), -1)
    place[open_nodes] = np.arange(len(open_nodes))
    trees = number * classes + np.arange(classes)
    shape = (2, 1, width, n_bins)
    allowed = usable(setting, np.array(upper.tree), width)

    def histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((2, len(open_nodes), width, n_bins))
        for batch in batches:
            for block, stored in _stored(batch, width, classes):
                weight = weights[block.y] * _trains(block.part, block.only, fold)
                g, h = gradients(_margins(block, stored, recent), block.y, weight)
                taken = sampled(setting, trees, block.rows)
                g, h = (g * taken).ravel(), (h * taken).ravel()
                node = place[_routed(block, upper, 0, classes)]
                use = np.flatnonzero((node >= 0) & (h > 0))
                both += sums(node[use], use % len(block.y), g[use], h[use], block.bins.astype(np.int64), len(open_nodes), n_bins)
        seen = np.flatnonzero(both[1].any(axis=(1, 2)))
        salt = TaskContext.get().partitionId() // HIST_ROWS
        columns = [pa.array(np.array(open_nodes)[seen], pa.int32()), pa.array([salt] * len(seen), pa.int32()), pa.array([both[:, i : i + 1].tobytes() for i in seen], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["node", "salt", "sums"])

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(shape)
        for part in group["sums"].to_pylist():
            total += np.frombuffer(part).reshape(shape)
        return pa.table([group["node"][:1], pa.array([total.tobytes()], pa.binary())], ["node", "sums"])

    def choose(group: pa.Table) -> pa.Table:
        node = group["node"][0].as_py()
        total = np.sum([np.frombuffer(part).reshape(shape) for part in group["sums"].to_pylist()], axis=0)
        feature, cut, whole = best_splits(total, allowed[node : node + 1], setting)
        return pa.table([pa.array([node], pa.int32()), pa.array(feature, pa.int32()), pa.array(cut, pa.int32()), pa.array(whole.tolist(), pa.list_(pa.float64()))], ["node", "feature", "bin", "totals"])

    made = state.mapInArrow(histograms, "node int, salt int, sums binary")
    summed = made.groupBy("node", "salt").applyInArrow(add, "node int, sums binary")
    return summed.groupBy("node").applyInArrow(choose, "node int, feature int, bin int, totals array<double>")


def _margins_of(state: DataFrame, fold: int, classes: int) -> DataFrame:
    """row, truth and margins of the rows that a fold tests."""
    width_free = ", ".join(f"v{c} double" for c in range(classes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for y, part, only, margins in zip(*(batch.column(i).to_pylist() for i in range(4))):
                truth = np.frombuffer(y, np.int32).astype(np.int64)
                test = _tests(np.frombuffer(part, np.int32), np.frombuffer(only, np.int32), fold)
                found = np.frombuffer(margins).reshape(classes, len(truth))[:, test]
                yield pa.RecordBatch.from_arrays([pa.array(truth[test]), *(pa.array(v) for v in found)], ["truth", *(f"v{c}" for c in range(classes))])

    return state.select("y", "part", "only", "margins").mapInArrow(run, f"truth long, {width_free}")
