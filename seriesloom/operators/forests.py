"""Random forests on Spark: many settings and folds in one pass over a binned table.

Features are cut into at most ``max_bins`` bins by quantiles of the whole table (one
aggregation), rows become bytes and are written once, in blocks. Then

- nodes that hold more than LOCAL_BYTES of rows are split level by level: each task
  makes histograms of its blocks for all open nodes of many trees, these are summed per
  node, and the best splits come back to the driver, which holds the upper nodes
  only (as many as LOCAL_BYTES goes into the table);
- smaller nodes are grown to their leaves where their rows are: the rows of a node travel
  to one task. If the whole table is that small, each task gets it by a broadcast
  (its size is known from the count) and grows whole forests or parts of one.

Both ways give the same trees (see ``trees``). Cross-validation never makes a model: test rows
travel with the training rows and leave their votes at the leaves.

A missing value, NaN or -infinity is in the lowest bin. Rows without a label train nothing
and are not scored. Repeated rows count as often as they occur; extra columns are
ignored. A table without labelled rows is an error. With class weights a class weighs
n / (classes * its rows), of the rows its fold trains on.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.staging import stage
from .trees import LEAST_GAIN, MAX_BINS, ROOT, Forest, Nodes, Votes, best_of_feature, grow, grow_trees, may_split, purity, taken, usable_features

BLOCK_ROWS = 4096
LOCAL_BYTES = 32 << 20  # of a node's rows, as bins, in one task
WAVE_TREES = 64  # whose upper nodes are split in the same passes
UNIT_TREES = 25  # of one forest that a task grows
MODEL_BYTES = 64 << 20  # of nodes that score a table in one pass
QUANTILE_ACCURACY = 2000
HIST_ROWS = 256  # partial histograms summed at a time
HIST_BYTES = 128 << 20  # of histograms that a task makes in one pass
NODE = "tree int, path long, feature int, bin int, counts array<double>"


@dataclass
class Binned:
    """A table as blocks of bins. ``part`` numbers a row's fold block, -1 for rows of the fold ``only`` alone."""

    blocks: DataFrame
    features: list[str]
    edges: list[np.ndarray]
    labels: list
    rows: int
    counts: dict  # (part, only, class) -> rows

    @property
    def bytes(self) -> int:
        return self.rows * len(self.features)

    def weights(self, fold: int | None, weighted: bool) -> np.ndarray:
        """Weight of each class in what a fold trains on; all rows if there is no fold."""
        n = np.zeros(len(self.labels))
        for (part, only, y), rows in self.counts.items():
            n[y] += rows * bool(_trains(part, only, fold))
        if not weighted:
            return np.ones(len(n))
        return np.divide(n.sum(), (n > 0).sum() * n, out=np.zeros(len(n)), where=n > 0)


def _trains(part, only, fold: int | None):
    return (part < fold) & ((only == 0) | (only == fold)) if fold is not None else (part == part)


def _tests(part, only, fold: int):
    return (part == fold) & (only == 0)


def edges_of(df: DataFrame, features: Sequence[str], max_bins: int = MAX_BINS) -> list[np.ndarray]:
    """Upper ends of the bins of each feature but the last, from quantiles of all rows in one pass."""
    shares = F.lit([i / max_bins for i in range(1, max_bins)])
    finite = lambda c: F.when(F.abs(c) < float("inf"), c)
    found = df.agg(*[F.percentile_approx(finite(F.col(f"`{f}`").cast("double")), shares, QUANTILE_ACCURACY).alias(f"q{i}") for i, f in enumerate(features)]).first()
    return [np.unique(np.array(found[i] or [0.0], float)) for i in range(len(features))]


def bin_table(
    df: DataFrame, features: Sequence[str], label: str, part: Column | None = None, only: Column | None = None, max_bins: int = MAX_BINS, edges: list[np.ndarray] | None = None
) -> Binned:
    """Write the labelled rows of a table as bins."""
    edges = edges_of(df, features, max_bins) if edges is None else edges
    known = df.where(F.col(label).isNotNull())
    labels = sorted(r[0] for r in known.select(label).distinct().collect())
    if not labels:
        raise ValueError(f"no row has a {label}")
    code = F.element_at(F.create_map(*[F.lit(x) for i, v in enumerate(labels) for x in (v, i)]), F.col(label))
    zero = F.lit(0)
    rows = known.select(
        F.array(*[F.col(f"`{f}`").cast("double") for f in features]).alias("x"),
        code.cast("int").alias("y"),
        (zero if part is None else part).cast("int").alias("part"),
        (zero if only is None else only).cast("int").alias("only"),
    )
    width = len(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 24
        for batch in batches:
            for first in range(0, batch.num_rows, BLOCK_ROWS):
                some = batch.slice(first, BLOCK_ROWS)
                x = np.array(some.column(0).flatten().fill_null(np.nan), float).reshape(some.num_rows, width).T
                bins = binned(x, edges)
                others = [np.array(some.column(i), np.int32) for i in (1, 2, 3)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.int64()), *(pa.array([a.tobytes()], pa.binary()) for a in (bins, *others))], ["block", "bins", "y", "part", "only"]
                )
                block += 1

    blocks = stage(rows.mapInArrow(run, "block long, bins binary, y binary, part binary, only binary"), "bins")
    counts = {(r.part, r.only, r.y): r.n for r in rows.groupBy("part", "only", "y").agg(F.count(F.lit(1)).alias("n")).collect()}
    return Binned(blocks, list(features), edges, labels, sum(counts.values()), counts)


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bins of features x rows; missing is the lowest."""
    out = np.zeros(x.shape, np.uint8)
    for i, e in enumerate(edges):
        out[i] = np.where(np.isnan(x[i]), 0, np.searchsorted(e, x[i], side="left"))
    return out


@dataclass
class Block:
    """Rows of some blocks together, with row numbers that are theirs whoever reads them."""

    bins: np.ndarray
    y: np.ndarray
    part: np.ndarray
    only: np.ndarray
    rows: np.ndarray

    @staticmethod
    def of(batch, width: int) -> Block:
        parts = []
        for block, bins, *others in zip(*(batch.column(i).to_pylist() for i in range(5))):
            y, part, only = (np.frombuffer(b, np.int32).astype(np.int64) for b in others)
            parts.append((np.frombuffer(bins, np.uint8).reshape(width, len(y)), y, part, only, block * BLOCK_ROWS + np.arange(len(y))))
        if not parts:
            return Block(np.zeros((width, 0), np.uint8), *(np.zeros(0, np.int64) for _ in range(4)))
        columns = list(zip(*parts))
        return Block(np.concatenate(columns[0], axis=1), *(np.concatenate(c) for c in columns[1:]))

    def where(self, use: np.ndarray) -> Block:
        return Block(self.bins[:, use], self.y[use], self.part[use], self.only[use], self.rows[use])


@dataclass(frozen=True)
class Unit:
    """Trees ``first`` to ``last`` of a forest, trained for a fold (None: on all rows)."""

    number: int
    forest: Forest
    fold: int | None
    first: int
    last: int

    def trees(self) -> np.ndarray:
        return np.arange(self.first, self.last)


def cross_validate(table: Binned, forests: Sequence[Forest], folds: Sequence[int], weighted: bool = False, local_bytes: int = LOCAL_BYTES) -> DataFrame:
    """Rows per (setting, fold, truth, prediction) of every forest on every fold."""
    units = [Unit(0, f, fold, 0, f.num_trees) for f in forests for fold in folds]
    units = [replace(u, number=i) for i, u in enumerate(units)]
    weights = {fold: table.weights(fold, weighted) for fold in folds}
    labels, n_folds = table.labels, len(folds)
    if table.bytes <= local_bytes:
        votes = _local(table, units, weights, _confusion, "unit int, truth int, prediction int, n long")
    else:
        parts = [_confusion_of_votes(_votes(table, u, weights[u.fold], local_bytes), u.number) for u in units]
        votes = stage(_union(parts), "votes")
    return _named(votes, labels, n_folds, folds)


def _named(votes: DataFrame, labels: list, n_folds: int, folds: Sequence[int]) -> DataFrame:
    names = F.array(*[F.lit(v) for v in labels])
    return votes.select(
        F.floor(F.col("unit") / n_folds).cast("int").alias("setting"),
        F.element_at(F.array(*[F.lit(i) for i in folds]), F.col("unit") % n_folds + 1).cast("int").alias("fold"),
        F.element_at(names, F.col("truth") + 1).alias("truth"),
        F.element_at(names, F.col("prediction") + 1).alias("pred"),
        "n",
    )


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _winner(votes: np.ndarray) -> np.ndarray:
    """The class with most votes; sums that differ by rounding alone are equal, and the first class wins."""
    return np.round(votes, 9).argmax(axis=1)


def _confusion(unit: Unit, train: Block, test: Block, weights: np.ndarray, n_bins: int) -> pa.RecordBatch:
    _, votes = grow_trees(train.bins, train.y, train.rows, unit.trees(), unit.forest, weights, n_bins, test.bins)
    return _pair_counts(unit, test.y, votes, len(weights))


def _pair_counts(unit: Unit, truth: np.ndarray, votes: np.ndarray, classes: int) -> pa.RecordBatch:
    pairs = np.zeros((classes, classes), np.int64)
    np.add.at(pairs, (truth, _winner(votes)), 1)
    truth, prediction = np.nonzero(pairs)
    return pa.RecordBatch.from_arrays(
        [pa.array([unit.number] * len(truth), pa.int32()), pa.array(truth, pa.int32()), pa.array(prediction, pa.int32()), pa.array(pairs[truth, prediction], pa.int64())],
        ["unit", "truth", "prediction", "n"],
    )


def _nodes(unit: Unit, train: Block, test: Block, weights: np.ndarray, n_bins: int) -> pa.RecordBatch:
    nodes, _ = grow_trees(train.bins, train.y, train.rows, unit.trees(), unit.forest, weights, n_bins)
    return _node_batch(nodes)


def _node_batch(nodes: list[Nodes]) -> pa.RecordBatch:
    joined = [np.concatenate([getattr(n, name) for n in nodes]) for name in ("tree", "path", "feature", "bin", "counts")]
    width = joined[4].shape[1]
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, joined[4].size + 1, width), pa.int32()), pa.array(joined[4].ravel().astype(float)))
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([*(pa.array(a, k) for a, k in zip(joined, kinds)), lists], ["tree", "path", "feature", "bin", "counts"])


def _n_bins(table: Binned) -> int:
    return max((len(e) for e in table.edges), default=0) + 1


def _local(table: Binned, units: list[Unit], weights: dict, make, schema: str) -> DataFrame:
    """``make`` of each unit, each in a task that has the whole table; its size has been checked."""
    spark = table.blocks.sparkSession
    whole = Block.of(pa.Table.from_pandas(table.blocks.orderBy("block").toPandas()).combine_chunks().to_batches()[0], len(table.features))
    shared, n_bins = spark.sparkContext.broadcast(whole), _n_bins(table)
    # the dearest first, so that none begins last
    cost = lambda u: -(u.last - u.first) * u.forest.per_node(len(table.features)) * (1 if u.fold is None else u.fold)
    units = sorted(units, key=cost)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            for i in batch.column(0).to_pylist():
                unit = units[i]
                train = block.where(_trains(block.part, block.only, unit.fold))
                test = block if unit.fold is None else block.where(_tests(block.part, block.only, unit.fold))
                yield make(unit, train, test, weights[unit.fold], n_bins)

    made = spark.range(0, len(units), 1, len(units)).mapInArrow(run, schema)
    return stage(made, "grown")


# ---- tables beyond one task


@dataclass
class Upper:
    """Upper nodes of some trees: feature (-1: none), bin, left child (the right one follows it), and counts by class where known."""

    tree: list[int]
    path: list[int]
    feature: list[int]
    bin: list[int]
    left: list[int]
    counts: dict[int, np.ndarray]

    def reached(self, start: np.ndarray, rows: np.ndarray, bins: np.ndarray) -> np.ndarray:
        """The node where each (start node, row) comes to its end."""
        feature, cut, left = (np.array(a) for a in (self.feature, self.bin, self.left))
        flat, n, node = bins.ravel(), bins.shape[1], start.copy()
        moving = np.flatnonzero(left[node] >= 0)
        while len(moving):
            at = node[moving]
            node[moving] = left[at] + (flat[feature[at] * n + rows[moving]] > cut[at])
            moving = moving[left[node[moving]] >= 0]
        return node


def _split_upper(table: Binned, unit: Unit, weights: np.ndarray, local_rows: int) -> tuple[Upper, set[int], set[int]]:
    """Split nodes of more than ``local_rows`` rows level by level; also which ends are leaves, and which are left to grow."""
    trees = unit.trees().tolist()
    upper = Upper(trees[:], [ROOT] * len(trees), [-1] * len(trees), [0] * len(trees), [-1] * len(trees), {})
    leaves: set[int] = set()
    small: set[int] = set()
    open_nodes = list(range(len(trees)))
    step = max(1, HIST_BYTES // (8 * unit.forest.per_node(len(table.features)) * _n_bins(table) * len(weights)))
    while open_nodes:
        passes = [open_nodes[i : i + step] for i in range(0, len(open_nodes), step)]
        splits = {(r.tree, r.path): r for some in passes for r in _best_splits(table, unit, weights, upper, some).collect()}
        following = []
        for i in open_nodes:
            r = splits.get((upper.tree[i], upper.path[i]))  # none for a tree that takes no row
            upper.counts[i] = np.array(r.counts if r is not None else [0.0] * len(weights))
            if r is None or r.feature < 0:
                leaves.add(i)
                continue
            upper.feature[i], upper.bin[i], upper.left[i] = r.feature, r.bin, len(upper.tree)
            for side, counts in enumerate((r.left, np.array(r.counts) - np.array(r.left))):
                upper.tree.append(upper.tree[i])
                upper.path.append(2 * upper.path[i] + side)
                upper.feature.append(-1)
                upper.bin.append(0)
                upper.left.append(-1)
                (following.append if np.sum(counts) > local_rows else small.add)(len(upper.tree) - 1)
        open_nodes = following
    return upper, leaves, small


def _pairs(unit: Unit, block: Block, upper: Upper) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Reached node, row and count of the training rows of a block."""
    trees = unit.trees()
    times = taken(unit.forest.seed, trees, block.rows)
    times[:, ~_trains(block.part, block.only, unit.fold)] = 0
    start, row = np.nonzero(times)
    return upper.reached(start, row, block.bins), row, times[start, row]


def _best_splits(table: Binned, unit: Unit, weights: np.ndarray, upper: Upper, open_nodes: list[int]) -> DataFrame:
    width, n_bins, classes = len(table.features), _n_bins(table), len(weights)
    count = unit.forest.per_node(width)
    trees, paths = np.array(upper.tree)[open_nodes], np.array(upper.path)[open_nodes]
    usable = usable_features(unit.forest.seed, trees, paths, width, count)
    shape = (classes, count, n_bins)
    place = np.full(len(upper.tree), -1)
    place[open_nodes] = np.arange(len(open_nodes))

    def histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(open_nodes), *shape))
        for batch in batches:
            block = Block.of(batch, width)
            node, row, times = _pairs(unit, block, upper)
            use = place[node] >= 0
            node, row, times = place[node[use]], row[use], times[use]
            flat, n = block.bins.ravel(), len(block.y)
            for j in range(count):
                key = (node * classes + block.y[row]) * n_bins + flat[usable[node, j] * n + row]
                sums[:, :, j] += np.bincount(key, times, len(open_nodes) * classes * n_bins).reshape(len(open_nodes), classes, n_bins)
        seen = np.flatnonzero(sums.any(axis=(1, 2, 3)))
        salt = TaskContext.get().partitionId() // HIST_ROWS
        columns = [pa.array(trees[seen], pa.int32()), pa.array(paths[seen], pa.int64()), pa.array([salt] * len(seen), pa.int32()), pa.array([sums[i].tobytes() for i in seen], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["tree", "path", "salt", "sums"])

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(shape)
        for part in group["sums"].to_pylist():
            total += np.frombuffer(part).reshape(shape)
        return pa.table([group["tree"][:1], group["path"][:1], pa.array([total.tobytes()], pa.binary())], ["tree", "path", "sums"])

    forest, place_of = unit.forest, {(int(t), int(p)): i for i, (t, p) in enumerate(zip(trees, paths))}

    def choose(group: pa.Table) -> pa.Table:
        tree, path = group["tree"][0].as_py(), group["path"][0].as_py()
        total = np.sum([np.frombuffer(part).reshape(shape) for part in group["sums"].to_pylist()], axis=0)
        counts = total[:, 0].sum(axis=1)
        feature, cut, left = -1, 0, np.zeros(classes)
        if may_split(counts[:, None], np.array([path]), forest)[0]:
            best = purity(counts[:, None], weights)[0]
            best += LEAST_GAIN * max(best, 1)
            for j in range(count):
                at, score = best_of_feature(total[:, j][:, None, :], weights, forest.min_leaf)
                if score[0] > best:
                    best, feature, cut, left = score[0], int(usable[place_of[tree, path], j]), int(at[0]), total[:, j, : at[0] + 1].sum(axis=1)
        lists = [pa.array([v.tolist()], pa.list_(pa.float64())) for v in (counts, left)]
        return pa.table([pa.array([tree], pa.int32()), pa.array([path], pa.int64()), pa.array([feature], pa.int32()), pa.array([cut], pa.int32()), *lists], ["tree", "path", "feature", "bin", "counts", "left"])

    made = table.blocks.mapInArrow(histograms, "tree int, path long, salt int, sums binary")
    summed = made.groupBy("tree", "path", "salt").applyInArrow(add, "tree int, path long, sums binary")
    return summed.groupBy("tree", "path").applyInArrow(choose, f"{NODE}, left array<double>")


def _shipped(table: Binned, unit: Unit, upper: Upper, wanted: set[int], with_test: bool) -> DataFrame:
    """The rows of nodes: per node and block their bins, classes and counts; test rows have count 0."""
    width = len(table.features)
    chosen = np.zeros(len(upper.tree), bool)
    chosen[sorted(wanted)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = Block.of(batch, width)
            node, row, times = _pairs(unit, block, upper)
            if with_test:
                tested = np.flatnonzero(_tests(block.part, block.only, unit.fold))
                n_trees = unit.last - unit.first
                start, more = np.repeat(np.arange(n_trees), len(tested)), np.tile(tested, n_trees)
                node = np.concatenate([node, upper.reached(start, more, block.bins)])
                row, times = np.concatenate([row, more]), np.concatenate([times, np.zeros(len(more), times.dtype)])
            use = chosen[node]
            node, row, times = node[use], row[use], times[use]
            order = np.argsort(node, kind="stable")
            node, row, times = node[order], row[order], times[order]
            edges = np.flatnonzero(np.diff(node, prepend=-1, append=-1))
            out = []
            for a, b in zip(edges, edges[1:]):
                some = row[a:b]
                out.append((int(node[a]), block.bins[:, some].tobytes(), block.y[some].tobytes(), block.rows[some].tobytes(), times[a:b].astype(np.int64).tobytes()))
            columns = list(zip(*out)) or [()] * 5
            kinds = [pa.int32(), *[pa.binary()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["node", "bins", "y", "rows", "times"])

    return table.blocks.mapInArrow(run, "node int, bins binary, y binary, rows binary, times binary")


def _received(group: pa.Table, width: int) -> tuple[np.ndarray, ...]:
    numbers = [np.frombuffer(b"".join(group[c].to_pylist()), np.int64) for c in ("y", "rows", "times")]
    bins = np.concatenate([np.frombuffer(b, np.uint8).reshape(width, -1) for b in group["bins"].to_pylist()], axis=1)
    order = np.argsort(numbers[1], kind="stable")
    return bins[:, order], *(a[order] for a in numbers)


def _waves(unit: Unit) -> list[Unit]:
    return [replace(unit, first=a, last=min(a + WAVE_TREES, unit.last)) for a in range(unit.first, unit.last, WAVE_TREES)]


def _grown(table: Binned, unit: Unit, weights: np.ndarray, local_bytes: int) -> DataFrame:
    """The nodes of a unit's trees, wave after wave."""
    width, n_bins, spark = len(table.features), _n_bins(table), table.blocks.sparkSession
    parts = []
    for wave in _waves(unit):
        upper, leaves, small = _split_upper(table, wave, weights, max(1, local_bytes // width))
        finish = _finisher(upper, wave.forest, weights, width, n_bins)
        inner = [(upper.tree[i], upper.path[i], upper.feature[i], upper.bin[i], upper.counts[i].tolist()) for i in range(len(upper.tree)) if i not in small]
        parts.append(spark.createDataFrame(inner, NODE))
        parts.append(stage(_shipped(table, wave, upper, small, False).groupBy("node").applyInArrow(finish, NODE), "grown"))
    return _union(parts)


def _finisher(upper: Upper, forest: Forest, weights: np.ndarray, width: int, n_bins: int):
    """What grows the rows of a node to the leaves."""
    tree, path = np.array(upper.tree), np.array(upper.path)

    def finish(group: pa.Table) -> pa.Table:
        at = group["node"][0].as_py()
        bins, y, _, times = _received(group, width)
        pairs = (np.zeros(len(y), np.int64), np.arange(len(y)), times)
        return pa.Table.from_batches([_node_batch(grow(bins, y, tree[at : at + 1], path[at : at + 1], pairs, forest, weights, n_bins))])

    return finish


def _voter(upper: Upper, leaves: set[int], forest: Forest, weights: np.ndarray, width: int, n_bins: int):
    """What grows the rows of a node and gives the votes for its test rows."""
    tree, path, classes = np.array(upper.tree), np.array(upper.path), len(weights)

    def finish(group: pa.Table) -> pa.Table:
        at = group["node"][0].as_py()
        bins, y, rows, times = _received(group, width)
        test = times == 0
        visit = Votes(bins[:, test], 1, classes)
        if at in leaves:
            share = upper.counts[at] * weights
            visit.sums += share / max(share.sum(), 1e-300)
        else:
            pairs = (np.zeros(int((~test).sum()), np.int64), np.flatnonzero(~test), times[~test])
            grow(bins, y, tree[at : at + 1], path[at : at + 1], pairs, forest, weights, n_bins, visit)
        return pa.table([pa.array(rows[test]), pa.array(y[test]), *(pa.array(visit.sums[:, c]) for c in range(classes))], ["row", "truth", *(f"v{c}" for c in range(classes))])

    return finish


def _votes(table: Binned, unit: Unit, weights: np.ndarray, local_bytes: int) -> DataFrame:
    """row, truth and summed votes of the unit's test rows; ``votes`` in the order of the classes."""
    width, n_bins, classes = len(table.features), _n_bins(table), len(weights)
    parts = []
    for wave in _waves(unit):
        upper, leaves, small = _split_upper(table, wave, weights, max(1, local_bytes // width))
        finish = _voter(upper, leaves, wave.forest, weights, width, n_bins)
        schema = "row long, truth long, " + ", ".join(f"v{c} double" for c in range(classes))
        ends = small | leaves
        parts.append(_shipped(table, wave, upper, ends, True).groupBy("node").applyInArrow(finish, schema))
    return _union(parts).groupBy("row", "truth").agg(*[F.sum(f"v{c}").alias(f"v{c}") for c in range(classes)])


def _confusion_of_votes(votes: DataFrame, unit: int) -> DataFrame:
    names = [c for c in votes.columns if c.startswith("v")]
    rounded = F.array(*[F.round(c, 9) for c in names])
    winner = F.array_position(rounded, F.array_max(rounded)) - 1
    counted = votes.groupBy(F.col("truth").cast("int").alias("truth"), winner.cast("int").alias("prediction")).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("unit", F.lit(unit))


# ---- models


@dataclass
class ForestModel:
    """Nodes of a forest as a table, and what is needed to score rows by it."""

    nodes: DataFrame
    forest: Forest | None
    features: list[str]
    edges: list[np.ndarray]
    labels: list
    weights: np.ndarray

    def shares(self, counts: np.ndarray) -> np.ndarray:
        """What a leaf adds to the votes of a row that reaches it, per class."""
        weighted = counts * self.weights
        return weighted / np.maximum(weighted.sum(axis=1, keepdims=True), 1e-300)

    def save(self, path: str) -> str:
        """Write nodes, feature order, bins and labels below ``path``."""
        about = {"kind": type(self).__name__, "features": self.features, "edges": [e.tolist() for e in self.edges], "labels": self.labels, "weights": self.weights.tolist()}
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        self.nodes.sparkSession.createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")
        return path

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ForestModel:
        """A stored model; one of boosted trees is read by ``BoostModel``."""
        about = json.loads(spark.read.parquet(f"{path}/about").first().about)
        if about["kind"] != cls.__name__:
            raise ValueError(f"{path} holds a {about['kind']}")
        edges = [np.array(e, float) for e in about["edges"]]
        return cls(spark.read.schema(NODE).parquet(f"{path}/nodes"), None, about["features"], edges, about["labels"], np.array(about["weights"]))

    def predict(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        """``df`` with the label of most votes; trees are brought to the rows, as many at a time as MODEL_BYTES holds."""
        sizes = {r.tree: r.n for r in self.nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).collect()}
        per_node = 20 + 8 * len(self.labels)
        groups, size = [[]], 0
        for tree in sorted(sizes):
            if size and size + sizes[tree] * per_node > MODEL_BYTES:
                groups.append([])
                size = 0
            groups[-1].append(tree)
            size += sizes[tree] * per_node
        spark, votes = df.sparkSession, "__votes"
        kept = [c for c in df.columns if c != output]
        out = df.select(*[df[f"`{c}`"] for c in kept], F.array(*[F.lit(0.0)] * len(self.labels)).alias(votes))
        edges, features = self.edges, self.features
        for group in groups:
            found = self.nodes.where(F.col("tree").isin(group)).toPandas().sort_values(["tree", "path"])
            shared = spark.sparkContext.broadcast(_arrays(found, self.shares(np.array(found["counts"].tolist(), float).reshape(-1, len(self.labels)))))
            schema = out.schema

            def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    last = batch.num_columns - 1  # the features as an array, added below
                    x = np.array(batch.column(last).flatten().fill_null(np.nan), float).reshape(batch.num_rows, len(features)).T
                    before = np.array(batch.column(last - 1).flatten(), float).reshape(batch.num_rows, -1)
                    sums = before + _vote(binned(x, edges), *shared.value)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, sums.size + 1, sums.shape[1]), pa.int32()), pa.array(sums.ravel()))
                    yield pa.RecordBatch.from_arrays([*batch.columns[: last - 1], lists], batch.schema.names[:last])

            x = F.array(*[F.col(f"`{f}`").cast("double") for f in features]).alias("__x")
            out = out.select("*", x).mapInArrow(run, schema)
        rounded = F.transform(votes, lambda v: F.round(v, 9))
        names = F.array(*[F.lit(v) for v in self.labels])
        label = F.element_at(names, F.array_position(rounded, F.array_max(rounded)).cast("int"))
        return out.select(*[F.col(f"`{c}`") for c in kept], label.alias(output))


def _arrays(nodes: pd.DataFrame, shares: np.ndarray) -> tuple[np.ndarray, ...]:
    """Roots, feature, bin, children and shares of the nodes, which come by tree and path."""
    place = {key: i for i, key in enumerate(zip(nodes["tree"], nodes["path"]))}
    left = np.array([place[t, 2 * p] if f >= 0 else -1 for t, p, f in zip(nodes["tree"], nodes["path"], nodes["feature"])])
    right = np.array([place[t, 2 * p + 1] if f >= 0 else -1 for t, p, f in zip(nodes["tree"], nodes["path"], nodes["feature"])])
    roots = np.flatnonzero(nodes["path"].to_numpy() == ROOT)
    return roots, nodes["feature"].to_numpy(), nodes["bin"].to_numpy(), left, right, shares


def _vote(bins: np.ndarray, roots, feature, cut, left, right, shares) -> np.ndarray:
    n = bins.shape[1]
    out = np.zeros((n, shares.shape[1]))
    for root in roots:
        node = np.full(n, root)
        moving = np.flatnonzero(left[node] >= 0)
        while len(moving):
            at = node[moving]
            node[moving] = np.where(bins[feature[at], moving] > cut[at], right[at], left[at])
            moving = moving[left[node[moving]] >= 0]
        out += shares[node]
    return out


def train(table: Binned, forest: Forest, weighted: bool = False, fold: int | None = None, local_bytes: int = LOCAL_BYTES) -> ForestModel:
    """One forest on the rows of a fold's training part, or on all rows."""
    weights = table.weights(fold, weighted)
    whole = Unit(0, forest, fold, 0, forest.num_trees)
    if table.bytes <= local_bytes:
        units = [replace(whole, number=i, first=a, last=min(a + UNIT_TREES, whole.last)) for i, a in enumerate(range(0, whole.last, UNIT_TREES))]
        nodes = _local(table, units, {fold: weights}, _nodes, NODE)
    else:
        nodes = _grown(table, whole, weights, local_bytes)
    return ForestModel(nodes, forest, table.features, table.edges, table.labels, weights)
