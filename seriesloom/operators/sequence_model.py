"""Classifying windows of rows by what happens in them, in which order, and whose they are.

Filters that are shared by all steps look at a few neighbouring rows each; their outputs are
averaged within consecutive parts of the window, so that early, middle and late stay
apart, and the last step is seen by itself. An entity has an embedding. A hidden layer
joins both, and softmax gives the classes.

Training: windows are standardised per column and written once in blocks of arrays. In each
round every task goes through its blocks in small batches from the shared
parameters (Adam), and parameters and moments are averaged by the number of windows,
over two levels of tasks, before the driver has them. The result depends on the seed and the
blocks alone. Parameters are small: filters, hidden layer, and a row per entity for at most
``most_entities``, the first in order; all others, and those not seen in training, share
a row, which learns from a few windows of every entity.

Missing values are the column's mean. Windows without a label train nothing, but are scored.
Windows must have the same length and columns. Extra columns are kept when scoring. No
labelled window is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.staging import stage

BLOCK_WINDOWS = 4096
SUMMED = 64  # states that a task averages
BETA, MOMENT = 0.9, 0.999
SHARED_ENTITY = 0.05  # of windows train the row of unknown entities


@dataclass(frozen=True)
class Shape:
    """Sizes of the network."""

    length: int
    columns: int
    entities: int
    classes: int
    width: int = 3
    filters: int = 24
    parts: int = 4
    embedding: int = 6
    hidden: int = 32

    def shapes(self) -> dict[str, tuple[int, ...]]:
        joined = self.filters * (min(self.parts, self.steps) + 1) + self.embedding
        return {
            "filters": (self.width_used * self.columns, self.filters),
            "filters_0": (self.filters,),
            "entity": (self.entities + 1, self.embedding),
            "hidden": (joined, self.hidden),
            "hidden_0": (self.hidden,),
            "out": (self.hidden, self.classes),
            "out_0": (self.classes,),
        }

    @property
    def width_used(self) -> int:
        return min(self.width, self.length)

    @property
    def steps(self) -> int:
        return self.length - self.width_used + 1

    def split(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in self.shapes().items():
            size = int(np.prod(shape))
            out[name] = flat[at : at + size].reshape(shape)
            at += size
        return out

    def start(self, seed: int) -> np.ndarray:
        r = np.random.default_rng(seed)
        parts = []
        for name, shape in self.shapes().items():
            scale = 0.0 if name.endswith("_0") else 0.1 if name == "entity" else np.sqrt(2 / shape[0])
            parts.append(r.normal(0, 1, shape).ravel() * scale)
        return np.concatenate(parts)

    def pooling(self) -> np.ndarray:
        """Which share of each step goes to each part, and the last step alone: parts + 1 x steps."""
        out = np.zeros((min(self.parts, self.steps) + 1, self.steps))
        for i, some in enumerate(np.array_split(np.arange(self.steps), min(self.parts, self.steps))):
            out[i, some] = 1 / len(some)
        out[-1, -1] = 1
        return out


def forward(shape: Shape, p: dict, x: np.ndarray, entity: np.ndarray) -> tuple:
    """Class shares of windows (n x length x columns), and what the gradient needs."""
    n, width = len(x), shape.width_used
    seen = np.concatenate([x[:, i : i + shape.steps] for i in range(width)], axis=2)
    found = np.maximum(seen @ p["filters"] + p["filters_0"], 0)
    pooled = np.einsum("ps,nsf->npf", shape.pooling(), found).reshape(n, -1)
    joined = np.concatenate([pooled, p["entity"][entity]], axis=1)
    hidden = np.maximum(joined @ p["hidden"] + p["hidden_0"], 0)
    scores = hidden @ p["out"] + p["out_0"]
    shares = np.exp(scores - scores.max(axis=1, keepdims=True))
    return shares / shares.sum(axis=1, keepdims=True), (seen, found, joined, hidden)


def gradient(shape: Shape, flat: np.ndarray, x: np.ndarray, entity: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float) -> np.ndarray:
    """Of the mean weighted log loss and l2 / 2 times the squared parameters."""
    p = shape.split(flat)
    shares, (seen, found, joined, hidden) = forward(shape, p, x, entity)
    g = {}
    error = shares.copy()
    error[np.arange(len(y)), y] -= 1
    error *= (weight / weight.sum())[:, None]
    g["out"], g["out_0"] = hidden.T @ error, error.sum(axis=0)
    error = (error @ p["out"].T) * (hidden > 0)
    g["hidden"], g["hidden_0"] = joined.T @ error, error.sum(axis=0)
    error = error @ p["hidden"].T
    g["entity"] = np.zeros_like(p["entity"])
    np.add.at(g["entity"], entity, error[:, -shape.embedding :])
    pooled = error[:, : -shape.embedding].reshape(len(y), -1, shape.filters)
    error = np.einsum("ps,npf->nsf", shape.pooling(), pooled) * (found > 0)
    g["filters"] = np.einsum("nsc,nsf->cf", seen, error)
    g["filters_0"] = error.sum(axis=(0, 1))
    return np.concatenate([g[name].ravel() for name in shape.shapes()]) + l2 * flat


def pass_over(shape: Shape, state: np.ndarray, steps: int, block: tuple, batch: int, rate: float, l2: float, r: np.random.Generator) -> tuple[np.ndarray, int]:
    """Parameters and moments after one pass over a block; ``steps`` counts batches for Adam."""
    x, entity, y, weight = block
    size = len(state) // 3
    flat, first, second = state[:size].copy(), state[size : 2 * size].copy(), state[2 * size :].copy()
    order = r.permutation(len(y))
    owners = np.where(r.random(len(y)) < SHARED_ENTITY, 0, entity)
    for a in range(0, len(y), batch):
        some = order[a : a + batch]
        if weight[some].sum() <= 0:
            continue
        g = gradient(shape, flat, x[some], owners[some], y[some], weight[some], l2)
        steps += 1
        first += (1 - BETA) * (g - first)
        second += (1 - MOMENT) * (g * g - second)
        flat -= rate * (first / (1 - BETA**steps)) / (np.sqrt(second / (1 - MOMENT**steps)) + 1e-8)
    return np.concatenate([flat, first, second]), steps


@dataclass
class SequenceModel:
    shape: Shape
    flat: np.ndarray
    mean: np.ndarray
    deviation: np.ndarray
    entities: list
    labels: list
    entity: str
    sequence: str

    def predict(self, df: DataFrame, output: str = "prediction", probability: str = "probability") -> DataFrame:
        """``df`` with the likeliest label and its share."""
        shape, flat, mean, deviation, labels = self.shape, self.flat, self.mean, self.deviation, self.labels
        kept = [c for c in df.columns if c not in (output, probability)]
        rows = df.select(*[df[f"`{c}`"] for c in kept], _values(self.sequence).alias("__x"), _code(self.entity, self.entities).alias("__entity"))
        schema = df.select(*[df[f"`{c}`"] for c in kept]).withColumns({output: F.lit(None).cast("int"), probability: F.lit(None).cast("double")}).schema

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _windows(batch.column(batch.num_columns - 2), shape, mean, deviation)
                shares, _ = forward(shape, shape.split(flat), x, np.array(batch.column(batch.num_columns - 1), np.int64))
                found = [pa.array(shares.argmax(axis=1) + 1, pa.int32()), pa.array(shares.max(axis=1), pa.float64())]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *found], [*kept, output, probability])

        scored = rows.mapInArrow(run, schema)
        names = F.array(*[F.lit(v) for v in labels])
        return scored.withColumn(output, F.element_at(names, F.col(output)))


def _values(sequence: str) -> Column:
    return F.transform(F.flatten(sequence), lambda v: v.cast("double"))


def _code(entity: str, entities: list) -> Column:
    """Place of an entity's row, 0 for all that have none."""
    if not entities:
        return F.lit(0)
    known = F.create_map(*[F.lit(x) for i, e in enumerate(entities) for x in (e, i + 1)])
    return F.coalesce(F.element_at(known, F.col(entity)), F.lit(0))


def _windows(column: pa.Array, shape: Shape, mean: np.ndarray, deviation: np.ndarray) -> np.ndarray:
    x = np.array(column.flatten().fill_null(np.nan), float).reshape(len(column), shape.length, shape.columns)
    x = (x - mean) / deviation
    return np.where(np.isfinite(x), np.clip(x, -10, 10), np.where(np.isnan(x), 0, np.sign(x) * 10))


def _moments(rows: DataFrame, columns: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each column over all steps of all windows, infinities left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, columns))
        for batch in batches:
            x = np.array(batch.column(0).flatten().fill_null(np.nan), float).reshape(-1, columns)
            known = np.isfinite(x)
            x = np.where(known, x, 0)
            sums += np.stack([known.sum(axis=0), x.sum(axis=0), (x * x).sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(3 * columns), pa.int32()), pa.array(sums.ravel())], ["at", "value"])

    found = rows.select("x").mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    n, total, squares = np.array([r.value for r in sorted(found, key=lambda r: r.at)]).reshape(3, columns)
    n = np.maximum(n, 1)
    deviation = np.sqrt(np.maximum(squares / n - (total / n) ** 2, 0))
    return total / n, np.where(deviation > 1e-12, deviation, 1)


def train(
    df: DataFrame,
    entity: str,
    label: str,
    sequence: str = "seq",
    rounds: int = 60,
    batch: int = 64,
    rate: float = 0.02,
    l2: float = 1e-4,
    weighted: bool = False,
    most_entities: int = 1 << 16,
    seed: int = 42,
    **sizes,
) -> SequenceModel:
    """Learn to tell the label of a window from its rows and its entity; ``sizes`` are those of ``Shape``."""
    known = df.where(F.col(label).isNotNull() & F.col(sequence).isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy(label).agg(F.count(F.lit(1))).collect()}
    if not counts:
        raise ValueError(f"no window has a {label}")
    labels = sorted(counts)
    entities = [r[0] for r in known.select(entity).where(F.col(entity).isNotNull()).distinct().orderBy(entity).limit(most_entities).collect()]
    length, columns = known.select(F.size(sequence), F.size(F.col(sequence)[0])).first()
    shape = Shape(length, columns, len(entities), len(labels), **sizes)
    code = F.element_at(F.create_map(*[F.lit(x) for i, v in enumerate(labels) for x in (v, i)]), F.col(label))
    tasks = max(1, sum(counts.values()) // BLOCK_WINDOWS)  # few windows in a task would be averaged before they have taught it
    rows = stage(known.repartition(tasks).select(_values(sequence).alias("x"), _code(entity, entities).cast("int").alias("entity"), code.cast("int").alias("y")), "windows")
    mean, deviation = _moments(rows, columns)
    per_class = np.array([sum(counts.values()) / (len(labels) * counts[v]) if weighted else 1.0 for v in labels])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        for some in batches:
            for first in range(0, some.num_rows, BLOCK_WINDOWS):
                part = some.slice(first, BLOCK_WINDOWS)
                x = _windows(part.column(0), shape, mean, deviation)
                arrays = [x.astype(np.float32), np.array(part.column(1), np.int32), np.array(part.column(2), np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *(pa.array([a.tobytes()], pa.binary()) for a in arrays)], ["number", "x", "entity", "y"])
                number += 1

    blocks = stage(rows.mapInArrow(pack, "number long, x binary, entity binary, y binary"), "blocks")
    flat = shape.start(seed)
    state, steps = np.concatenate([flat, np.zeros(2 * len(flat))]), 0
    for number in range(rounds):
        state, steps = _round(blocks, shape, state, steps, per_class, batch, rate * 0.5 * (1 + np.cos(np.pi * number / rounds)), l2, (seed, number))
    return SequenceModel(shape, state[: len(flat)], mean, deviation, entities, labels, entity, sequence)


def _round(blocks: DataFrame, shape: Shape, state: np.ndarray, steps: int, per_class: np.ndarray, batch: int, rate: float, l2: float, seed: tuple) -> tuple[np.ndarray, int]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at, n = state, steps, 0
        for some in batches:
            for number, x, entity, y in zip(*(some.column(i).to_pylist() for i in range(4))):
                y = np.frombuffer(y, np.int32).astype(np.int64)
                x = np.frombuffer(x, np.float32).reshape(len(y), shape.length, shape.columns).astype(float)
                block = (x, np.frombuffer(entity, np.int32).astype(np.int64), y, per_class[y])
                own, at = pass_over(shape, own, at, block, batch, rate, l2, np.random.default_rng((*seed, number)))
                n += len(y)
        if n:
            yield _state(TaskContext.get().partitionId() // SUMMED, own, at, n)

    def mean(group: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_state(group["salt"][0].as_py(), *_mean(group.to_pylist()))])

    schema = "salt int, state binary, steps double, n long"
    parts = blocks.mapInArrow(run, schema).groupBy("salt").applyInArrow(mean, schema).collect()
    state, steps, _ = _mean([r.asDict() for r in sorted(parts, key=lambda r: r.salt)])
    return state, round(steps)


def _state(salt: int, state: np.ndarray, steps: float, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([salt], pa.int32()), pa.array([state.tobytes()], pa.binary()), pa.array([float(steps)]), pa.array([n], pa.int64())], ["salt", "state", "steps", "n"])


def _mean(rows: list[dict]) -> tuple[np.ndarray, float, int]:
    """Averages by number of windows; in an order of its own, so that sums are the same each time."""
    rows = sorted(rows, key=lambda r: bytes(r["state"]))
    n = sum(r["n"] for r in rows)
    state = sum(np.frombuffer(bytes(r["state"])) * (r["n"] / n) for r in rows)
    return state, sum(r["steps"] * (r["n"] / n) for r in rows), n
