"""Hard negatives by exact integer scores, looked up in tables of subset sums (Four Russians).

A component x becomes floor(256 * x). A candidate's components are cut into bit planes
(two's complement), and each plane into bytes of eight dimensions. For an anchor and
eight dimensions there are 256 possible sums of the anchor's components over a
subset of them: a table, indexed by the candidate's byte, gives a plane's share of the
score. Planes are added by shifting, the sign's plane counts negative. The result is the
full inner product; nothing is approximated or left out.

Anchors in blocks meet all candidates in chunks, each pair of a block and a chunk in a
group of its own, so no task holds more than one block and one chunk whatever one label,
vector or id occurs. Positives are searched among the rows of the anchor's label, in
blocks and chunks of that label; with their scores known, negatives are searched
among all rows. A group passes on the first ``k`` of each anchor only, and these are
merged by rank.

Rows with a null id, label or vector, with a null or non-finite component or one that
no long holds take no part. Shorter vectors count as ending in zeros, an empty one scores
0. Scores are right where a long holds them. Rows with the anchor's id are not among its
others. Repeated anchors (same id, label and vector) count once; other repeated
rows each take a place. Equal scores are in order of the ids. Extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.staging import stage
from .batches import bound_batches

SCALE = 256
POSITIVES = NEGATIVES = 5
LEAST_SHARE = (80, 100)  # a negative's score lies between this share of the positive's and all of it
CHUNK = 1024  # candidates in a group
BLOCK, TABLE_BYTES = 512, 16 << 20  # anchors in a group, as far as their tables fit
SLICE = 128  # candidates scored at a time


def packed(rows: DataFrame, dims: int, planes: int) -> DataFrame:
    """row, vec_id, label and the vector's planes as bytes; ``rows`` has vec_id, label and vec."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, kept = whole(batch.column(3), dims)
            data = [p.tobytes() for p in pack(values, planes)]
            columns = [c.filter(pa.array(kept)) for c in batch.columns[:3]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(data, pa.binary())], ["row", "vec_id", "label", "planes"])

    bound_batches(rows.sparkSession)
    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "vec")
    return numbered.mapInArrow(run, "row long, vec_id long, label long, planes binary")


def whole(vectors: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """floor(256 * x) of the usable vectors as rows of ``dims`` numbers, and which are usable."""
    lengths = np.asarray(vectors.value_lengths().fill_null(0), np.int64)
    flat = vectors.flatten()
    x = np.asarray(flat.cast(pa.float64()).fill_null(np.nan), float)
    with np.errstate(invalid="ignore", over="ignore"):
        x = np.floor(SCALE * x)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    bad = ~(np.abs(x) < 2.0**63)
    kept = np.asarray(vectors.is_valid())
    kept[owner[bad]] = False
    out = np.zeros((len(lengths), dims), np.int64)
    place = np.arange(len(x)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    use = kept[owner] & (place < dims)
    out[owner[use], place[use]] = x[use].astype(np.int64)
    return out[kept], kept


def pack(values: np.ndarray, planes: int) -> np.ndarray:
    """Bit planes of whole numbers: rows x planes x groups of eight dimensions, one byte each."""
    groups = -(-values.shape[1] // 8)
    out = np.zeros((len(values), planes, groups), np.uint8)
    for p in range(planes if groups else 0):
        out[:, p] = np.packbits(((values >> p) & 1).astype(np.uint8), axis=1, bitorder="little")
    return out


def unpack(planes: np.ndarray) -> np.ndarray:
    """The whole numbers again, with a multiple of eight dimensions."""
    n, count, groups = planes.shape
    out = np.zeros((n, 8 * groups), np.int64)
    for p in range(count):
        bits = np.unpackbits(planes[:, p], axis=1, bitorder="little").astype(np.int64)
        out = out - (bits << p) if p == count - 1 else out + (bits << p)
    return out


def tables(anchors: np.ndarray, kind: type) -> np.ndarray:
    """Sums of every subset of eight dimensions, per anchor: groups x 256 x anchors."""
    n, dims = anchors.shape
    out = np.zeros((dims // 8, 256, n), kind)
    for group in range(dims // 8):
        for bit in range(8):
            size = 1 << bit
            out[group, size : 2 * size] = out[group, :size] + anchors[:, 8 * group + bit].astype(kind)
    return out


def scores(sums: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Inner products of candidates (rows) and anchors (columns), by lookups, shifts and adds."""
    n, count, groups = planes.shape
    out = np.zeros((n, sums.shape[2]), sums.dtype)
    looked = np.empty((SLICE, sums.shape[2]), sums.dtype)
    for first in range(0, n, SLICE):
        part = planes[first : first + SLICE].astype(np.intp)
        total, found = out[first : first + SLICE], looked[: len(part)]
        for p in range(count - 1, -1, -1):
            total += total
            for group in range(groups):
                np.take(sums[group], part[:, p, group], axis=0, out=found, mode="clip")
                if p == count - 1:
                    total -= found
                else:
                    total += found
    return out


def first(values: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest values in order; of equal ones those that come first."""
    if len(values) <= k:
        return np.argsort(~values, kind="stable")
    limit = np.partition(values, len(values) - k)[len(values) - k]
    places = np.flatnonzero(values >= limit)
    return places[np.argsort(~values[places], kind="stable")[:k]]


def _bytes(column: pa.ChunkedArray, planes: int, groups: int) -> np.ndarray:
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, np.uint8).reshape(len(column), planes, groups)


def _scored(anchors: pa.Table, others: pa.Table, planes: int, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores, ids and labels of the candidates of a group in order of their ids."""
    ids = others["vec_id"].to_numpy()
    order = np.argsort(ids, kind="stable")
    held = _bytes(others["planes"], planes, groups)[order]
    values = unpack(_bytes(anchors["planes"], planes, groups))
    most = int(np.abs(values.astype(float)).sum(axis=1).max(initial=0)) << planes
    return scores(tables(values, np.int32 if most < 1 << 30 else np.int64), held), ids[order], others["label"].to_numpy()[order]


def _cells(anchors: DataFrame, others: DataFrame, by: list[str], blocks: Column, chunks: Column):
    """Both sides dealt to cells (by, block, chunk), each anchor to all chunks, each candidate to all blocks."""
    spread = lambda salt: F.xxhash64("row", F.lit(salt))
    span = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    left = anchors.withColumn("block", F.pmod(spread(1), blocks)).withColumn("chunk", span(chunks))
    right = others.withColumn("chunk", F.pmod(spread(2), chunks)).withColumn("block", span(blocks))
    keys = [*by, "block", "chunk"]
    return left.drop("blocks", "chunks").groupBy(*keys).cogroup(right.drop("blocks", "chunks").groupBy(*keys))


def _ranked(found: DataFrame, keys: list[str], score: str, name: str, k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col(score).desc(), name)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    rows: DataFrame,
    is_anchor: Column,
    vec_id: str = "vec_id",
    label: str | Column = "label",
    vector: str = "embedding",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    chunk: int = CHUNK,
    block: int = BLOCK,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor`` is a condition on the column ``vec_id`` and ``label`` of the result's rows.
    """
    named = rows.select(
        F.col(vec_id).cast("long").alias("vec_id"), (F.col(label) if isinstance(label, str) else label).cast("long").alias("label"), F.col(vector).alias("vec")
    ).where("vec_id IS NOT NULL AND label IS NOT NULL AND vec IS NOT NULL")
    sound = F.filter("vec", lambda x: F.abs(F.lit(SCALE) * x.cast("double")) < 2.0**63)  # null and NaN go too
    dims, low, high = named.agg(F.max(F.size("vec")), F.min(F.array_min(sound)), F.max(F.array_max(sound))).first()
    dims = max(dims or 0, 0)
    groups = -(-dims // 8)
    reach = max(-int(np.floor(SCALE * float(low or 0))), int(np.floor(SCALE * float(high or 0))) + 1, 1)
    planes = min(64, (reach - 1).bit_length() + 1)
    block = max(1, min(block, TABLE_BYTES // max(1, groups * 256 * 4)))

    table = stage(packed(named, dims, planes), "vectors")
    anchors = stage(table.where(is_anchor).dropDuplicates(["vec_id", "label", "planes"]), "anchors")

    # positives: blocks and chunks of each label that has anchors
    ceil = lambda n, size: F.ceil(n / F.lit(size)).cast("long")
    wanted = anchors.groupBy("label").agg(ceil(F.count(F.lit(1)), block).alias("blocks"))
    sizes = wanted.join(table.groupBy("label").agg(ceil(F.count(F.lit(1)), chunk).alias("chunks")), "label")
    same = _cells(anchors.join(sizes, "label"), table.join(sizes, "label"), ["label"], F.col("blocks"), F.col("chunks"))

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        out = []
        if len(a) and len(b):
            found, ids, _ = _scored(a, b, planes, groups)
            for i, (row, own) in enumerate(zip(a["row"].to_pylist(), a["vec_id"].to_pylist())):
                others = np.flatnonzero(ids != own)
                score = found[others, i].astype(np.int64)
                out += [(row, int(ids[others[j]]), int(score[j])) for j in first(score, positives)]
        return _table(out, ["row", "positive_id", "positive_score"])

    near = _ranked(same.applyInArrow(best, "row long, positive_id long, positive_score long"), ["row"], "positive_score", "positive_id", positives)
    listed = near.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("rank", "positive_id", "positive_score"))).alias("near"))
    asking = anchors.join(listed, "row").select(
        "row", "vec_id", "label", "planes", F.col("near.positive_id").alias("positive_ids"), F.col("near.positive_score").alias("positive_scores")
    )
    asking = stage(asking, "positives")

    n_anchors, n_rows = asking.count(), table.count()
    blocks, chunks = (F.lit(max(1, -(-n // size))).cast("long") for n, size in ((n_anchors, block), (n_rows, chunk)))
    all_pairs = _cells(asking, table, [], blocks, chunks)
    least, whole_share = LEAST_SHARE

    def hard(a: pa.Table, b: pa.Table) -> pa.Table:
        out = []
        if len(a) and len(b):
            found, ids, labels = _scored(a, b, planes, groups)
            columns = [a[c].to_pylist() for c in ("row", "vec_id", "label", "positive_ids", "positive_scores")]
            for i, (row, own, kind, near_ids, near_scores) in enumerate(zip(*columns)):
                lows = [-((-least * s) // whole_share) for s in near_scores]
                column = found[:, i]
                places = np.flatnonzero((column >= min(lows)) & (column <= max(near_scores)) & (labels != kind))
                score = column[places].astype(np.int64)
                for nth, (positive, low_score, high_score) in enumerate(zip(near_ids, lows, near_scores)):
                    inside = np.flatnonzero((score >= low_score) & (score <= high_score))
                    for j in inside[first(score[inside], negatives)]:
                        out.append((row, nth, own, positive, int(ids[places[j]]), high_score, int(score[j])))
        return _table(out, ["row", "nth", "anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])

    schema = "row long, nth long, anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long"
    kept = _ranked(all_pairs.applyInArrow(hard, schema), ["row", "nth"], "negative_score", "negative_id", negatives)
    return kept.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _table(rows: list[tuple], names: list[str]) -> pa.Table:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.table([pa.array(c, pa.int64()) for c in columns], names)
