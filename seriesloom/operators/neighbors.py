"""Exact nearest neighbours of the same class.

Rows are grouped into cells around pivots, and large cells are split at random
into blocks of bounded size. A row's distance to the blocks' pivots bounds how
near a neighbour in them can be (triangle inequality), so most blocks are never
looked at, and no pair leaves the task that found it unless it is among the
best of its block. In many dimensions with little structure that approaches all
blocks; ``neighbor_tree`` bounds the cost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.staging import stage

BLOCK = ["cls", "cell", "salt"]
MAX_PIVOT_VALUES = 8_000_000
REQUESTS = 50_000
# rounding may make a computed bound this much too small
SLACK = 1e-9


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of ``a`` to all rows of ``b``.

    From differences, so that equal rows have distance 0 exactly; in slices, so
    that memory stays small.
    """
    out = np.empty((len(a), len(b)))
    step = max(1, 4_000_000 // max(1, b.size))
    for i in range(0, len(a), step):
        diff = a[i : i + step, None, :] - b[None, :, :]
        out[i : i + step] = np.sqrt(np.einsum("ijk,ijk->ij", diff, diff))
    return out


def matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(float)


def best(qid: np.ndarray, queries: np.ndarray, mid: np.ndarray, members: np.ndarray, k: int):
    """Up to ``k`` nearest members of each query, itself left out, as arrays."""
    d = distances(queries, members)
    d[qid[:, None] == mid[None, :]] = np.inf
    keep = min(k, d.shape[1])
    nearest = np.argpartition(d, keep - 1, axis=1)[:, :keep]
    dist = np.take_along_axis(d, nearest, axis=1)
    ids = np.repeat(qid, keep)
    found = np.isfinite(dist.ravel())
    return ids[found], mid[nearest].ravel()[found], dist.ravel()[found]


def choose_pivots(rows: DataFrame, per_class: int, seed: int) -> dict:
    """About ``per_class`` rows of each class, one at least, as arrays on the driver.

    Rows whose hash lies below a threshold set by the class's size: no task sees
    more than its own. Pivots hold at most about MAX_PIVOT_VALUES numbers; with many
    classes or wide vectors there are fewer per class.
    """
    spread = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30))
    first = F.min_by("vec", F.struct(spread, "id"))
    classes = rows.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), first.alias("first")).collect()
    by_class = {r.cls: [r.first] for r in classes}
    width = max((len(r.first) for r in classes), default=1)
    wanted = max(1, min(per_class, MAX_PIVOT_VALUES // max(1, len(classes) * width)))
    if wanted > 1:
        limits = spark_map({r.cls: min(1.0, wanted / r.n) for r in classes}, rows.schema["cls"].dataType)
        picked = rows.where(spread < limits[F.col("cls")] * float(1 << 30)).select("cls", "vec")
        for r in picked.toLocalIterator():
            by_class[r.cls].append(r.vec)
    return {c: np.unique(np.array(v, dtype=float), axis=0) for c, v in by_class.items()}


def spark_map(values: dict, key_type) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k).cast(key_type), F.lit(v))])


def nearest_in_class(
    rows: DataFrame,
    k: int,
    pivots_per_class: int = 128,
    block_rows: int = 1024,
    seed: int = 42,
) -> DataFrame:
    """The ``k`` nearest rows of the same class for every row with ``is_query``.

    ``rows`` has ``id`` (bigint, unique), ``cls``, ``vec`` (array<double>) and
    ``is_query``. Result: ``id, nid, dist, nth`` with ``nth`` from 1; fewer than
    ``k`` rows where the class is smaller. Among equally distant rows at the
    edge any may be taken.
    """
    spark = rows.sparkSession
    pivots = spark.sparkContext.broadcast(choose_pivots(rows, pivots_per_class, seed))
    cls_type = rows.schema["cls"].dataType.simpleString()
    base = f"id bigint, cls {cls_type}, vec array<double>, is_query boolean"

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.assign(cell=0, dist=0.0)
            for cls, part in pdf.groupby("cls"):
                d = distances(matrix(part["vec"]), pivots.value[cls])
                pdf.loc[part.index, "cell"] = d.argmin(axis=1)
                pdf.loc[part.index, "dist"] = d.min(axis=1)
            yield pdf

    columns = rows.select("id", "cls", "vec", "is_query")
    placed = columns.mapInPandas(assign, f"{base}, cell int, dist double")
    placed = stage(placed, "cells")
    # one row per pivot at most
    cells = placed.groupBy("cls", "cell").agg(
        F.count(F.lit(1)).alias("size"), F.max("dist").alias("radius")
    )
    salts = F.ceil(F.col("size") / block_rows).cast("int")
    cells = cells.withColumn("salts", salts)
    table: dict = {}
    for r in cells.collect():
        table.setdefault(r.cls, []).append((r.cell, r.size, r.radius, r.salts))
    layout = spark.sparkContext.broadcast(
        {c: tuple(np.array(col) for col in zip(*sorted(v))) for c, v in table.items()}
    )
    own_salt = F.pmod(F.xxhash64("id", F.lit(seed)), F.col("salts")).cast("int")
    blocked = placed.join(
        F.broadcast(cells.select("cls", "cell", "salts")), ["cls", "cell"]
    ).select("id", "cls", "vec", "is_query", "cell", own_salt.alias("salt"))

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        asking = pdf[pdf["is_query"]]
        if asking.empty:
            return pd.DataFrame({"id": [], "nid": [], "dist": []})
        ids, nids, dist = best(
            asking["id"].to_numpy(),
            matrix(asking["vec"]),
            pdf["id"].to_numpy(),
            matrix(pdf["vec"]),
            k,
        )
        return pd.DataFrame({"id": ids, "nid": nids, "dist": dist})

    found_schema = "id bigint, nid bigint, dist double"
    near = stage(blocked.groupBy(*BLOCK).applyInPandas(inside, found_schema), "near")
    bounds = near.groupBy("id").agg(
        F.when(F.count(F.lit(1)) >= k, F.max("dist")).alias("bound")
    )
    asking = blocked.where("is_query").join(bounds, "id", "left")
    asking = asking.where(F.col("bound").isNull() | (F.col("bound") > 0)).drop("is_query")

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The other blocks that may hold a nearer row than the bound."""
        for pdf in batches:
            for cls, part in pdf.groupby("cls"):
                cell, size, radius, salts = layout.value[cls]
                to_pivot = distances(matrix(part["vec"]), pivots.value[cls][cell])
                reach = to_pivot + radius
                order = np.argsort(reach, axis=1)
                enough = size[order].cumsum(axis=1) > k
                at = enough.argmax(axis=1)
                nth = np.take_along_axis(reach, order, axis=1)[np.arange(len(part)), at]
                by_cells = np.where(enough.any(axis=1), nth, np.inf)
                bound = np.fmin(part["bound"].to_numpy(dtype=float), by_cells)
                limit = bound * (1 + SLACK) + SLACK
                promising = to_pivot - radius < limit[:, None]
                row, col = np.nonzero(promising)
                ends = salts[col].cumsum()
                # one request per block of each cell, in pieces of bounded size
                for first in range(0, int(ends[-1]) if len(ends) else 0, REQUESTS):
                    place = np.arange(first, min(first + REQUESTS, ends[-1]))
                    pair = np.searchsorted(ends, place, side="right")
                    asker, target = part.iloc[row[pair]], cell[col[pair]]
                    salt = place - (ends - salts[col])[pair]
                    own = (asker["cell"].to_numpy() == target) & (asker["salt"].to_numpy() == salt)
                    out = pd.DataFrame(
                        {
                            "id": asker["id"].to_numpy(),
                            "cls": cls,
                            "vec": asker["vec"].to_numpy(),
                            "cell": target,
                            "salt": salt,
                        }
                    )
                    yield out[~own]

    asked_schema = f"id bigint, cls {cls_type}, vec array<double>, cell int, salt int"
    asked = stage(asking.mapInPandas(route, asked_schema), "asked")
    # a block many rows ask for is copied, so that no group exceeds a block's size
    parts = asked.groupBy(*BLOCK).agg(
        F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("parts")
    )
    part = F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.col("parts")).cast("int")
    questions = asked.join(parts, BLOCK).withColumn("part", part).drop("parts")
    copies = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    members = blocked.drop("is_query").join(parts, BLOCK).select("id", "vec", *BLOCK, copies)

    def across(q: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        if q.empty or m.empty:
            return pd.DataFrame({"id": [], "nid": [], "dist": []})
        ids, nids, dist = best(
            q["id"].to_numpy(), matrix(q["vec"]), m["id"].to_numpy(), matrix(m["vec"]), k
        )
        return pd.DataFrame({"id": ids, "nid": nids, "dist": dist})

    keys = [*BLOCK, "part"]
    far = questions.groupBy(*keys).cogroup(members.groupBy(*keys)).applyInPandas(
        across, found_schema
    )
    nth = F.row_number().over(Window.partitionBy("id").orderBy("dist", "nid"))
    return near.unionByName(far).withColumn("nth", nth).where(F.col("nth") <= k)
