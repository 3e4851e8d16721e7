"""Near neighbours of the same class by a two-level tree of pivots, at a cost per row that depends on no size.

Equal rows become one point. A class of n points gets about n / leaf_rows leaves around
pivots chosen by a hash, and the square root of that many upper pivots. A point goes
to its nearest upper pivot and there to the nearest pivot of a leaf, so each task compares with the
square root of the number of leaves twice, and a leaf has about ``leaf_rows`` points however
many there are: dense places have more pivots. Only upper pivots are broadcast; their number
grows with the root of the class (50,000 rows of them stand for a million million).

A row that asks looks into the ``probes`` leaves with the nearest pivots, found below
its nearest upper pivots. Leaves of an upper pivot are searched in bunches, so a row is sent to
a bunch once, not to each of its leaves. By default these are two per dimension, eight at least: with
that, tests on rows without any structure find more than nine tenths of the true
neighbours, at any number of leaves. A class with one leaf is searched exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.staging import stage
from .neighbors import best, distances, matrix, spark_map

LEAF_ROWS = 512
PART_ROWS = 8192  # dealt to leaves in a task
BUNCH_LEAVES = 32  # of an upper pivot, searched together
HELD_ROWS, CELL_ROWS = 32768, 16384  # of a bunch, and asking it, in a task
LEAST_PROBES, PROBES_PER_DIMENSION = 8, 2
MOST_UPPER = 16  # upper pivots below which a row looks for leaves
SPREAD = 1 << 40


def _share(seed: int, what: str) -> Column:
    """A number in [0, 1) from a hash of the point."""
    return F.pmod(F.xxhash64("pid", F.lit(seed), F.lit(what)), F.lit(SPREAD)) / F.lit(float(SPREAD))


def points_of(rows: DataFrame, k: int) -> DataFrame:
    """Distinct rows: pid (an id of theirs), cls, vec, is_query of any, and at most k + 1 of their ids."""
    same = Window.partitionBy("cls", "vec").orderBy(F.desc("is_query"), "id")
    few = rows.withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= k + 1)
    points = few.groupBy("cls", "vec").agg(F.max("is_query").alias("is_query"), F.array_sort(F.collect_list("id")).alias("ids"))
    return points.select(F.col("ids")[0].alias("pid"), "cls", "vec", "is_query", "ids")


def near_in_class(rows: DataFrame, k: int, leaf_rows: int = LEAF_ROWS, probes: int | None = None, seed: int = 42) -> DataFrame:
    """About the ``k`` nearest rows of the same class for every row with ``is_query``.

    ``rows`` has ``id`` (bigint, unique), ``cls``, ``vec`` (array<double>) and
    ``is_query``. Result: ``id, nid, dist, nth`` with ``nth`` from 1; fewer than
    ``k`` rows only where fewer are in the leaves. Equal rows have distance 0.
    """
    points = stage(points_of(rows, k), "points")
    found = points.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dims"), F.min("pid").alias("first")).collect()
    if not found:
        return rows.select("id", F.col("id").alias("nid"), F.lit(0.0).alias("dist"), F.lit(0).alias("nth")).limit(0)
    leaves = {r.cls: -(-r.n // leaf_rows) for r in found}
    if max(leaves.values()) == 1:
        one = spark_map({r.cls: r.first for r in found}, points.schema["cls"].dataType)[F.col("cls")]
        members = points.select(one.alias("bunch"), one.alias("leaf"), "pid")
        asked = points.where("is_query").select(one.alias("bunch"), F.array(one).alias("leaves"), "pid")
    else:
        if probes is None:
            probes = max(LEAST_PROBES, PROBES_PER_DIMENSION * max(r.dims for r in found))
        sizes = {r.cls: r.n for r in found}
        members, asked = _dealt(points, sizes, leaves, probes, seed)
    near = _searched(points, members, asked, k)
    return _of_rows(rows, points, near, k)


def _dealt(points: DataFrame, sizes: dict, leaves: dict, probes: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Points with their leaf and its bunch, and asking points with the leaves they look into, by bunch."""
    spark, kind = points.sparkSession, points.schema["cls"].dataType
    cls_type = kind.simpleString()
    upper = {c: math.isqrt(n - 1) + 1 for c, n in leaves.items()}
    limit = lambda wanted: spark_map({c: min(1.0, wanted[c] / sizes[c]) for c in sizes}, kind)[F.col("cls")]
    chosen: dict = {r.cls: [r.vec] for r in points.groupBy("cls").agg(F.min_by("vec", F.struct(_share(seed, "upper"), "pid")).alias("vec")).collect()}
    for r in points.where(_share(seed, "upper") < limit(upper)).select("cls", "vec").toLocalIterator():
        chosen[r.cls].append(r.vec)
    pivots = spark.sparkContext.broadcast({c: np.unique(np.array(v, float), axis=0) for c, v in chosen.items()})
    looks = min(probes, MOST_UPPER)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            tops = np.empty(len(pdf), object)
            dist = np.zeros(len(pdf))
            for cls, at in pdf.groupby("cls").indices.items():
                d = distances(matrix(pdf["vec"].iloc[at]), pivots.value[cls])
                order = np.argsort(d, axis=1, kind="stable")[:, :looks]
                dist[at] = d.min(axis=1)
                for i, o in zip(at, order):
                    tops[i] = o
            yield pdf.assign(tops=[list(map(int, t)) for t in tops], dist=dist)

    schema = f"pid bigint, cls {cls_type}, vec array<double>, is_query boolean, ids array<bigint>, tops array<int>, dist double"
    placed = stage(points.mapInPandas(place, schema), "placed")
    of_leaf = (_share(seed, "leaf") < limit(leaves)) | (F.col("dist") == 0)  # an upper pivot is one of a leaf too
    pivot_rows = placed.where(of_leaf).select("cls", F.col("tops")[0].alias("top"), F.col("pid").alias("leaf"), F.col("vec").alias("pivot"))
    own = placed.select("pid", "cls", "vec", F.col("tops")[0].alias("top"), F.lit(False).alias("asks"))
    asking = placed.where("is_query").select("pid", "cls", "vec", F.explode("tops").alias("top"), F.lit(True).alias("asks"))
    work = own.unionByName(asking)
    parts = work.groupBy("cls", "top").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).cast("int").alias("parts"))
    keys = ["cls", "top", "part"]
    parts = F.broadcast(parts)  # one row per upper pivot
    dealt = work.join(parts, ["cls", "top"]).withColumn("part", F.pmod(F.xxhash64("pid", "asks"), F.col("parts")).cast("int")).drop("parts")
    copies = pivot_rows.join(parts, ["cls", "top"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def to_leaves(some: pd.DataFrame, own_pivots: pd.DataFrame) -> pd.DataFrame:
        """A row per point and bunch, with the leaves in it that the point may look into."""
        if some.empty or own_pivots.empty:
            return pd.DataFrame({c: [] for c in ("pid", "asks", "bunch", "leaves", "dists")})
        own_pivots = own_pivots.sort_values("leaf")
        leaf, at = own_pivots["leaf"].to_numpy(), matrix(own_pivots["pivot"])
        out = []
        for asks, part in some.groupby("asks"):
            d = distances(matrix(part["vec"]), at)
            n = min(probes if asks else 1, len(leaf))
            order = np.sort(np.argsort(d, axis=1, kind="stable")[:, :n], axis=1)
            row, bunch = np.repeat(np.arange(len(part)), n), order.ravel() // BUNCH_LEAVES
            first = np.flatnonzero(np.diff(row, prepend=-1) | np.diff(bunch, prepend=-1))
            cut = lambda values: np.split(values.ravel(), first[1:])
            out.append(
                pd.DataFrame(
                    {
                        "pid": part["pid"].to_numpy()[row[first]],
                        "asks": asks,
                        "bunch": leaf[bunch[first] * BUNCH_LEAVES],
                        "leaves": cut(leaf[order]),
                        "dists": cut(np.take_along_axis(d, order, 1)),
                    }
                )
            )
        return pd.concat(out)

    copies = _own(copies)
    schema = "pid bigint, asks boolean, bunch bigint, leaves array<bigint>, dists array<double>"
    found = stage(dealt.groupBy(*keys).cogroup(copies.groupBy(*keys)).applyInPandas(to_leaves, schema), "leaves")
    members = found.where(~F.col("asks")).select("bunch", F.col("leaves")[0].alias("leaf"), "pid")
    seen = found.where("asks").groupBy("pid").agg(F.collect_list(F.struct("bunch", "leaves", "dists")).alias("seen"))
    of_bunch = lambda s: F.zip_with(s["dists"], s["leaves"], lambda d, x: F.struct(d.alias("dist"), x.alias("leaf"), s["bunch"].alias("bunch")))
    nearest = F.slice(F.array_sort(F.flatten(F.transform("seen", of_bunch))), 1, probes)
    asked = seen.select("pid", F.explode(nearest).alias("x")).groupBy("pid", F.col("x.bunch").alias("bunch")).agg(F.collect_list("x.leaf").alias("leaves"))
    return members, asked.select("bunch", "leaves", "pid")


def _own(df: DataFrame) -> DataFrame:
    """The same columns as columns of its own: both sides of a cogroup come from one table."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def _searched(points: DataFrame, members: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """pid and its nearest others as (dist, nid) in order, from cells of bounded size of each bunch.

    A row travels once to a bunch, with the names of the leaves it looks into there, and gets
    ``k`` rows back from it. Vectors are joined last, so none is written or counted.
    """
    asked = stage(asked, "asked")
    cells = lambda df, most, name: df.groupBy("bunch").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(name))
    # one row per BUNCH_LEAVES leaves
    grid = F.broadcast(cells(members, HELD_ROWS, "rows").join(cells(asked, CELL_ROWS, "columns"), "bunch"))
    part = lambda n: F.pmod(F.xxhash64("pid"), F.col(n)).cast("int")
    span = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keys = ["bunch", "row", "column"]
    held = members.join(points.select("pid", "vec", "ids"), "pid")
    held = held.join(grid, "bunch").withColumn("row", part("rows")).withColumn("column", span("columns")).drop("rows", "columns")
    asking = asked.join(points.where("is_query").select("pid", "vec"), "pid")
    asking = asking.join(grid, "bunch").withColumn("column", part("columns")).withColumn("row", span("rows")).drop("rows", "columns")

    def across(q: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        if q.empty or m.empty:
            return pd.DataFrame({"pid": [], "nid": [], "dist": []})
        qid, mid, queries, at = q["pid"].to_numpy(), m["pid"].to_numpy(), matrix(q["vec"]), matrix(m["vec"])
        asker, leaf = np.repeat(np.arange(len(q)), q["leaves"].str.len()), np.concatenate(q["leaves"].to_list())
        askers = pd.Series(asker).groupby(leaf).indices
        found = []
        for name, own in m.groupby("leaf").indices.items():
            if name in askers:
                who = asker[askers[name]]
                found.append(best(qid[who], queries[who], mid[own], at[own], k))
        if not found:
            return pd.DataFrame({"pid": [], "nid": [], "dist": []})
        out = _first(pd.DataFrame(dict(zip(["pid", "nid", "dist"], map(np.concatenate, zip(*found))))), k)
        copied = m[m["ids"].str.len() > 1]
        if len(copied):
            ids = dict(zip(copied["pid"], copied["ids"]))
            out["nid"] = [list(ids.get(i, (i,)))[:k] for i in out["nid"]]
            out = _first(out.explode("nid"), k)
        return out

    held = _own(held)
    found = asking.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(across, "pid bigint, nid bigint, dist double")
    nth = F.row_number().over(Window.partitionBy("pid").orderBy("dist", "nid"))
    return found.withColumn("nth", nth).where(F.col("nth") <= k).groupBy("pid").agg(F.array_sort(F.collect_list(F.struct("dist", "nid"))).alias("near"))


def _first(near: pd.DataFrame, k: int) -> pd.DataFrame:
    """The ``k`` nearest of each pid."""
    return near.sort_values(["pid", "dist", "nid"]).groupby("pid").head(k)


def _of_rows(rows: DataFrame, points: DataFrame, near: DataFrame, k: int) -> DataFrame:
    """Neighbours of the asking rows: first the equal rows of their point, then its neighbours."""
    whole = points.where("is_query").join(near, "pid", "left")
    equal = F.transform("ids", lambda i: F.struct(F.lit(0.0).alias("dist"), i.alias("nid")))
    whole = whole.select("cls", "vec", F.concat(equal, F.coalesce("near", F.array().cast("array<struct<dist:double,nid:bigint>>"))).alias("near"))
    asking = rows.where("is_query").select("id", "cls", "vec")
    others = F.slice(F.filter("near", lambda x: x["nid"] != F.col("id")), 1, k)
    listed = asking.join(whole, ["cls", "vec"]).select("id", F.posexplode(others).alias("at", "x"))
    return listed.select("id", F.col("x.nid").alias("nid"), F.col("x.dist").alias("dist"), (F.col("at") + 1).alias("nth"))
