"""Sorting, top rows, and positions in a global order.

Positions never come from one window over all rows. The keys are cut into even
ranges, the ranges are counted, and a row's position is its place in the range
plus the rows of earlier ranges.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .series import CHUNK, names, range_chunks


def sort_panel(df: DataFrame, keys: str | Sequence[str], descending: bool = False) -> DataFrame:
    return df.orderBy(*names(keys), ascending=not descending)


def head_n(df: DataFrame, n: int, keys: str | Sequence[str]) -> DataFrame:
    """First ``n`` rows by ``keys``; ``n`` is small, as all of them meet in one task."""
    return df.orderBy(*names(keys)).limit(n)


def top_n(df: DataFrame, n: int, score: str, tie_break: str | Sequence[str]) -> DataFrame:
    return df.orderBy(F.col(score).desc(), *names(tie_break)).limit(n)


def bottom_n(df: DataFrame, n: int, score: str, tie_break: str | Sequence[str]) -> DataFrame:
    return df.orderBy(F.col(score).asc(), *names(tie_break)).limit(n)


def sort_desc_report(df: DataFrame, score: str, tie_break: str | Sequence[str]) -> DataFrame:
    return df.orderBy(F.col(score).desc(), *names(tie_break))


def ordered_index(df: DataFrame, order: str | Sequence[str], column: str) -> DataFrame:
    """Add the 0-based position of each row in ``order``, which must have no ties."""
    order = names(order)
    ranged = range_chunks(df, order, "index")
    counts = ranged.groupBy(CHUNK).agg(F.count(F.lit(1)).alias("_rows"))
    # one row per range: the window and the broadcast stay as small as the cluster
    earlier = Window.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        CHUNK, F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start")
    )
    place = F.row_number().over(Window.partitionBy(CHUNK).orderBy(*order))
    return (
        ranged.withColumn("_place", place)
        .join(F.broadcast(starts), CHUNK)
        .withColumn(column, F.col("_start") + F.col("_place") - 1)
        .drop(CHUNK, "_place", "_start")
    )


def rows_at(
    df: DataFrame, order: str | Sequence[str], positions: Callable[[int], list[int]]
) -> tuple[int, list[tuple | None]]:
    """Row count ``n`` and the sort keys at the 0-based ``positions(n)``.

    A position of ``n`` or more gives None. Only key columns move; the driver
    sees one count per range and one key per position.
    """
    order = names(order)
    keys = range_chunks(df.select(*order), order, "keys")
    counts = sorted((r[CHUNK], r["count"]) for r in keys.groupBy(CHUNK).count().collect())
    n = sum(c for _, c in counts)
    wanted = positions(n)
    places: dict[int, tuple[int, int]] = {}
    start = 0
    for chunk, count in counts:
        for p in wanted:
            if start <= p < start + count:
                places[p] = (chunk, p - start + 1)
        start += count
    if not places:
        return n, [None for _ in wanted]
    place = F.row_number().over(Window.partitionBy(CHUNK).orderBy(*order))
    found = (
        keys.where(F.col(CHUNK).isin([c for c, _ in places.values()]))
        .withColumn("_place", place)
        .where(
            reduce(
                lambda a, b: a | b,
                [(F.col(CHUNK) == c) & (F.col("_place") == i) for c, i in places.values()],
            )
        )
        .collect()
    )
    by_place = {(r[CHUNK], r["_place"]): tuple(r[c] for c in order) for r in found}
    return n, [by_place[places[p]] if p in places else None for p in wanted]


def at_or_after(df: DataFrame, order: str | Sequence[str], key: tuple | None) -> Column:
    """Whether a row sorts at or after ``key`` (never, for None); null sorts lowest.

    The bare condition on the first column is implied by the rest; it is the
    part a parquet scan can use. A null first key has none.
    """
    order = names(order)
    if key is None:
        return F.lit(False)
    literals = [F.lit(v).cast(df.schema[c].dataType) for c, v in zip(order, key)]
    tuple_order = F.struct(*[F.col(c) for c in order]) >= F.struct(
        *[v.alias(c) for c, v in zip(order, literals)]
    )
    if key[0] is None:
        return tuple_order
    first = F.col(order[0]) >= literals[0]
    return F.coalesce(first & tuple_order, F.lit(False))
