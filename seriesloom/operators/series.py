"""What a time series is, and how window expressions run over it.

A ``Series`` names the entity and the order of its rows. By itself it makes each
entity one window partition. That is right for a panel, which has one row per
entity and calendar step: its histories are as long as the calendar, however
much raw data went in and however uneven that was.

Where an entity may hold any share of the rows, ``chunked`` cuts the sorted
table into ranges of even size and gives every range a number. A window then
covers one entity in one range, and what it needs from the ranges around it
comes from small tables: single rows (``over_series``) or totals (``carried``).
At most one entity crosses each boundary between two ranges, so the table of
crossing pieces has less than two rows per range and may be broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from ..sources.staging import stage

CHUNK = "_chunk"
ROWS = "_rows"
HALO = "_halo"


def names(columns: str | Sequence[str]) -> tuple[str, ...]:
    return (columns,) if isinstance(columns, str) else tuple(columns)


@dataclass(frozen=True)
class Series:
    """Rows of one entity in order; ``order`` must leave no ties."""

    entity: tuple[str, ...]
    order: tuple[str, ...]
    chunk: str | None = field(default=None)

    @classmethod
    def of(cls, entity: str | Sequence[str], order: str | Sequence[str]) -> Series:
        return cls(names(entity), names(order))

    @property
    def keys(self) -> tuple[str, ...]:
        """Columns that make a window partition."""
        return self.entity + ((self.chunk,) if self.chunk else ())

    def group(self) -> WindowSpec:
        return Window.partitionBy(*self.keys)

    def window(self) -> WindowSpec:
        return self.group().orderBy(*self.order)


def range_chunks(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Stage ``df`` with its range number in ``_chunk``; numbers rise with ``order``.

    Spark samples the keys for even ranges, so a key with many rows is spread
    as long as the full ``order`` tells its rows apart. The number is stored,
    as a second evaluation could cut the ranges elsewhere.
    """
    ranged = df.repartitionByRange(*order).withColumn(CHUNK, F.spark_partition_id())
    return stage(ranged, name)


def chunked(df: DataFrame, series: Series) -> tuple[DataFrame, Series]:
    """The same rows and series, safe for entities of any size."""
    staged = range_chunks(df, series.entity + series.order, "chunks")
    return staged, replace(series, chunk=CHUNK)


def match(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left"
) -> DataFrame:
    """Join on ``keys`` where missing keys match each other, as they do in windows."""
    other = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(other, same, how).drop(*[f"_r_{k}" for k in keys])


def crossing(pieces: DataFrame, series: Series) -> DataFrame:
    """Keep the pieces (one row per entity and chunk) of entities in several chunks."""
    across = Window.partitionBy(*series.entity)
    return (
        pieces.withColumn("_pieces", F.count(F.lit(1)).over(across))
        .where(F.col("_pieces") > 1)
        .drop("_pieces")
    )


def piece_order(series: Series) -> WindowSpec:
    return Window.partitionBy(*series.entity).orderBy(series.chunk)


def carried(
    df: DataFrame,
    series: Series,
    summary: dict[str, Column],
    *steps: Callable[[WindowSpec], dict[str, Column]],
    keep: Sequence[str],
) -> DataFrame:
    """Add to every row what its entity's other chunks contribute.

    ``summary`` holds aggregates per piece. Each step adds columns by window
    expressions over the pieces of one entity, in order. The columns in ``keep``
    go to the rows; entities inside one chunk get nulls.
    """
    pieces = df.groupBy(*series.keys).agg(*[c.alias(n) for n, c in summary.items()])
    extra = crossing(pieces, series)
    for step in steps:
        extra = extra.withColumns(step(piece_order(series)))
    extra = extra.select(*series.keys, *keep)
    return match(df, F.broadcast(extra), series.keys)


def over_series(
    df: DataFrame,
    series: Series,
    uses: Sequence[str],
    build: Callable[[WindowSpec], dict[str, Column]],
    before: int = 0,
    after: int = 0,
) -> DataFrame:
    """Add the window columns ``build`` makes from the columns it ``uses``, with
    frames of at most ``before`` earlier and ``after`` later rows.

    In a chunked series the rows next to a chunk's ends are copied into it,
    the window runs per chunk, and the copies are dropped again. The copies hold
    nothing but keys and used columns: what earlier operators added is not
    computed a second time for them.
    """
    if series.chunk is None:
        return df.withColumns(build(series.window()))
    own = df.withColumn(HALO, F.lit(False))
    base = df.select(*dict.fromkeys([*series.keys, *series.order, *uses]))
    for count, forward in ((before, True), (after, False)):
        if count:
            halo = _halo(base, series, count, forward).withColumn(HALO, F.lit(True))
            own = own.unionByName(halo, allowMissingColumns=True)
    return own.withColumns(build(series.window())).where(~F.col(HALO)).drop(HALO)


def _halo(df: DataFrame, series: Series, count: int, forward: bool) -> DataFrame:
    """Copies of the ``count`` rows at the end of each piece (its start if not
    ``forward``), one for every following (preceding) piece that needs them."""
    pieces = df.groupBy(*series.keys).agg(F.count(F.lit(1)).alias(ROWS))
    order = piece_order(series)
    frame = order.rowsBetween(1, count) if forward else order.rowsBetween(-count, -1)
    reach = F.collect_list(F.struct(series.chunk, ROWS)).over(frame)
    targets = crossing(pieces, series).withColumn(
        "_targets", reach if forward else F.reverse(reach)
    )
    edge = [F.col(c).desc() if forward else F.col(c).asc() for c in series.order]
    rows = (
        match(df, F.broadcast(targets.drop(ROWS)), series.keys, "inner")
        .withColumn("_nth", F.row_number().over(series.group().orderBy(*edge)))
        .where(F.col("_nth") <= count)
        .select("*", F.posexplode("_targets").alias("_step", "_target"))
    )
    between = F.aggregate(
        F.slice("_targets", F.lit(1), F.col("_step")),
        F.lit(0).cast("long"),
        lambda acc, piece: acc + piece[ROWS],
    )
    return (
        rows.where(F.col("_nth") + between <= count)
        .withColumn(series.chunk, F.col("_target")[series.chunk])
        .select(*df.columns)
    )
