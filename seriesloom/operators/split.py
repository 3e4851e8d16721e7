"""Time-aware training and test splits."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.staging import stage
from .ordering import at_or_after, ordered_index, rows_at

BLOCK = "fold_block"
POSITION = "_position"


def split_years(
    df: DataFrame, train: Sequence[int], test: Sequence[int], column: str = "year"
) -> tuple[DataFrame, DataFrame]:
    year = F.col(column)
    return df.where(year.isin(list(train))), df.where(year.isin(list(test)))


def split_date_cut(
    df: DataFrame, cut: str, column: str = "date"
) -> tuple[DataFrame, DataFrame]:
    """Rows before ``cut`` (an ISO date), and rows from it on."""
    day = F.lit(cut).cast("date")
    return df.where(F.col(column) < day), df.where(F.col(column) >= day)


def _passed(
    df: DataFrame, order: str | Sequence[str], positions: Callable[[int], list[int]]
) -> tuple[DataFrame, list[Column]]:
    """The rows, and per position whether a row stands there or later in ``order``.

    Cuts are conditions on the sort keys. Where rows on both sides of a cut share
    their keys, the rows are numbered and written instead, so that each part keeps
    its size.
    """
    n, keys = rows_at(df, order, lambda n: [q for p in positions(n) for q in (p, p - 1)])
    cuts, before = keys[::2], keys[1::2]
    if not any(cut is not None and cut == last for cut, last in zip(cuts, before)):
        return df, [at_or_after(df, order, cut) for cut in cuts]
    numbered = stage(ordered_index(df, order, POSITION), "numbered")
    return numbered, [F.col(POSITION) >= p for p in positions(n)]


def split_ratio(
    df: DataFrame, order: str | Sequence[str], ratio: float
) -> tuple[DataFrame, DataFrame]:
    """First ``int(ratio * n)`` rows in ``order``, and the rest.

    The cut is found among the sort keys; both parts are filters of ``df``. Rows
    with equal keys may stand on either side, in numbers that make up the ratio.
    """
    rows, (late,) = _passed(df, order, lambda n: [int(n * ratio)])
    return rows.where(~late).select(*df.columns), rows.where(late).select(*df.columns)


def fold_blocks(df: DataFrame, order: str | Sequence[str], n_splits: int) -> DataFrame:
    """Number the rows' blocks: 0, then ``n_splits`` equal blocks at the end.

    Fold ``i`` (from 1) trains on the blocks before ``i`` and tests on block
    ``i``, each test block being ``n // (n_splits + 1)`` rows.
    """

    def starts(n: int) -> list[int]:
        size = n // (n_splits + 1)
        if size == 0:
            raise ValueError(f"{n} rows are too few for {n_splits} splits")
        return [n - i * size for i in range(n_splits, 0, -1)]

    rows, passed = _passed(df, order, starts)
    block = reduce(lambda a, b: a + b, [p.cast("int") for p in passed])
    return rows.select(*df.columns, block.alias(BLOCK))


def fold(blocks: DataFrame, i: int) -> tuple[DataFrame, DataFrame]:
    """Training and test rows of fold ``i`` of a table with blocks."""
    return blocks.where(F.col(BLOCK) < i), blocks.where(F.col(BLOCK) == i)


def timeseries_folds(df: DataFrame, order: str | Sequence[str], n_splits: int = 5) -> DataFrame:
    """Every row once per fold it takes part in, with ``fold`` and ``role``."""
    blocks = fold_blocks(df, order, n_splits)
    folds = F.sequence(F.greatest(F.col(BLOCK), F.lit(1)), F.lit(n_splits))
    role: Column = F.when(F.col(BLOCK) == F.col("fold"), "test").otherwise("train")
    return (
        blocks.withColumn("fold", F.explode(folds)).withColumn("role", role).drop(BLOCK)
    )
