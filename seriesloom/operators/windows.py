"""Rolling, shifted and whole-history features of time series."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F
from pyspark.sql.types import NumericType

from .series import ROWS, Series, carried, chunked, names, over_series


def rolling_sum(df: DataFrame, series: Series, columns: Mapping[str, str], k: int) -> DataFrame:
    """Sum of the last ``k`` rows; null unless all ``k`` are there and non-null.

    ``columns`` maps each new column to its input.
    """

    def build(w: WindowSpec) -> dict[str, Column]:
        last_k = w.rowsBetween(-(k - 1), 0)
        return {
            out: F.when(F.count(c).over(last_k) == k, F.sum(c).over(last_k))
            for out, c in columns.items()
        }

    return over_series(df, series, list(columns.values()), build, before=k - 1)


def rolling_mean(df: DataFrame, series: Series, columns: Mapping[str, str], k: int) -> DataFrame:
    """Mean of the non-null values among the last ``k`` rows."""

    def build(w: WindowSpec) -> dict[str, Column]:
        last_k = w.rowsBetween(-(k - 1), 0)
        return {out: F.avg(c).over(last_k) for out, c in columns.items()}

    return over_series(df, series, list(columns.values()), build, before=k - 1)


def lag_features(
    df: DataFrame, series: Series, columns: Iterable[str], lags: Sequence[int] = (1, 2, 3)
) -> DataFrame:
    """``{column}_lag{n}``: the value ``n`` rows earlier."""
    columns = list(columns)

    def build(w: WindowSpec) -> dict[str, Column]:
        return {f"{c}_lag{n}": F.lag(c, n).over(w) for c in columns for n in lags}

    return over_series(df, series, columns, build, before=max(lags))


def lead_target(
    df: DataFrame, series: Series, column: str, horizon: int, output: str
) -> DataFrame:
    """The value of ``column`` ``horizon`` rows later."""
    return over_series(
        df, series, [column], lambda w: {output: F.lead(column, horizon).over(w)}, after=horizon
    )


def multi_horizon_targets(
    df: DataFrame,
    series: Series,
    column: str,
    horizons: Sequence[int] = (1, 2, 3),
    pattern: str = "target_{n}m_ahead",
) -> DataFrame:
    """One lead per horizon. If ``column`` itself looks ahead, the leads add up."""

    def build(w: WindowSpec) -> dict[str, Column]:
        return {pattern.format(n=n): F.lead(column, n).over(w) for n in horizons}

    return over_series(df, series, [column], build, after=max(horizons))


def sequence_windows(
    df: DataFrame, series: Series, features: Sequence[str], length: int, output: str = "seq"
) -> DataFrame:
    """For each row with ``length`` earlier rows, the features of just those rows.

    The row itself is not in its sequence. Rows with a shorter past are left out.
    """

    def build(w: WindowSpec) -> dict[str, Column]:
        step = F.array(*[F.col(c).cast("double") for c in features])
        return {output: F.collect_list(step).over(w.rowsBetween(-length, -1))}

    out = over_series(df, series, features, build, before=length)
    return out.where(F.size(output) == length)


def numeric_columns(df: DataFrame, exclude: Iterable[str]) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name not in skip]


def interpolate_linear(
    df: DataFrame, series: Series, columns: Sequence[str] | None = None
) -> DataFrame:
    """Fill gaps linearly by row position; ends take the nearest known value.

    Default: every numeric column that is not a key. A column without any value
    in an entity stays null there.
    """
    if columns is None:
        columns = numeric_columns(df, series.keys + series.order)
    # the next known value is the last one seen from the other end: a frame that
    # ends at the last row would be computed anew for every row
    w = series.window()
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    backwards = series.group().orderBy(*[F.col(c).desc() for c in series.order])
    from_end = backwards.rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("_pos", F.row_number().over(w).cast("long"))
    if series.chunk:
        out = _with_carried_points(out, series, columns)
    near: dict[str, Column] = {}
    for c in columns:
        near[f"_prev_{c}"] = F.last(_known(c), ignorenulls=True).over(so_far)
        near[f"_next_{c}"] = F.last(_known(c), ignorenulls=True).over(from_end)
    out = out.withColumns(near)
    if series.chunk:
        placed = {"_pos": F.expr("_pos + coalesce(_start, 0)")}
        for c in columns:
            for side, beyond in ((f"_prev_{c}", f"_before_{c}"), (f"_next_{c}", f"_after_{c}")):
                moved = _moved(side, "coalesce(_start, 0)")
                placed[side] = F.expr(f"coalesce({moved}, `{beyond}`)")
        out = out.withColumns(placed)
    filled = {
        c: F.expr(
            f"coalesce(CAST(`{c}` AS DOUBLE), `_prev_{c}`.v + (`_next_{c}`.v - `_prev_{c}`.v)"
            f" / nullif(`_next_{c}`.pos - `_prev_{c}`.pos, 0) * (_pos - `_prev_{c}`.pos),"
            f" `_prev_{c}`.v, `_next_{c}`.v)"
        )
        for c in columns
    }
    return out.withColumns(filled).select(*df.columns)


def _known(c: str) -> Column:
    """Position and value of a known value, or null."""
    point = f"named_struct('pos', _pos, 'v', CAST(`{c}` AS DOUBLE))"
    return F.expr(f"CASE WHEN `{c}` IS NOT NULL THEN {point} END")


def _moved(point: str, start: str) -> str:
    moved = f"named_struct('pos', `{point}`.pos + {start}, 'v', `{point}`.v)"
    return f"CASE WHEN `{point}` IS NOT NULL THEN {moved} END"


def _with_carried_points(out: DataFrame, series: Series, columns: Sequence[str]) -> DataFrame:
    """Last known point of earlier chunks and first of later ones, by entity position."""
    summary = {ROWS: F.count(F.lit(1))}
    for c in columns:
        summary[f"_first_{c}"] = F.min(_known(c))
        summary[f"_last_{c}"] = F.max(_known(c))

    def start(order: WindowSpec) -> dict[str, Column]:
        earlier = order.rowsBetween(Window.unboundedPreceding, -1)
        return {"_start": F.coalesce(F.sum(ROWS).over(earlier), F.lit(0))}

    def move(_: WindowSpec) -> dict[str, Column]:
        ends = [f"_{end}_{c}" for c in columns for end in ("first", "last")]
        return {e: F.expr(_moved(e, "_start")) for e in ends}

    def reach(order: WindowSpec) -> dict[str, Column]:
        earlier = order.rowsBetween(Window.unboundedPreceding, -1)
        backwards = Window.partitionBy(*series.entity).orderBy(F.col(series.chunk).desc())
        later = backwards.rowsBetween(Window.unboundedPreceding, -1)
        found = {}
        for c in columns:
            found[f"_before_{c}"] = F.last(f"_last_{c}", ignorenulls=True).over(earlier)
            found[f"_after_{c}"] = F.last(f"_first_{c}", ignorenulls=True).over(later)
        return found

    keep = ["_start"] + [f"_{side}_{c}" for c in columns for side in ("before", "after")]
    return carried(out, series, summary, start, move, reach, keep=keep)


def zscore_anomaly(df: DataFrame, series: Series, columns: Mapping[str, str]) -> DataFrame:
    """Distance from the entity's mean in sample standard deviations.

    The statistics cover the whole history. A constant history gives null.
    """
    if series.chunk is None:
        group = series.group()
        return df.withColumns(
            {
                out: F.try_divide(F.col(c) - F.avg(c).over(group), F.stddev_samp(c).over(group))
                for out, c in columns.items()
            }
        )
    summary, local = {}, {}
    for out, c in columns.items():
        summary |= {f"_n_{out}": F.count(c), f"_avg_{out}": F.avg(c), f"_m2_{out}": F.var_pop(c) * F.count(c)}
        local |= {f"_mean_{out}": F.avg(c).over(series.group()), f"_std_{out}": F.stddev_samp(c).over(series.group())}

    def means(order: WindowSpec) -> dict[str, Column]:
        whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        found = {}
        for out in columns:
            found[f"_all_{out}"] = F.sum(f"_n_{out}").over(whole)
            total = F.sum(F.col(f"_n_{out}") * F.col(f"_avg_{out}")).over(whole)
            found[f"_whole_mean_{out}"] = F.try_divide(total, F.sum(f"_n_{out}").over(whole))
        return found

    def deviations(order: WindowSpec) -> dict[str, Column]:
        whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        found = {}
        for out in columns:
            off = F.col(f"_avg_{out}") - F.col(f"_whole_mean_{out}")
            squares = F.sum(F.col(f"_m2_{out}") + F.col(f"_n_{out}") * off * off).over(whole)
            found[f"_whole_std_{out}"] = F.sqrt(F.try_divide(squares, F.col(f"_all_{out}") - 1))
        return found

    keep = [f"_{part}_{out}" for out in columns for part in ("all", "whole_mean", "whole_std")]
    found = carried(df, series, summary, means, deviations, keep=keep).withColumns(local)
    scores = {}
    for out, c in columns.items():
        # the count is there for entities in several chunks only
        mean, std = (
            F.when(F.col(f"_all_{out}").isNotNull(), F.col(f"_whole_{part}_{out}")).otherwise(F.col(f"_{part}_{out}"))
            for part in ("mean", "std")
        )
        scores[out] = F.try_divide(F.col(c) - mean, std)
    return found.withColumns(scores).select(*df.columns, *columns)


def percentile_of_score(df: DataFrame, series: Series, columns: Mapping[str, str]) -> DataFrame:
    """Percentile of each value in its entity's whole history, ties averaged.

    ``(count below + count at or below + 1) * 50 / count``, nulls left out.
    """
    if series.chunk is not None:
        for out, c in columns.items():
            df = _percentile_by_ranges(df, series, c, out)
        return df
    group = series.group()
    scores = {}
    for out, c in columns.items():
        by_value = group.orderBy(F.col(c).asc_nulls_last())
        up_to = F.count(c).over(by_value.rangeBetween(Window.unboundedPreceding, 0))
        score = (F.rank().over(by_value) + up_to) * 50.0 / F.count(c).over(group)
        scores[out] = F.when(F.col(c).isNotNull(), score)
    return df.withColumns(scores)


def _percentile_by_ranges(df: DataFrame, series: Series, column: str, output: str) -> DataFrame:
    """The same by one sweep over the rows sorted by entity and value, cut into even ranges.

    A row is ranked in its range. What earlier ranges of its entity hold, and how many
    rows equal to the range's least (largest) value lie in the ranges before
    (after) it, comes from one row per range. Neither a large entity nor a
    frequent value meets in one task, and the rows are not joined with a table of values.
    """
    moved = df.withColumnRenamed(series.chunk, "_own_chunk")
    order = [c for c in series.order if c != column]
    ranged, by_value = chunked(moved, Series(series.entity, (column, *order)))
    value = by_value.group().orderBy(F.col(column).asc_nulls_last())
    ranked = ranged.withColumns(
        {
            "_below": F.rank().over(value) - 1,
            "_equal": F.count(column).over(value.rangeBetween(Window.currentRow, Window.currentRow)),
            "_held": F.count(column).over(by_value.group()),
        }
    )
    last = F.col("_below") + F.col("_equal") == F.col("_held")
    summary = {
        ROWS: F.count(column),
        "_min": F.min(column),
        "_max": F.max(column),
        "_n_min": F.max(F.when((F.col("_below") == 0) & F.col(column).isNotNull(), F.col("_equal"))),
        "_n_max": F.max(F.when(last & F.col(column).isNotNull(), F.col("_equal"))),
    }

    def across(order: WindowSpec) -> dict[str, Column]:
        whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        up_to_here = Window.partitionBy(*series.entity, "_max").orderBy(by_value.chunk).rowsBetween(Window.unboundedPreceding, 0)
        from_here = Window.partitionBy(*series.entity, "_min").orderBy(F.col(by_value.chunk).desc()).rowsBetween(Window.unboundedPreceding, 0)
        return {
            "_carry": F.coalesce(F.sum(ROWS).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "_total": F.sum(ROWS).over(whole),
            "_run_max": F.sum("_n_max").over(up_to_here),
            "_run_min": F.sum("_n_min").over(from_here),
        }

    def runs(order: WindowSpec) -> dict[str, Column]:
        return {
            "_earlier": F.when(F.lag("_max").over(order) == F.col("_min"), F.lag("_run_max").over(order)).otherwise(0),
            "_later": F.when(F.lead("_min").over(order) == F.col("_max"), F.lead("_run_min").over(order)).otherwise(0),
        }

    placed = carried(ranked, by_value, summary, across, runs, keep=["_carry", "_total", "_min", "_max", "_earlier", "_later"])
    earlier = F.when(F.col(column) == F.col("_min"), F.col("_earlier")).otherwise(0)
    later = F.when(F.col(column) == F.col("_max"), F.col("_later")).otherwise(0)
    below = F.col("_below") + F.coalesce("_carry", F.lit(0)) - earlier
    equal = F.col("_equal") + earlier + later
    score = F.try_divide((2 * below + equal + 1) * 50.0, F.coalesce("_total", "_held"))
    found = placed.withColumn(output, F.when(F.col(column).isNotNull(), score))
    return found.drop(series.chunk).withColumnRenamed("_own_chunk", series.chunk).select(*df.columns, output)


def group_apply(
    df: DataFrame, entity: str | Sequence[str], fn, schema: str, max_rows: int
) -> DataFrame:
    """Run ``fn`` (pandas in, pandas out) on each entity's rows.

    For what window expressions cannot say. A group goes through one task whole,
    so the largest group is counted first, and more than ``max_rows`` is an error.
    """
    entity = names(entity)
    counts = df.groupBy(*entity).agg(F.count(F.lit(1)).alias("n"))
    largest = counts.agg(F.max("n")).first()[0] or 0
    if largest > max_rows:
        raise ValueError(f"a group has {largest} rows, more than max_rows={max_rows}")
    return df.groupBy(*entity).applyInPandas(fn, schema)


def group_stream(
    df: DataFrame,
    entity: str | Sequence[str],
    order: str | Sequence[str],
    start: Callable[[tuple], Any],
    step: Callable[[Any, pd.DataFrame], tuple[Any, pd.DataFrame | None]],
    schema: str,
    finish: Callable[[tuple, Any], pd.DataFrame | None] | None = None,
) -> DataFrame:
    """Run ``step`` over each entity's rows in order, a batch at a time, with a state carried along.

    ``start`` makes the state of an entity from its key, ``step`` takes state and rows and
    gives the next state and rows of the result, ``finish`` what the last state
    adds. An entity's rows pass through one task, sorted by Spark (which spills), but never
    lie in memory together: no entity is too large. Null keys are an entity.
    """
    entity = names(entity)
    rows = df.repartition(*entity).sortWithinPartitions(*entity, *names(order))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, open_ = None, None, False
        for pdf in batches:
            if pdf.empty:
                continue
            groups = pdf.groupby(list(entity), sort=False, dropna=False).ngroup().to_numpy()
            edges = [0, *(i for i in range(1, len(groups)) if groups[i] != groups[i - 1]), len(groups)]
            for a, b in zip(edges, edges[1:]):
                part = pdf.iloc[a:b]
                own = tuple(None if pd.isna(v) else v for v in part.iloc[0][list(entity)])
                if not open_ or own != key:
                    if open_ and finish is not None and (out := finish(key, state)) is not None:
                        yield out
                    key, state, open_ = own, start(own), True
                state, out = step(state, part)
                if out is not None and len(out):
                    yield out
        if open_ and finish is not None and (out := finish(key, state)) is not None:
            yield out

    return rows.mapInPandas(run, schema)
