"""Gamma-standardised indices (SPI, SPEI) and classes from them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from ..functions.special import gamma_cdf, gamma_shape, norm_ppf
from .series import Series, carried, names
from .windows import rolling_sum

# Offset of the rolled sums, class limits and labels.
OFFSET = 0.01
DROUGHT_LIMITS = ((-1.5, "Extreme"), (-1.0, "Moderate"))
NO_DROUGHT = "No Drought"


def gamma_fit(
    df: DataFrame, entity: str | Sequence[str], column: str, min_rows: int
) -> DataFrame:
    """Maximum-likelihood gamma (location 0) of the positive values per entity.

    One partial aggregate per entity, then Newton once per entity. Columns
    ``n``, ``mean``, ``shape``, ``scale``; both null below ``min_rows`` values.
    """
    positive = F.when(F.col(column) > 0, F.col(column))
    stats = df.groupBy(*names(entity)).agg(
        F.count(positive).alias("n"),
        F.avg(positive).alias("mean"),
        F.avg(F.ln(positive)).alias("_mean_ln"),
    )
    shape = F.when(F.col("n") >= min_rows, gamma_shape("ln(mean) - _mean_ln"))
    return (
        stats.withColumn("shape", shape)
        .withColumn("scale", F.col("mean") / F.col("shape"))
        .drop("_mean_ln")
    )


def standardised_indices(
    df: DataFrame, series: Series, indices: Mapping[str, tuple[Column, int]]
) -> DataFrame:
    """Add one index per entry: name -> (value, scale k).

    Each is the normal quantile of the gamma probability of the k-row sum plus
    0.01, with the gamma fitted to the entity's positive sums. Sums at or below
    zero do not take part in the fit but are scored: probability 0, index -inf.
    """
    inputs = {f"_x_{name}": value for name, (value, _) in indices.items()}
    rolled = df.withColumns(inputs)
    for scale in sorted({k for _, k in indices.values()}):
        same = {f"_sum_{n}": f"_x_{n}" for n, (_, k) in indices.items() if k == scale}
        rolled = rolling_sum(rolled, series, same, scale)
    rolled = rolled.withColumns({f"_sum_{n}": F.col(f"_sum_{n}") + OFFSET for n in indices})
    fit = _fit_in_windows if series.chunk is None else _fit_by_pieces
    fitted = fit(rolled, series, {name: k for name, (_, k) in indices.items()})
    probabilities = {
        f"_p_{name}": gamma_cdf(
            f"`_sum_{name}`", f"`_shape_{name}`", f"`_mean_{name}` / `_shape_{name}`"
        )
        for name in indices
    }
    scores = [norm_ppf(f"`_p_{name}`").alias(name) for name in indices]
    return fitted.withColumns(probabilities).select(*df.columns, *scores)


def _fit_in_windows(rolled: DataFrame, series: Series, scales: dict[str, int]) -> DataFrame:
    """Fit over the series' own partitioning: no second scan and no join. Newton
    runs on the first row of each entity only, and its result is spread."""
    group = series.group()
    stats: dict[str, Column] = {"_row": F.row_number().over(series.window())}
    for name in scales:
        positive = F.when(F.col(f"_sum_{name}") > 0, F.col(f"_sum_{name}"))
        stats[f"_n_{name}"] = F.count(positive).over(group)
        stats[f"_mean_{name}"] = F.avg(positive).over(group)
        stats[f"_ln_{name}"] = F.avg(F.ln(positive)).over(group)
    first = {
        f"_first_{name}": F.when(
            (F.col("_row") == 1) & (F.col(f"_n_{name}") >= k),
            gamma_shape(f"ln(`_mean_{name}`) - `_ln_{name}`"),
        )
        for name, k in scales.items()
    }
    spread = {f"_shape_{name}": F.max(f"_first_{name}").over(group) for name in scales}
    return rolled.withColumns(stats).withColumns(first).withColumns(spread)


def _fit_by_pieces(rolled: DataFrame, series: Series, scales: dict[str, int]) -> DataFrame:
    """Fit entities inside one chunk by windows, the others from one row of sums per chunk."""
    summary = {}
    for name in scales:
        positive = F.when(F.col(f"_sum_{name}") > 0, F.col(f"_sum_{name}"))
        summary |= {f"_k_{name}": F.count(positive), f"_avg_{name}": F.avg(positive), f"_avg_ln_{name}": F.avg(F.ln(positive))}

    def totals(order: WindowSpec) -> dict[str, Column]:
        whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        found = {}
        for name in scales:
            n = F.sum(f"_k_{name}").over(whole)
            found[f"_all_{name}"] = n
            for part in ("avg", "avg_ln"):
                found[f"_whole_{part}_{name}"] = F.try_divide(F.sum(F.col(f"_k_{name}") * F.col(f"_{part}_{name}")).over(whole), n)
        return found

    def shapes(_: WindowSpec) -> dict[str, Column]:
        return {
            f"_whole_shape_{name}": F.when(F.col(f"_all_{name}") >= k, gamma_shape(f"ln(`_whole_avg_{name}`) - `_whole_avg_ln_{name}`"))
            for name, k in scales.items()
        }

    keep = [f"_{part}_{name}" for name in scales for part in ("all", "whole_avg", "whole_shape")]
    across = carried(rolled, series, summary, totals, shapes, keep=keep)
    local = _fit_in_windows(across, series, scales)
    chosen = {}
    for name in scales:
        crosses = F.col(f"_all_{name}").isNotNull()
        chosen[f"_mean_{name}"] = F.when(crosses, F.col(f"_whole_avg_{name}")).otherwise(F.col(f"_mean_{name}"))
        chosen[f"_shape_{name}"] = F.when(crosses, F.col(f"_whole_shape_{name}")).otherwise(F.col(f"_shape_{name}"))
    return local.withColumns(chosen)


def spi(df: DataFrame, series: Series, precipitation: str, k: int, output: str) -> DataFrame:
    return standardised_indices(df, series, {output: (F.col(precipitation), k)})


def spei(
    df: DataFrame,
    series: Series,
    precipitation: str,
    evapotranspiration: str,
    k: int,
    output: str,
) -> DataFrame:
    balance = F.col(precipitation) - F.col(evapotranspiration)
    return standardised_indices(df, series, {output: (balance, k)})


def classify_threshold(
    value: Column,
    limits: Sequence[tuple[float, str]] = DROUGHT_LIMITS,
    otherwise: str = NO_DROUGHT,
) -> Column:
    """Label of the first limit the value does not exceed.

    Limits rise. Null and NaN get ``otherwise``.
    """
    known = F.when(~F.isnan(value), value)
    label = F
    for limit, name in limits:
        label = label.when(known <= limit, F.lit(name))
    return label.otherwise(F.lit(otherwise))
