"""From raw sources to a model-ready table, as one lazy plan.

Every window in here runs over one entity's months. Such a history is as long
as the calendar (a century is 1,200 rows), whatever the size of the raw data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..operators.columns import (
    cyclic_encode,
    drop_if_exists,
    drop_null_rows,
    drop_null_subset,
    make_month_date,
    normalize_key,
    split_date,
)
from ..operators.indices import classify_threshold, standardised_indices
from ..operators.merge import outer_merge_many, union_by_name
from ..operators.series import Series
from ..operators.windows import (
    interpolate_linear,
    lag_features,
    lead_target,
    multi_horizon_targets,
    percentile_of_score,
    rolling_mean,
    zscore_anomaly,
)
from ..sources.tables import counted

INDEX_COLUMNS = ("spi_3", "spi_6", "spei_3", "spei_6", "drought_class")
FUTURE = "future_drought_class"


@dataclass(frozen=True)
class Roles:
    """Which column plays which part."""

    precipitation: str
    evapotranspiration: str
    vegetation: str
    soil: tuple[str, ...]
    entity: str = "entity"

    @property
    def keys(self) -> tuple[str, str, str]:
        return (self.entity, "year", "month")

    @property
    def series(self) -> Series:
        return Series.of(self.entity, "date")


def merge_panel(
    periods: Sequence[Mapping[str, DataFrame]],
    entity: str = "entity",
    how: str = "join",
    counts: dict | None = None,
) -> DataFrame:
    """One row per entity and month from several variables in several periods.

    Each period is merged by itself, the periods are stacked, and gaps are then
    filled along each entity's months. ``how`` as in ``outer_merge_many``. With a dict
    for ``counts`` the rows of every source, merged period and the panel are counted
    while the panel is computed.
    """
    keys = (entity, "year", "month")
    noted = (lambda df, name: df) if counts is None else (lambda df, name: counted(df, name, counts))
    merged = []
    for i, sources in enumerate(periods, 1):
        cleaned = [normalize_key(split_date(noted(s, f"period {i} {name}")), entity) for name, s in sources.items()]
        merged.append(noted(outer_merge_many(cleaned, keys, how), f"period {i}"))
    panel = union_by_name(merged)
    return noted(interpolate_linear(panel, Series.of(entity, ("year", "month"))), "panel")


def build_features(panel: DataFrame, roles: Roles, horizon: int = 3) -> DataFrame:
    """Indices, anomalies, percentiles, rolling means, lags, class and its future.

    Windows ordered by date come before those ordered by value, so the rows are
    shuffled once and sorted once for all of the former.
    """
    r, series = roles, roles.series
    wet, balance = F.col(r.precipitation), F.col(r.precipitation) - F.col(r.evapotranspiration)
    df = make_month_date(panel)
    df = standardised_indices(
        df,
        series,
        {"spi_3": (wet, 3), "spi_6": (wet, 6), "spei_3": (balance, 3), "spei_6": (balance, 6)},
    )
    df = df.withColumn("drought_class", classify_threshold(F.col("spei_3")))
    df = lead_target(df, series, "drought_class", horizon, FUTURE)
    df = lag_features(df, series, [r.precipitation, r.vegetation, r.soil[0], r.evapotranspiration])
    smooth = {f"{c}_roll3": c for c in (r.vegetation, *r.soil, r.precipitation)}
    df = rolling_mean(df, series, smooth, 3)
    df = rolling_mean(df, series, {f"{r.precipitation}_roll6": r.precipitation}, 6)
    df = zscore_anomaly(df, series, {f"{r.vegetation}_anomaly": r.vegetation})
    df = percentile_of_score(df, series, {f"{c}_pct": c for c in r.soil})
    return drop_null_rows(df)


def build_model_ready(features: DataFrame, roles: Roles) -> DataFrame:
    """Without the index columns, with the cyclic month and three targets.

    The targets look 1 to 3 rows ahead of a column that already looks ahead.
    """
    if FUTURE not in features.columns:
        raise ValueError(f"no column {FUTURE}")
    df = drop_if_exists(features, INDEX_COLUMNS)
    df = cyclic_encode(df, "month")
    df = multi_horizon_targets(df, roles.series, FUTURE)
    return drop_null_subset(df, [f"target_{n}m_ahead" for n in (1, 2, 3)])


def model_ready(
    periods: Sequence[Mapping[str, DataFrame]], roles: Roles, horizon: int = 3, how: str = "join"
) -> DataFrame:
    """All of the above in one plan, with no table written between."""
    panel = merge_panel(periods, roles.entity, how)
    return build_model_ready(build_features(panel, roles, horizon), roles)
