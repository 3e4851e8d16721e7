"""Projections, filters and schema operations."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import strip_whitespace, title_case


def normalize_key(df: DataFrame, column: str) -> DataFrame:
    """Key to text without outer whitespace, in title case; missing becomes ``Nan``."""
    text = F.col(column).cast("string")
    return df.withColumn(column, F.coalesce(title_case(strip_whitespace(text)), F.lit("Nan")))


def split_date(df: DataFrame, column: str = "start_date") -> DataFrame:
    """Replace a date column by year and month; no such column, no change."""
    if column not in df.columns:
        return df
    date = F.to_date(column)
    return df.withColumns({"year": F.year(date), "month": F.month(date)}).drop(column)


def make_month_date(
    df: DataFrame, year: str = "year", month: str = "month", output: str = "date"
) -> DataFrame:
    return df.withColumn(output, F.make_date(year, month, F.lit(1)))


def parse_date(df: DataFrame, column: str, fmt: str | None = None) -> DataFrame:
    return df.withColumn(column, F.to_date(column, fmt) if fmt else F.to_date(column))


def cyclic_encode(df: DataFrame, column: str, period: float = 12) -> DataFrame:
    """Add ``{column}_sin`` and ``{column}_cos`` of the position in the period."""
    angle = F.lit(2 * math.pi) * F.col(column) / F.lit(float(period))
    return df.withColumns({f"{column}_sin": F.sin(angle), f"{column}_cos": F.cos(angle)})


def drop_null_rows(df: DataFrame) -> DataFrame:
    """Drop rows with any null; infinities stay."""
    return df.dropna("any")


def drop_null_subset(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    return df.dropna(subset=list(columns))


def drop_if_exists(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.drop(*columns)


def drop_columns_like(df: DataFrame, part: str) -> DataFrame:
    """Drop columns whose name contains ``part``."""
    return df.select(*[c for c in df.columns if part not in c])


def feature_columns(df: DataFrame, exclude: Iterable[str]) -> list[str]:
    skip = set(exclude)
    return [c for c in df.columns if c not in skip]


def select_features(df: DataFrame, exclude: Iterable[str]) -> DataFrame:
    return df.select(*feature_columns(df, exclude))


def align_to_schema(df: DataFrame, order: Sequence[str], fill: float = 0.0) -> DataFrame:
    """Project to a saved column order; columns that are absent hold ``fill``."""
    present = set(df.columns)
    return df.select(*[F.col(c) if c in present else F.lit(fill).alias(c) for c in order])


def cast_columns(df: DataFrame, columns: Iterable[str], type_name: str = "string") -> DataFrame:
    return df.withColumns({c: F.col(c).cast(type_name) for c in columns})


def filter_isin(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    return df.where(F.col(column).isin(list(values)))


def filter_eq(df: DataFrame, column: str, value) -> DataFrame:
    return df.where(F.col(column) == F.lit(value))


def flag_correct(df: DataFrame, truth: str, prediction: str, output: str = "correct") -> DataFrame:
    """Whether prediction and truth agree; false if one is missing."""
    agrees = F.col(prediction) == F.col(truth)
    return df.withColumn(output, F.coalesce(agrees, F.lit(False)))


def map_values(df: DataFrame, column: str, mapping: Mapping, output: str) -> DataFrame:
    """Look a value up in a driver-side dict; values without an entry give null.

    The dict becomes part of the expression: the table is not moved.
    """
    if not mapping:
        return df.withColumn(output, F.lit(None).cast("double"))
    kind = df.schema[column].dataType
    pairs = [x for k, v in mapping.items() for x in (F.lit(k).cast(kind), F.lit(float(v)))]
    found = F.try_element_at(F.create_map(*pairs), F.col(column))
    return df.withColumn(output, found)


def argmax_class(probabilities: Column) -> Column:
    """0-based position of the largest element of an array, the first on ties."""
    return (F.array_position(probabilities, F.array_max(probabilities)) - 1).cast("int")


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns).distinct()


def hconcat(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Put computed columns beside the existing ones, row by row."""
    return df.withColumns(dict(columns))
