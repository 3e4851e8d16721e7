"""Label, one-hot and scale encodings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from .ordering import ordered_index


def label_classes(df: DataFrame, column: str, code: str = "code") -> DataFrame:
    """The distinct values of ``column`` with codes 0, 1, ... in sorted order."""
    return ordered_index(df.select(column).distinct(), column, code).withColumn(
        code, F.col(code).cast("int")
    )


def label_encode(df: DataFrame, column: str, output: str, classes: DataFrame) -> DataFrame:
    """Replace labels by the codes of ``classes``; an unseen label raises."""
    table = classes.select(F.col(column), F.col("code").alias(output))
    unseen = F.raise_error(F.concat(F.lit("unseen label: "), F.coalesce(column, F.lit("null"))))
    code = F.coalesce(F.col(output), unseen.cast("int"))
    return df.join(table, column, "left").select(*df.columns, code.alias(output))


def label_decode(df: DataFrame, code: str, output: str, classes: DataFrame) -> DataFrame:
    """Codes back to labels."""
    label = next(c for c in classes.columns if c != "code")
    table = classes.select(F.col("code").alias(code), F.col(label).alias(output))
    return df.join(table, code, "left").select(*df.columns, output)


def categories(df: DataFrame, column: str, limit: int = 1000) -> list:
    """Sorted distinct values, for use as columns; more than ``limit`` is an error."""
    rows = df.select(column).where(F.col(column).isNotNull()).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{column} has more than {limit} values; too many for columns")
    return sorted(r[0] for r in rows)


def one_hot_encode(df: DataFrame, column: str, values: Sequence | None = None) -> DataFrame:
    """Replace ``column`` by indicator columns ``{column}_{value}``.

    The first value has no column. Values outside ``values`` are zero everywhere.
    """
    if values is None:
        values = categories(df, column)
    indicators = {
        f"{column}_{v}": F.when(F.col(column) == F.lit(v), 1.0).otherwise(0.0) for v in values[1:]
    }
    return df.withColumns(indicators).drop(column)


def standard_scale(df: DataFrame, columns: Sequence[str], suffix: str = "_scaled") -> DataFrame:
    """Z-scores over the whole table with the population deviation.

    A constant column is only centred.
    """
    stats = [F.avg(c).alias(f"mean_{c}") for c in columns]
    stats += [F.stddev_pop(c).alias(f"std_{c}") for c in columns]
    fitted = df.agg(F.struct(*stats).alias("s")).select("s").scalar()
    out = df.withColumn("_s", fitted)
    scaled = {
        f"{c}{suffix}": (F.col(c) - F.col(f"_s.mean_{c}"))
        / F.when(F.col(f"_s.std_{c}") == 0, 1.0).otherwise(F.col(f"_s.std_{c}"))
        for c in columns
    }
    return out.withColumns(scaled).drop("_s")
