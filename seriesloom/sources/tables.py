"""Reading and writing tables."""

from __future__ import annotations

import uuid
from collections.abc import Hashable, Mapping

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import DoubleType, FloatType, StructType


def read_table(
    spark: SparkSession, path: str, schema: StructType | None = None, nan_is_missing: bool = True
) -> DataFrame:
    """Read a parquet folder, or a CSV with a header when the path ends in ``.csv``.

    A CSV needs its schema: inference would read the data once more, and types
    would depend on the rows. NaN in any floating column becomes null, so that
    "missing" has one form from here on, unless ``nan_is_missing`` is false.
    """
    if path.rstrip("/").endswith(".csv"):
        if schema is None:
            raise ValueError("reading CSV needs an explicit schema")
        df = spark.read.schema(schema).option("header", True).csv(path)
    else:
        df = (spark.read if schema is None else spark.read.schema(schema)).parquet(path)
    return nan_to_null(df) if nan_is_missing else df


def nan_to_null(df: DataFrame) -> DataFrame:
    floating = [f.name for f in df.schema if isinstance(f.dataType, (DoubleType, FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floating})


def read_many(
    spark: SparkSession,
    paths: Mapping[Hashable, str],
    schemas: Mapping[Hashable, StructType] | None = None,
) -> dict[Hashable, DataFrame]:
    """One lazy DataFrame per entry of ``paths``, under the same key."""
    schemas = schemas or {}
    return {key: read_table(spark, path, schemas.get(key)) for key, path in paths.items()}


def write_table(df: DataFrame, path: str) -> str:
    """Overwrite ``path`` with parquet, or CSV with a header for ``*.csv``."""
    writer = df.write.mode("overwrite")
    if path.rstrip("/").endswith(".csv"):
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)
    return path


def write_metrics_json(metrics: DataFrame, path: str) -> str:
    metrics.write.mode("overwrite").json(path)
    return path


def row_count(df: DataFrame) -> DataFrame:
    """Rows and columns of a table, as one row."""
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(df.columns)))


def counted(df: DataFrame, name: str, counts: dict[str, Observation]) -> DataFrame:
    """The table, whose rows are counted by whatever action runs over it first.

    No job of its own: the number is in ``counts`` under ``name`` once the rows have been
    written or collected (``row_counts``).
    """
    counts[name] = Observation(f"{name} {uuid.uuid4().hex}")
    return df.observe(counts[name], F.count(F.lit(1)).alias("rows"))


def row_counts(spark: SparkSession, counts: Mapping[str, Observation]) -> DataFrame:
    """stage and rows of every counted table; waits for the action that counts them."""
    return spark.createDataFrame([(name, seen.get["rows"]) for name, seen in counts.items()], "stage string, rows long")
