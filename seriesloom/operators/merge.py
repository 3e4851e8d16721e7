"""Joins, unions and reshaping."""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from .series import names


def outer_merge_many(
    sources: Sequence[DataFrame], keys: str | Sequence[str], how: str = "join"
) -> DataFrame:
    """Full outer merge of all sources on ``keys``; null keys match each other.

    ``join`` is exact for repeated keys, which multiply: all keys once, then a left
    join per source, whose rows are shuffled once each while the widening result
    keeps its partitioning; two sources are one full join.
    ``stack`` unions the sources and groups once: one shuffle in place of two
    per source, the same rows, but only when every source is unique on the keys;
    a repeated key raises when the result is computed.
    """
    keys = names(keys)
    sources = _without_clashes(sources, keys)
    if how == "stack":
        return _stack(sources, keys)
    if how != "join":
        raise ValueError(f"unknown how: {how}")
    if len(sources) <= 2:
        return reduce(lambda left, right: full_join(left, right, keys), sources)
    every_key = reduce(DataFrame.union, [s.select(*keys) for s in sources]).distinct()
    return reduce(lambda left, right: left_join(left, right, keys), sources, every_key)


def _without_clashes(sources: Sequence[DataFrame], keys: tuple[str, ...]) -> list[DataFrame]:
    """Give value columns that several sources share the suffix of their source."""
    seen = Counter(c for s in sources for c in s.columns if c not in keys)
    out = []
    for i, source in enumerate(sources, start=1):
        renames = {c: f"{c}_{i}" for c in source.columns if seen[c] > 1 and c not in keys}
        out.append(source.withColumnsRenamed(renames))
    return out


def full_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    l, r = left.alias("l"), right.alias("r")
    same = reduce(
        lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    )
    merged_keys = [F.coalesce(F.col(f"l.{k}"), F.col(f"r.{k}")).alias(k) for k in keys]
    values = [F.col(f"l.{c}") for c in left.columns if c not in keys]
    values += [F.col(f"r.{c}") for c in right.columns if c not in keys]
    return l.join(r, same, "full").select(*merged_keys, *values)


def left_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every row of ``left`` with its matches in ``right``; null keys match each other."""
    l, r = left.alias("l"), right.alias("r")
    same = reduce(
        lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    )
    values = [F.col(f"r.{c}") for c in right.columns if c not in keys]
    return l.join(r, same, "left").select("l.*", *values)


def _stack(sources: Sequence[DataFrame], keys: tuple[str, ...]) -> DataFrame:
    tagged = [s.withColumn("_source", F.lit(i)) for i, s in enumerate(sources)]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    values = [c for s in sources for c in s.columns if c not in keys]
    once = [F.count_if(F.col("_source") == i) <= 1 for i in range(len(sources))]
    grouped = stacked.groupBy(*keys).agg(
        *[F.max(c).alias(c) for c in values],
        reduce(lambda a, b: a & b, once).alias("_unique"),
    )
    checked = F.assert_true(F.col("_unique"), F.lit("a source repeats a key; use how='join'"))
    return grouped.where(checked.isNull()).drop("_unique")


def lookup_join(df: DataFrame, lookup: DataFrame, left_on: str, right_on: str) -> DataFrame:
    """Inner join on differently named keys. The lookup is broadcast if Spark
    measures it as small enough, and shuffled otherwise."""
    return df.join(lookup, df[left_on] == lookup[right_on], "inner")


def scalar_lookup(lookup: DataFrame, key: str, value, name: str) -> DataFrame:
    """The ``name`` of one id."""
    return lookup.where(F.col(key) == F.lit(value)).select(key, name)


def align_predictions(
    truth: DataFrame, predictions: Mapping[str, DataFrame], keys: str | Sequence[str]
) -> DataFrame:
    """Each model's ``prediction`` beside the truth, by key and not by position."""
    keys = list(names(keys))
    out = truth
    for column, table in predictions.items():
        out = out.join(table.select(*keys, F.col("prediction").alias(column)), keys, "left")
    return out


def union_by_name(tables: Sequence[DataFrame]) -> DataFrame:
    """Stack tables; columns one lacks are null, repeated rows stay."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def melt(
    df: DataFrame,
    ids: Sequence[str],
    values: Sequence[str] | None = None,
    var_name: str = "variable",
    value_name: str = "value",
) -> DataFrame:
    """Wide to long; all columns outside ``ids`` by default."""
    if values is None:
        values = [c for c in df.columns if c not in ids]
    return df.unpivot(list(ids), list(values), var_name, value_name)
