"""Class weights and synthetic minority rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .columns import map_values
from .neighbor_tree import near_in_class
from .neighbors import nearest_in_class
from .ordering import ordered_index
from .series import names

def class_weights(df: DataFrame, label: str, output: str = "weight") -> DataFrame:
    """One row per class: its count and ``n / (classes * count)``."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy(F.lit(0))
    weight = F.sum("n").over(everything) / (F.count(F.lit(1)).over(everything) * F.col("n"))
    return counts.withColumn(output, weight)


def with_class_weights(df: DataFrame, label: str, output: str = "weight") -> DataFrame:
    """Every row with the balanced weight of its class.

    Weights are fetched, one number per class as the model will hold them too, and
    become part of the expression: the table is not moved by a few label values.
    """
    weights = {r[label]: r[output] for r in class_weights(df, label, output).collect()}
    return map_values(df, label, weights, output)


def unit_hash(*parts: Column) -> Column:
    """A repeatable number in [0, 1) from a hash of ``parts``."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))


def smote(
    df: DataFrame,
    label: str,
    features: Sequence[str],
    row_key: str | Sequence[str],
    k: int = 5,
    seed: int = 42,
    exact: bool = False,
    **search,
) -> DataFrame:
    """Grow every class to the size of the largest by interpolated rows.

    A synthetic row starts at a random row of its class and goes a random part
    of the way to one of ``k`` near rows of the class: those that the leaves of a
    pivot tree show (``near_in_class``; its cost grows with the rows alone), or the
    nearest of all with ``exact``. A row for which fewer are found shares
    them out, and without any stands for itself. ``row_key`` tells
    rows apart; ``search`` goes to the search. Result: features as doubles, the label, and ``synthetic``; the
    original rows come first in the union and are kept as they are. Choices
    depend on ``seed`` and the data alone.
    """
    counts = {
        r[label]: r["n"]
        for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()
    }
    if None in counts:
        raise ValueError(f"{label} has nulls")
    most = max(counts.values(), default=0)
    small = sorted(c for c, n in counts.items() if n < most)
    if any(counts[c] == 1 for c in small):
        raise ValueError("a class with one row has no neighbours")
    original = df.select(
        *[F.col(c).cast("double").alias(c) for c in features],
        F.col(label),
        F.lit(False).alias("synthetic"),
    )
    if not small:
        return original

    vector = F.array(*[F.col(c).cast("double") for c in features])
    minority = df.where(F.col(label).isin(small))
    minority = minority.select(
        F.col(label).alias("cls"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(names(row_key))],
        vector.alias("vec"),
    )
    keys = [c for c in minority.columns if c.startswith("_k")]
    members = ordered_index(minority, ["cls", *keys], "id").drop(*keys)

    wanted = _wanted_rows(df, small, counts, most, k, seed)
    picked = wanted.select("id").distinct().withColumn("is_query", F.lit(True))
    rows = members.join(picked, "id", "left").withColumn(
        "is_query", F.coalesce("is_query", F.lit(False))
    )
    near = (nearest_in_class if exact else near_in_class)(rows, k, seed=seed, **search)
    near = near.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("nth", "nid"))).alias("near"))
    start = members.select("id", "cls", F.col("vec").alias("from_vec"))
    end = members.select(F.col("id").alias("nid"), F.col("vec").alias("to_vec"))
    moved = F.zip_with(
        "from_vec", "to_vec", lambda a, b: a + F.col("u") * (b - a)
    )
    made = (
        wanted.join(near, "id", "left")
        .withColumn("nid", F.coalesce(F.expr("get(near, (nth - 1) % greatest(size(near), 1)).nid"), "id"))
        .join(start, "id")
        .join(end, "nid")
        .select("cls", moved.alias("vec"))
        .select(
            *[F.col("vec")[i].alias(c) for i, c in enumerate(features)],
            F.col("cls").alias(label),
            F.lit(True).alias("synthetic"),
        )
    )
    return original.unionByName(made)


def _wanted_rows(df, small, counts, most, k, seed) -> DataFrame:
    """One row per synthetic row: base row id, which neighbour, how far.

    Ids number the small classes' rows class after class, so a class is a range
    of ids.
    """
    total = sum(most - counts[c] for c in small)
    first_j, first_id = 0, 0
    start, size = F, F
    for c in small:
        first_j += most - counts[c]
        mine = F.col("j") < first_j
        start, size = start.when(mine, first_id), size.when(mine, counts[c])
        first_id += counts[c]
    draw = df.sparkSession.range(total).select(
        F.col("id").alias("j"),
    )
    draw = draw.select("j", start.alias("start"), size.alias("size"))
    pick = F.pmod(F.xxhash64(F.lit(seed), F.lit("base"), "j"), F.col("size"))
    neighbours = F.least(F.lit(k), F.col("size") - 1)
    nth = F.pmod(F.xxhash64(F.lit(seed), F.lit("near"), "j"), neighbours) + 1
    return draw.select(
        (F.col("start") + pick).alias("id"),
        nth.cast("int").alias("nth"),
        unit_hash(F.lit(seed), F.lit("way"), F.col("j")).alias("u"),
    )
