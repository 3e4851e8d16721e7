"""Missing and equal keys in splits, missing predictions, NaN in files, small keys in plans."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from seriesloom.operators import balance, columns, merge, report, split
from seriesloom.sources import tables


def sizes(parts):
    return [p.count() for p in parts]


def test_ratio_with_missing_keys(spark):
    rows = [(None, i) for i in range(9)] + [(5, 9)]
    df = spark.createDataFrame(rows, "k int, v int")
    early, late = split.split_ratio(df, ["k", "v"], 0.5)
    assert sizes((early, late)) == [5, 5]
    assert {r.v for r in early.collect()} == set(range(5)) and late.columns == ["k", "v"]


def test_ratio_with_equal_keys(spark):
    df = spark.createDataFrame([(1, i) for i in range(10)], "k int, v int")
    early, late = split.split_ratio(df, "k", 0.5)
    assert sizes((early, late)) == [5, 5]
    assert {r.v for r in early.collect()} | {r.v for r in late.collect()} == set(range(10))


def test_folds_with_equal_and_missing_keys(spark):
    df = spark.createDataFrame([(None if i < 4 else 7, i) for i in range(12)], "k int, v int")
    folds = split.timeseries_folds(df, "k", 3).groupBy("fold", "role").count().collect()
    assert {(r.fold, r.role): r["count"] for r in folds} == {
        (1, "train"): 3, (1, "test"): 3, (2, "train"): 6, (2, "test"): 3, (3, "train"): 9, (3, "test"): 3,
    }


def test_missing_prediction_is_an_error_and_no_class(spark):
    df = spark.createDataFrame([("a", "a"), ("a", None), ("b", "b")], "t string, p string")
    rows = report.classification_report(df, "t", "p").collect()
    assert None not in [r["label"] for r in rows]
    assert report.f1_macro(df, "t", "p").first()[0] == pytest.approx((2 / 3 + 1) / 2)


@pytest.mark.parametrize("kind", ["csv", "parquet"])
def test_nan_in_files_is_missing(spark, tmp_path, kind):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    path = str(tmp_path / f"t.{kind}")
    df.coalesce(1).write.parquet(path) if kind == "parquet" else df.coalesce(1).write.option("header", True).csv(path)
    read = tables.read_table(spark, path, df.schema)
    assert [r.x for r in read.where("x IS NOT NULL").collect()] == [1.0]
    kept = tables.read_table(spark, path, df.schema, nan_is_missing=False)
    assert sum(r.x is not None and math.isnan(r.x) for r in kept.collect()) == 1


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_few_values_move_no_table(spark):
    df = spark.range(100).select("id", F.when(F.col("id") < 90, "a").when(F.col("id") < 99, "b").alias("label"))
    mapped = columns.map_values(df, "label", {"a": 1, "c": 2}, "code")
    assert {(r.label, r.code) for r in mapped.collect()} == {("a", 1.0), ("b", None), (None, None)}
    weighted = balance.with_class_weights(df, "label")
    assert {(r.label, r.weight) for r in weighted.collect()} == {("a", 99 / 180), ("b", 99 / 18), (None, None)}
    for frame in (mapped, weighted, columns.map_values(df, "label", {}, "code")):
        assert "Exchange" not in plan(frame) and "Join" not in plan(frame)


def test_merging_many_sources_shuffles_each_once(spark):
    rows = [[(1, "a"), (1, "b"), (None, "c")], [(1, "d"), (2, "e"), (2, "f")], [(None, "g"), (3, "h")], [(2, "i"), (1, "j")], [(4, "k")]]
    sources = [spark.createDataFrame(r, f"k int, v{i} string") for i, r in enumerate(rows)]
    merged = merge.outer_merge_many(sources, "k")
    wanted = set()
    for k in (1, 2, 3, 4, None):
        found = [[v for key, v in r if key == k] or [None] for r in rows]
        wanted |= {(k, *v) for v in itertools.product(*found)}
    assert {tuple(r) for r in merged.collect()} == wanted and merged.count() == len(wanted)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert plan(merge.outer_merge_many(sources, "k")).count("Exchange hashpartitioning") < 2 * (len(sources) - 1)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
