"""Sources, columns, joins, orderings, encodings and splits."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from seriesloom.operators import columns as cols
from seriesloom.operators.encode import (
    categories,
    label_classes,
    label_decode,
    label_encode,
    one_hot_encode,
    standard_scale,
)
from seriesloom.operators.merge import align_predictions, melt, outer_merge_many, union_by_name
from seriesloom.operators.ordering import ordered_index, rows_at
from seriesloom.operators.split import fold, fold_blocks, split_ratio, timeseries_folds
from seriesloom.sources import read_table, stage, write_table
from seriesloom.sources.staging import staging_root


@pytest.fixture(scope="module")
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def rows(df, *keys):
    return sorted((tuple(r) for r in df.collect()), key=lambda t: tuple(map(str, t)))


def test_staging_uses_the_session_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        assert staging_root(spark) == root.rstrip("/")
    staged = stage(spark.range(5), "x")
    assert staged.count() == 5
    assert all(f.startswith(f"file:{staging_root(spark)}/seriesloom/x-") or f.startswith(
        f"file://{staging_root(spark)}/seriesloom/x-") for f in staged.inputFiles())


def test_csv_keeps_infinity_and_turns_nan_to_null(spark, tmp_path):
    df = spark.createDataFrame(
        [("a", float("-inf")), ("b", float("nan")), ("c", None), ("d", 1.5)], "k string, v double"
    )
    path = write_table(df, str(tmp_path / "t.csv"))
    back = {r.k: r.v for r in read_table(spark, path, df.schema).collect()}
    assert back == {"a": float("-inf"), "b": None, "c": None, "d": 1.5}
    with pytest.raises(ValueError):
        read_table(spark, path)


def test_normalize_key_and_dates(spark):
    df = spark.createDataFrame([(" o'neil-x \t",), (None,)], "k string")
    assert sorted(r.k for r in cols.normalize_key(df, "k").collect()) == ["Nan", "O'Neil-X"]
    assert cols.split_date(df) is df
    dated = spark.createDataFrame([("2020-03-31",)], "start_date string")
    assert tuple(cols.split_date(dated).first()) == (2020, 3)


def test_drop_null_keeps_infinity_and_names_missing_columns(spark):
    df = spark.createDataFrame([(float("-inf"), 1), (None, 2)], "v double, w int")
    assert cols.drop_null_rows(df).count() == 1
    with pytest.raises(ValueError):
        cols.drop_null_subset(df, ["v", "target"])


def test_argmax_takes_the_first(spark):
    df = spark.createDataFrame([([0.2, 0.4, 0.4],)], "p array<double>")
    assert df.select(cols.argmax_class(F.col("p"))).first()[0] == 1


def test_outer_merge(spark):
    a = spark.createDataFrame([("x", 1, 1.0), ("x", 1, 2.0), (None, 2, 3.0)], "e string, t int, p double")
    b = spark.createDataFrame([("x", 1, 5.0), ("y", 1, 6.0), (None, 2, 7.0)], "e string, t int, q double")
    merged = outer_merge_many([a, b], ["e", "t"])
    assert rows(merged) == sorted(
        [("x", 1, 1.0, 5.0), ("x", 1, 2.0, 5.0), ("y", 1, None, 6.0), (None, 2, 3.0, 7.0)],
        key=lambda t: tuple(map(str, t)),
    )
    with pytest.raises(Exception, match="repeats a key"):
        outer_merge_many([a, b], ["e", "t"], "stack").collect()
    once = a.where("p != 2")
    both = [rows(outer_merge_many([once, b], ["e", "t"], how)) for how in ("join", "stack")]
    assert both[0] == both[1]


def test_clashing_columns_get_suffixes(spark):
    a = spark.createDataFrame([(1, 1.0)], "k int, v double")
    assert outer_merge_many([a, a], ["k"]).columns == ["k", "v_1", "v_2"]


def test_align_union_melt(spark):
    truth = spark.createDataFrame([(1, "a"), (2, "b")], "k int, y string")
    p = spark.createDataFrame([(2, "b"), (1, "c")], "k int, prediction string")
    assert rows(align_predictions(truth, {"m": p}, "k")) == [(1, "a", "c"), (2, "b", "b")]
    assert rows(union_by_name([truth, truth.drop("y")])) == sorted(
        [(1, "a"), (2, "b"), (1, None), (2, None)], key=lambda t: tuple(map(str, t)))
    assert melt(truth.withColumn("z", F.lit("q")), ["k"]).count() == 4


def test_ordered_index(spark, many_ranges):
    values = [(f"n{i:04d}",) for i in random.Random(1).sample(range(3000), 700)]
    got = ordered_index(spark.createDataFrame(values, "v string"), "v", "i").collect()
    assert {r.v: r.i for r in got} == {v: i for i, (v,) in enumerate(sorted(values))}


def test_rows_at(spark, many_ranges):
    df = spark.createDataFrame([(i // 300, i) for i in range(900)], "d int, k int")
    n, keys = rows_at(df, ["d", "k"], lambda n: [0, 450, n - 1, n])
    assert (n, keys) == (900, [(0, 0), (1, 450), (2, 899), None])


def test_labels(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("a",)], "y string")
    classes = label_classes(df, "y")
    assert {r.y: r.code for r in classes.collect()} == {"a": 0, "b": 1, "c": 2}
    coded = label_encode(df, "y", "z", classes)
    assert rows(label_decode(coded.select("z"), "z", "y", classes).select("y")) == rows(df)
    unseen = spark.createDataFrame([("d",)], "y string")
    with pytest.raises(Exception, match="unseen label: d"):
        label_encode(unseen, "y", "z", classes).collect()


def test_one_hot(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "d string")
    out = one_hot_encode(df, "d")
    assert out.columns == ["d_b", "d_c"]
    assert rows(out) == [(0.0, 0.0), (0.0, 1.0), (1.0, 0.0)]
    assert rows(one_hot_encode(spark.createDataFrame([("z",)], "d string"), "d", ["a", "b"])) == [(0.0,)]
    with pytest.raises(ValueError):
        categories(df, "d", limit=2)


def test_standard_scale(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "v double, c double")
    assert rows(standard_scale(df, ["v", "c"]).select("v_scaled", "c_scaled")) == [(-1.0, 0.0), (1.0, 0.0)]


@pytest.fixture(scope="module")
def dated(spark):
    """103 rows, most of them on one date."""
    out = []
    for i in range(103):
        day = dt.date(2020, 1, 1) + dt.timedelta(days=0 if i < 10 else 5 if i < 90 else i)
        out.append((day, f"e{i:03d}"))
    return spark.createDataFrame(out, "date date, e string").repartition(3).cache()


def test_split_ratio_cuts_inside_a_date(dated, many_ranges):
    train, test = split_ratio(dated, ["date", "e"], 0.8)
    order = sorted(rows(dated))
    assert sorted(rows(train)) == order[:82]
    assert sorted(rows(test)) == order[82:]


def test_folds(dated, many_ranges):
    order = sorted(rows(dated))
    blocks = fold_blocks(dated, ["date", "e"], 5)
    size = 103 // 6
    for i in range(1, 6):
        train, test = (sorted(rows(part.drop("fold_block"))) for part in fold(blocks, i))
        start = 103 - (6 - i) * size
        assert train == order[:start]
        assert test == order[start : start + size]
    long = timeseries_folds(dated, ["date", "e"], 5)
    assert long.where("role = 'test'").groupBy("date", "e").count().where("count > 1").count() == 0
    with pytest.raises(ValueError):
        fold_blocks(dated.limit(3), ["date", "e"], 5)
