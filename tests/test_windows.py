import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesloom.operators.series import CHUNK, Series, chunked
from seriesloom.operators.indices import (
    classify_threshold,
    gamma_fit,
    spei,
    spi,
)
from seriesloom.operators.windows import (
    group_apply,
    group_stream,
    interpolate_linear,
    lag_features,
    lead_target,
    multi_horizon_targets,
    percentile_of_score,
    rolling_mean,
    rolling_sum,
    sequence_windows,
    zscore_anomaly,
)

SERIES = Series.of("e", "t")


def series_of(spark, values, entity="a"):
    rows = [(entity, i, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "e string, t int, v double")


def ordered(df, column):
    return [r[column] for r in df.orderBy("e", "t").collect()]


@pytest.fixture(scope="module")
def skewed(spark):
    """One entity holds most rows, some have very few, one has no value."""
    rng = random.Random(7)
    rows = []
    for entity, n in (("big", 400), ("b", 40), ("c", 3), ("d", 1), ("empty", 9)):
        for t in range(n):
            known = entity != "empty" and rng.random() > 0.4
            rows.append((entity, t * 3, rng.choice([1.0, 2.5, 4.0, rng.random() * 9]) if known else None,
                         rng.random() * 8))
    rows += [(None, t, rng.random(), rng.random()) for t in range(90)]
    return spark.createDataFrame(rows, "e string, t int, v double, u double").repartition(4).cache()


@pytest.fixture(scope="module")
def pieces(spark, skewed):
    """The same rows in eight ranges, most of them inside the big entity."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df, series = chunked(skewed, SERIES)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert df.where("e = 'big'").select(CHUNK).distinct().count() > 3
    return df, series


def test_interpolation_toy(spark):
    df = interpolate_linear(series_of(spark, [None, 1.0, None, None, 4.0, None]), SERIES)
    assert ordered(df, "v") == [1.0, 1.0, 2.0, 3.0, 4.0, 4.0]


def test_interpolation_without_values(spark):
    assert ordered(interpolate_linear(series_of(spark, [None, None]), SERIES), "v") == [None, None]


def test_rolling_toys(spark):
    df = series_of(spark, [1.0, None, 3.0, 4.0])
    assert ordered(rolling_sum(df, SERIES, {"s": "v"}, 3), "s") == [None] * 4
    assert ordered(rolling_sum(df, SERIES, {"s": "v"}, 2), "s") == [None, None, None, 7.0]
    assert ordered(rolling_mean(df, SERIES, {"s": "v"}, 3), "s") == [1.0, 1.0, 2.0, 3.5]


def test_percentile_toy(spark):
    df = percentile_of_score(series_of(spark, [5.0, 7.0, 7.0, 9.0, None]), SERIES, {"p": "v"})
    assert ordered(df, "p") == [25.0, 62.5, 62.5, 100.0, None]


def test_zscore(spark):
    assert ordered(zscore_anomaly(series_of(spark, [5.0] * 3), SERIES, {"z": "v"}), "z") == [None] * 3
    values = [1.0, 2.0, 4.0]
    s = pd.Series(values)
    got = ordered(zscore_anomaly(series_of(spark, values), SERIES, {"z": "v"}), "z")
    assert got == pytest.approx(list((s - s.mean()) / s.std()))


def test_sequences_exclude_the_row_itself(spark):
    df = sequence_windows(series_of(spark, [0.0, 1.0, 2.0, 3.0, 4.0]), SERIES, ["v"], 3)
    got = {r.t: [x for (x,) in r.seq] for r in df.collect()}
    assert got == {3: [0.0, 1.0, 2.0], 4: [1.0, 2.0, 3.0]}


def test_double_lead(spark):
    df = series_of(spark, [float(i) for i in range(8)])
    df = lead_target(df, SERIES, "v", 3, "future")
    df = multi_horizon_targets(df, SERIES, "future")
    first = df.orderBy("t").first()
    assert (first.future, first.target_1m_ahead, first.target_3m_ahead) == (3.0, 4.0, 6.0)


def test_classify(spark):
    values = [float("-inf"), -1.5, -1.0, 0.0, None, float("nan")]
    df = series_of(spark, values).withColumn("k", classify_threshold(F.col("v")))
    assert ordered(df, "k") == ["Extreme", "Extreme", "Moderate", "No Drought", "No Drought", "No Drought"]


def test_spei_below_zero_balance_is_minus_infinity(spark):
    rows = [("a", t, float(5 + t % 4), 0.0 if t < 20 else 50.0) for t in range(24)]
    df = spark.createDataFrame(rows, "e string, t int, p double, q double")
    got = ordered(spei(df, SERIES, "p", "q", 3, "i"), "i")
    assert got[:2] == [None, None]
    assert got[-1] == float("-inf")
    assert all(-4 < x < 4 for x in got[2:20])


def test_index_needs_k_positive_sums_and_spread(spark):
    df = series_of(spark, [1.0, 2.0, 3.0, 4.0]).unionByName(series_of(spark, [2.0] * 9, "const"))
    got = {e: [r.i for r in rows] for e, rows in (
        (e, spi(df, SERIES, "v", 3, "i").where(F.col("e") == e).orderBy("t").collect())
        for e in ("a", "const"))}
    assert got["a"] == [None] * 4  # two sums, fewer than k
    assert got["const"] == [None] * 9


def test_spi_is_standardised(spark):
    rng = random.Random(3)
    df = series_of(spark, [rng.gammavariate(3, 10) for _ in range(600)])
    r = spi(df, SERIES, "v", 3, "i").agg(F.avg("i").alias("m"), F.stddev("i").alias("s")).first()
    assert abs(r.m) < 0.1 and abs(r.s - 1) < 0.1


def test_gamma_fit_recovers_parameters(spark):
    rng = random.Random(5)
    df = series_of(spark, [rng.gammavariate(4, 2) for _ in range(4000)])
    r = gamma_fit(df, "e", "v", 3).first()
    assert r["shape"] == pytest.approx(4, rel=0.1) and r["scale"] == pytest.approx(2, rel=0.1)


def same(plain, other, columns):
    keys = ["e", "t"]
    a = plain.select(*keys, *columns).orderBy(*keys).collect()
    b = other.select(*keys, *columns).orderBy(*keys).collect()
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for c in keys + columns:
            if isinstance(x[c], float) and y[c] is not None:
                assert y[c] == pytest.approx(x[c], rel=1e-9, abs=1e-9), (x, y)
            else:
                assert x[c] == y[c], (c, x, y)


OPERATORS = {
    "rolling_sum": (lambda d, s: rolling_sum(d, s, {"o": "u"}, 6), ["o"]),
    "rolling_mean": (lambda d, s: rolling_mean(d, s, {"o": "v"}, 50), ["o"]),
    "lag": (lambda d, s: lag_features(d, s, ["v"], (1, 3, 70)), ["v_lag1", "v_lag3", "v_lag70"]),
    "lead": (lambda d, s: lead_target(d, s, "v", 65, "o"), ["o"]),
    "sequences": (lambda d, s: sequence_windows(d, s, ["v", "u"], 12), ["seq"]),
    "interpolate": (lambda d, s: interpolate_linear(d, s, ["v", "u"]), ["v", "u"]),
    "zscore": (lambda d, s: zscore_anomaly(d, s, {"o": "v"}), ["o"]),
    "percentile": (lambda d, s: percentile_of_score(d, s, {"o": "v", "o2": "u"}), ["o", "o2"]),
    "spi": (lambda d, s: spi(d, s, "u", 3, "o"), ["o"]),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_chunks_do_not_change_results(spark, skewed, pieces, name):
    operator, columns = OPERATORS[name]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        same(operator(skewed, SERIES), operator(*pieces), columns)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_chained_operators_read_the_table_once_per_operator(pieces):
    """Copied rows must not bring the earlier operators along."""
    df, series = pieces
    for i in range(4):
        df = rolling_mean(df, series, {f"m{i}": "v"}, 2 + i)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 1 + 4 * 2


def test_long_gap_over_many_chunks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        values = [0.0] + [None] * 298 + [299.0]
        df, series = chunked(series_of(spark, values), SERIES)
        assert df.select(CHUNK).distinct().count() > 4
        assert ordered(interpolate_linear(df, series), "v") == pytest.approx(list(range(300)))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_interpolation_matches_pandas(skewed):
    skewed = skewed.where("e IS NOT NULL")
    pdf = skewed.toPandas().sort_values(["e", "t"])
    want = pdf.groupby("e")["v"].transform(lambda g: g.interpolate(limit_direction="both"))
    got = ordered(interpolate_linear(skewed, SERIES, ["v"]), "v")
    assert pd.Series(got, dtype=float).tolist() == pytest.approx(want.tolist(), nan_ok=True)


def test_group_apply_checks_its_groups(skewed):
    fn = lambda pdf: pdf[["e", "t"]].tail(1)
    assert group_apply(skewed, "e", fn, "e string, t int", 400).count() == 6
    with pytest.raises(ValueError):
        group_apply(skewed, "e", fn, "e string, t int", 399)


def test_group_stream_carries_its_state(spark):
    """One entity of ten batches, a null key, and batches that hold several entities."""
    rows = [("big", i, 1.0) for i in range(1000)] + [(e, i, 2.0) for e in ("a", "b", None) for i in range(7)]
    df = spark.createDataFrame(rows, "e string, t int, v double").repartition(6)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:

        def step(state, pdf):
            largest, so_far = state
            out = pdf.assign(total=so_far + pdf["v"].cumsum())[["e", "t", "total"]]
            return (max(largest, len(pdf)), out["total"].iloc[-1]), out

        def finish(key, state):
            import pandas as pd

            return pd.DataFrame({"e": [key[0]], "t": [-state[0]], "total": [state[1]]})

        out = group_stream(df, "e", "t", lambda key: (0, 0.0), step, "e string, t int, total double", finish).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {(r.e, r.t): r.total for r in out if r.t >= 0} == {(e, t): (t + 1) * v for e, t, v in rows}
    ends = {r.e: (-r.t, r.total) for r in out if r.t < 0}
    assert ends["big"][1] == 1000 and ends["big"][0] <= 100
    assert {e: total for e, (_, total) in ends.items() if e != "big"} == {"a": 14, "b": 14, None: 14}



def large_joins(df):
    """Joins that are not with a table of one row per range, by the plan before it runs."""
    plan = df._jdf.queryExecution().sparkPlan().toString()
    return [line for line in plan.splitlines() if "SortMergeJoin" in line or "ShuffledHashJoin" in line]


@pytest.mark.parametrize("kind", ["ties", "nulls", "mixed"])
def test_chunked_statistics_need_no_join_on_the_entity(spark, kind):
    """Half of the rows hold one value, most rows one entity, in small ranges."""
    rng = random.Random(9)
    rows = []
    for i in range(900):
        value = 5.0 if i % 2 else round(rng.random() * 12 - 1, 1)
        if kind == "nulls" and i % 3 == 0:
            value = None
        if kind == "mixed":
            value = None if i % 7 == 0 else float(rng.randrange(3))
        rows.append(("big" if i % 9 else f"e{i % 4}", i, value))
    rows += [("none", i, None) for i in range(5)] + [("one", 0, 1.5), (None, 0, 1.0), (None, 1, 2.0)]
    df = spark.createDataFrame(rows, "e string, t int, v double")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        cut, series = chunked(df, SERIES)
        functions = [
            lambda d, s: percentile_of_score(d, s, {"p": "v"}),
            lambda d, s: zscore_anomaly(d, s, {"z": "v"}),
            lambda d, s: spi(d, s, "v", 3, "x"),
        ]
        for function in functions:
            found = function(cut, series)
            assert not large_joins(found)
            got = {(r.e, r.t): r[-1] for r in found.drop(series.chunk).collect()}
            want = {(r.e, r.t): r[-1] for r in function(df, SERIES).collect()}
            assert got.keys() == want.keys() and len(got) == len(rows)
            for k in want:
                assert got[k] == (pytest.approx(want[k], rel=1e-8, abs=1e-9) if want[k] is not None else None), (k, got[k], want[k])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_frequent_value_is_ranked_in_many_tasks(spark):
    df = spark.createDataFrame([("a", i, 1.0 if i % 2 else float(i)) for i in range(2000)], "e string, t int, v double")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        cut, series = chunked(df, SERIES)
        by_value, ranges = chunked(cut.withColumnRenamed(series.chunk, "_own"), Series.of("e", ["v", "t"]))
        counts = [r["count"] for r in by_value.where("v = 1.0").groupBy(ranges.chunk).count().collect()]
        assert len(counts) > 6 and max(counts) < 300
        assert percentile_of_score(cut, series, {"p": "v"}).where("v = 1.0").select("p").distinct().count() == 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
