import math
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from seriesloom.functions import (
    digamma,
    gamma_cdf,
    gamma_shape,
    log_gamma,
    norm_ppf,
    title_case,
    strip_whitespace,
)


def column(spark, values, kind="double"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def evaluate(df, expr):
    return [r.out for r in df.select("i", expr.alias("out")).orderBy("i").collect()]


def test_title_case_follows_python(spark):
    texts = [" o'neil-x \t", "AHMADNAGAR city", "3rd ward", "", "été à l'île", "NATION_0", "a "]
    got = evaluate(column(spark, texts, "string"), title_case(strip_whitespace(F.col("v"))))
    assert got == [t.strip().title() for t in texts]


def test_log_gamma(spark):
    values = [1e-3, 0.3, 1.0, 2.5, 10.0, 123.4, 1e5]
    got = evaluate(column(spark, values), log_gamma("v"))
    assert got == pytest.approx([math.lgamma(v) for v in values], rel=1e-12, abs=1e-12)


def test_digamma_is_the_slope_of_log_gamma(spark):
    values = [0.3, 1.0, 2.5, 40.0]
    got = evaluate(column(spark, values), digamma("v"))
    h = 1e-5
    slope = [(math.lgamma(v + h) - math.lgamma(v - h)) / (2 * h) for v in values]
    assert got == pytest.approx(slope, rel=1e-6, abs=1e-6)


def test_gamma_shape(spark):
    got = evaluate(column(spark, [0.3, 2.0, 0.0, None]), gamma_shape("v"))
    assert got[:2] == pytest.approx([1.815550, 0.338117], abs=1e-6)
    assert got[2:] == [None, None]


def test_gamma_cdf(spark):
    rows = [(0, 3.0, 2.5), (1, 62.0, 50.0), (2, -1.0, 2.0), (3, 1e4, 2.0), (4, None, 2.0), (5, 1.5, 1.0)]
    df = spark.createDataFrame(rows, "i int, x double, a double")
    got = evaluate(df, gamma_cdf("x", "a", "1.0D"))
    assert got[:2] == pytest.approx([0.693781, 0.947801], abs=1e-6)
    assert got[2:5] == [0.0, 1.0, None]
    assert got[5] == pytest.approx(1 - math.exp(-1.5), abs=1e-13)


def test_gamma_cdf_with_large_shapes(spark):
    rows = [(i, a, a) for i, a in enumerate([500.0, 5_000.0, 100_000.0])]
    df = spark.createDataFrame(rows, "i int, x double, a double")
    got = evaluate(df, gamma_cdf("x", "a", "1.0D"))
    # at its mean the distribution function is 1/2 + 1/(3 sqrt(2 pi a)) + ...
    want = [0.5 + 1 / (3 * math.sqrt(2 * math.pi * a)) for _, a, _ in rows]
    assert got == pytest.approx(want, abs=1e-5)


def test_norm_ppf(spark):
    values = [1e-300, 1e-9, 0.01, 0.3, 0.5, 0.7, 0.99, 1 - 1e-9]
    got = evaluate(column(spark, values), norm_ppf("v"))
    assert got == pytest.approx([NormalDist().inv_cdf(v) for v in values], rel=1e-12, abs=1e-15)
    edges = evaluate(column(spark, [0.0, 1.0, None]), norm_ppf("v"))
    assert edges == [-math.inf, math.inf, None]
