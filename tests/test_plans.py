import re

import pytest
from pyspark.sql import functions as F

from seriesloom.operators.series import Series
from seriesloom.operators.split import split_ratio
from seriesloom.operators.windows import sequence_windows
from seriesloom.plans import Roles, build_features, build_model_ready, merge_panel, model_ready
from seriesloom.sources import stage

ROLES = Roles("rain", "et", "ndvi", ("s1", "s2"))


@pytest.fixture(scope="module")
def periods(spark):
    """35 entities by 120 months in two periods, made by Spark expressions."""
    grid = spark.range(35 * 120).select(
        F.format_string(" place %02d", (F.col("id") / 120).cast("int")).alias("entity"),
        (2015 + (F.col("id") % 120) / 12).cast("int").alias("year"),
        (F.col("id") % 12 + 1).cast("int").alias("month"),
        F.col("id").alias("id"),
    )

    def measure(name, seed, high):
        u = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(10_000)) / 10_000
        return grid.select("entity", "year", "month", (u * high).alias(name))

    tables = {
        "rain": measure("rain", 1, 100),
        "et": measure("et", 2, 90),
        "ndvi": measure("ndvi", 3, 1),
        "soil": measure("s1", 4, 9).join(measure("s2", 5, 9), ["entity", "year", "month"]),
    }
    first = {n: t.where("year < 2020") for n, t in tables.items()}
    second = {n: t.where("year >= 2020") for n, t in tables.items()}
    second["et"] = second["et"].select(
        "entity", F.make_date("year", "month", F.lit(15)).alias("start_date"), "et"
    )
    return [first, second]


@pytest.fixture(scope="module")
def ready(periods):
    return stage(model_ready(periods, ROLES, how="stack"), "ready")


def test_lineage_of_row_counts(periods, ready):
    panel = stage(merge_panel(periods), "panel")
    assert panel.count() == 35 * 120
    features = build_features(panel, ROLES)
    assert features.count() == 35 * 112
    assert ready.count() == 35 * 109
    assert build_model_ready(features, ROLES).count() == ready.count()
    train, test = split_ratio(ready, ["date", "entity"], 0.8)
    assert (train.count(), test.count()) == (3052, 763)
    series = Series.of("entity", "date")
    assert sequence_windows(test, series, ["rain", "ndvi"], 12).count() == 343


def test_columns(ready):
    assert not {"spi_3", "spei_6", "drought_class"} & set(ready.columns)
    assert {"rain_lag3", "ndvi_anomaly", "s2_pct", "rain_roll6", "month_sin", "target_3m_ahead"} <= set(
        ready.columns
    )
    assert {r.entity for r in ready.select("entity").distinct().collect()} == {
        f"Place {i:02d}" for i in range(35)
    }


def test_targets_add_up(periods, ready):
    """The target 1 ahead is the class 4 rows later."""
    panel = stage(merge_panel(periods, how="stack"), "panel")
    classes = build_features(panel, ROLES).select("entity", "date", "drought_class")
    later = classes.select(
        "entity", F.add_months("date", -4).alias("date"), F.col("drought_class").alias("later")
    )
    joined = ready.join(later, ["entity", "date"])
    assert joined.count() > 3000
    assert joined.where("target_1m_ahead != later").count() == 0


def test_features_shuffle_once(periods):
    panel = stage(merge_panel(periods, how="stack"), "panel")
    df = build_model_ready(build_features(panel, ROLES), ROLES)
    plan = df._jdf.queryExecution().executedPlan().toString()
    initial = plan.split("Initial Plan")[-1]
    assert len(re.findall(r"Exchange hashpartitioning\(entity", initial)) == 1
    assert "Exchange" not in initial.replace("Exchange hashpartitioning(entity", "", 1)


def test_absent_future_raises(spark):
    with pytest.raises(ValueError):
        build_model_ready(spark.range(1), ROLES)
