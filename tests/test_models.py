import inspect

import pytest
from pyspark.sql import functions as F

from seriesloom.operators import models
from seriesloom.operators.report import accuracy


@pytest.fixture(scope="module")
def table(spark):
    """Three classes that ``x`` tells apart, by entity and day; uneven."""
    u = F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000
    df = spark.range(360).select(
        F.format_string("e%d", F.col("id") % 6).alias("entity"),
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") / 6).cast("int")).alias("date"),
        (u * 10).alias("x"),
        F.rand(3).alias("noise"),
    )
    label = F.when(F.col("x") < 2, "low").when(F.col("x") < 4, "middle").otherwise("high")
    return df.withColumn("y", label).cache()


FEATURES = ["x", "noise"]
ORDER = ["date", "entity"]


def share_right(df):
    return accuracy(df, "y", "prediction").first()[0]


def test_forest_and_stored_model(spark, table, tmp_path):
    train, test = table.where("date < '2020-02-10'"), table.where("date >= '2020-02-10'")
    model = models.fit(models.random_forest(FEATURES, "y", 10, 5, weighted=True), train, "y")
    scored = models.predict(model, test)
    assert scored.columns == [*test.columns, "prediction"]
    assert share_right(scored) > 0.9
    assert models.feature_order(model) == FEATURES
    path = models.save_model(model, str(tmp_path / "m"))
    kept = [*ORDER, "y"]
    again = models.score_batch(path, test, kept)
    assert sorted(map(tuple, again.collect())) == sorted(
        map(tuple, scored.select(*kept, "prediction").collect())
    )
    without = models.score_batch(path, test.drop("noise", "y"), ORDER)
    assert without.columns == [*ORDER, "prediction"] and without.count() == test.count()


def test_boosted_trees(table):
    model = models.fit(models.boosted_trees(FEATURES, "y", 3, 3, weighted=True), table, "y")
    assert share_right(models.predict(model, table)) > 0.9


def test_cross_validation_and_search(table):
    pipeline = models.random_forest(FEATURES, "y", 5, 4)
    folds = models.cross_validate(table, ORDER, "y", pipeline, n_splits=2).collect()
    assert sorted(r.fold for r in folds) == [1, 2] and all(r.accuracy > 0.8 for r in folds)
    settings = models.sample_settings({"max_depth": (1, 5), "num_trees": [3]}, 2)
    scores, best, model = models.random_search(table, ORDER, "y", FEATURES, settings, n_splits=2)
    assert scores.count() == 4 and best in settings
    assert share_right(model.predict(table)) > 0.5


def test_settings_are_repeatable_and_in_range():
    space = {"a": (1, 4), "b": (0.6, 1.0), "c": ["x", None]}
    first = models.sample_settings(space, 50)
    assert first == models.sample_settings(space, 50)
    assert {s["a"] for s in first} == {1, 2, 3}
    assert all(0.6 <= s["b"] <= 1.0 and s["c"] in ("x", None) for s in first)


def test_param_grid(spark):
    grid = models.param_grid({"max_depth": [None, 5], "num_trees": [1, 2]})
    assert [(s["max_depth"], s["num_trees"]) for s in grid] == [(None, 1), (None, 2), (5, 1), (5, 2)]


def test_registered_training_is_not_cut(spark, monkeypatch):
    from seriesloom.catalog import models as catalog

    seen = {}
    monkeypatch.setattr(catalog, "split_ready", lambda *a: ("train", "test"))
    monkeypatch.setattr(catalog, "features_of", lambda df: FEATURES)
    monkeypatch.setattr(catalog.models, "random_search", lambda df, order, label, features, settings, n_splits=5, **k: seen.update(settings=settings, folds=n_splits) or [None] * 3)
    catalog.boost_search(None, None)
    assert seen["folds"] == 5 and seen["settings"] == models.sample_settings(catalog.BOOST_SPACE, 50)
    catalog.random_search_smote(None, None)
    assert seen["folds"] == 5 and seen["settings"] == models.sample_settings(catalog.FOREST_SPACE, 50)
    assert catalog.BOOSTING.rounds == 100 and len(models.param_grid(catalog.FOREST_GRID)) == 162
    assert inspect.signature(catalog.sequence_model.train).parameters["rounds"].default == 60
