"""The sequence model: gradients, order, entities, windows with missing values."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.operators import models, sequence_model
from seriesloom.operators.sequence_model import Shape


@pytest.mark.parametrize("shape", [Shape(7, 3, 4, 3, filters=5, embedding=2, hidden=6), Shape(2, 1, 0, 2, filters=2, embedding=1, hidden=3)])
def test_gradient_is_that_of_the_loss(shape):
    r = np.random.default_rng(1)
    n = 9
    x, entity = r.normal(size=(n, shape.length, shape.columns)), r.integers(0, shape.entities + 1, n)
    y, weight = r.integers(0, shape.classes, n), r.random(n) + 0.5
    flat = shape.start(2) + r.normal(0, 0.05, len(shape.start(2)))

    def loss(flat):
        shares, _ = sequence_model.forward(shape, shape.split(flat), x, entity)
        return -(weight * np.log(shares[np.arange(n), y])).sum() / weight.sum() + 0.005 * (flat**2).sum()

    found = sequence_model.gradient(shape, flat, x, entity, y, weight, 0.01)
    for i in r.choice(len(flat), min(60, len(flat)), replace=False):
        step = np.zeros(len(flat))
        step[i] = 1e-6
        assert found[i] == pytest.approx((loss(flat + step) - loss(flat - step)) / 2e-6, abs=1e-5)


def ordered_rows(n, seed=3):
    """Noise with a large and a small swing to the same side somewhere: which comes first is the class."""
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        seq = r.normal(0, 0.2, (12, 2))
        at, side = r.integers(0, 10), r.choice([-1, 1])
        first = bool(r.random() < 0.5)
        seq[at, 0], seq[at + 2, 0] = (2.5 * side, side) if first else (side, 2.5 * side)
        rows.append((i, f"e{i % 5}", dt.date(2020, 1, 1), "up" if first else "down", seq.tolist()))
    return rows


SCHEMA = "i long, entity string, date date, y string, seq array<array<double>>"


def test_order_is_learned_where_a_flat_perceptron_fails(spark):
    df = spark.createDataFrame(ordered_rows(1400), SCHEMA)
    train, test = df.where("i < 900"), df.where("i >= 900")
    model = sequence_model.train(train, "entity", "y", seed=1)
    right = model.predict(test).where("y = prediction").count() / 500
    windows = [models.with_window_vector(part) for part in (train, test)]
    flat = models.fit(models.sequence_classifier(12, 2, "entity", 5, 2, "y"), windows[0], "y")
    other = models.predict(flat, windows[1]).where("y = prediction").count() / 500
    assert right > 0.95 and right > other + 0.05
    again = sequence_model.train(train, "entity", "y", seed=1)
    assert np.array_equal(model.flat, again.flat)


def test_entities_matter_and_unknown_ones_are_scored(spark):
    r = np.random.default_rng(5)
    rows = [(i, f"e{i % 4}", None, "a" if i % 4 < 2 else "b", r.normal(size=(4, 2)).tolist()) for i in range(600)]
    df = spark.createDataFrame(rows, SCHEMA)
    model = sequence_model.train(df, "entity", "y", rounds=50)
    assert model.predict(df).where("y = prediction").count() > 560
    odd = df.limit(20).withColumn("entity", F.when(F.col("i") % 2 == 0, "new")).select("entity", "seq", F.lit(1).alias("probability"))
    scored = model.predict(odd)
    assert scored.columns == ["entity", "seq", "prediction", "probability"]
    assert all(r.prediction in ("a", "b") and 0.5 <= r.probability <= 1 for r in scored.collect())
    few = sequence_model.train(df, "entity", "y", rounds=2, most_entities=1)
    assert few.entities == ["e0"] and few.predict(df).count() == 600


def test_missing_infinite_and_unlabelled(spark):
    rows = [(i, "e", None, ["a", "b", None][i % 3], [[float(i % 3), None], [float("inf") if i % 2 else float("nan"), 1.0]]) for i in range(90)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    model = sequence_model.train(df, "entity", "y", rounds=30, weighted=True)
    assert model.labels == ["a", "b"] and np.isfinite(model.flat).all()
    scored = model.predict(df)
    assert scored.count() == 90 and scored.where("y = prediction").count() >= 55
    with pytest.raises(ValueError):
        sequence_model.train(df.where("y IS NULL"), "entity", "y")
