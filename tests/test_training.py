"""The final training plan and stored models."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.operators import models
from seriesloom.operators.boosting import Boosting, BoostModel
from seriesloom.operators.forests import ForestModel
from seriesloom.operators.trees import Forest
from seriesloom.plans.training import load_final, train_final


@pytest.fixture(scope="module")
def parts(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=(700, 2))
    y = np.where(x[:, 0] > 1.2, "rare", np.where(x[:, 1] > 0, "one", "two"))
    df = spark.createDataFrame([(i, *map(float, v), str(k)) for i, (v, k) in enumerate(zip(x, y))], "i long, b double, a double, y string").cache()
    return df.where("i < 500"), df.where("i >= 500")


@pytest.mark.parametrize("setting, kind", [(Forest(20, 8, features="all"), ForestModel), (Boosting(15, 4), BoostModel)])
def test_training_stores_model_and_metrics(spark, parts, tmp_path, setting, kind):
    train, test = parts
    done = train_final(train, test, "y", ["b", "a"], ["i"], str(tmp_path / "final"), setting)
    stored = load_final(spark, str(tmp_path / "final"), boosted=kind is BoostModel)
    assert type(stored) is kind and stored.features == ["b", "a"]
    key = lambda m: done.model.predict(test).orderBy("i").collect() if m is None else m.predict(test).orderBy("i").collect()
    assert key(stored) == key(None)
    lines = [json.loads(line) for f in os.listdir(done.metrics_path) if f.endswith(".json") for line in open(f"{done.metrics_path}/{f}")]
    assert {m["label"] for m in lines} == {"one", "two", "rare", "accuracy", "macro avg", "weighted avg"}
    right = done.model.predict(test).where("y = prediction").count() / 200
    assert {m["label"]: m["precision"] for m in lines}["accuracy"] == pytest.approx(right) and right > 0.9
    with pytest.raises(ValueError):
        load_final(spark, str(tmp_path / "final"), boosted=kind is ForestModel)


def test_training_without_balance_keeps_the_rows(spark, parts, tmp_path):
    train, test = parts
    done = train_final(train, test, "y", ["b", "a"], ["i"], str(tmp_path / "plain"), Forest(3, 2), balance=False, weighted=True)
    roots = done.model.nodes.where("path = 1").agg(F.avg(F.aggregate("counts", F.lit(0.0), lambda a, b: a + b))).first()[0]
    assert abs(roots - 500) < 60  # rows that a tree takes, with repetition
    scored = models.score_batch(done.model, test.drop("a"), ["i", "y"])
    assert scored.columns == ["i", "y", "prediction"] and scored.count() == 200
