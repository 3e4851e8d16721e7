"""Training the final model: balance, fit, report, and store what scoring needs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators.balance import smote
from ..operators.boosting import Boosting, BoostModel
from ..operators.forests import ForestModel
from ..operators.models import train_trees
from ..operators.report import classification_report
from ..operators.trees import Forest
from ..sources.staging import stage
from ..sources.tables import write_metrics_json


@dataclass
class Trained:
    """Where the model and its metrics lie, and the model itself."""

    model: ForestModel
    report: DataFrame
    model_path: str
    metrics_path: str


def train_final(
    train: DataFrame,
    test: DataFrame,
    label: str,
    features: Sequence[str],
    row_key: Sequence[str],
    path: str,
    setting: Forest | Boosting = Forest(300, 10),
    balance: bool = True,
    weighted: bool = False,
    **smote_params,
) -> Trained:
    """Grow small classes by SMOTE, train, report on ``test``, write model and metrics below ``path``.

    The test rows are never balanced. The model is stored with the order of its features,
    the report as JSON, one line per label and average.
    """
    rows = stage(smote(train, label, features, row_key, **smote_params), "balanced") if balance else train
    model = train_trees(rows, label, features, setting, weighted)
    model_path, metrics_path = f"{path}/model", f"{path}/metrics"
    report = stage(classification_report(model.predict(test), label, "prediction"), "report")
    write_metrics_json(report, metrics_path)
    return Trained(model, report, model.save(model_path), metrics_path)


def load_final(spark, path: str, boosted: bool = False) -> ForestModel:
    return (BoostModel if boosted else ForestModel).load(spark, f"{path}/model")
