"""Comparing models on the latest rows, and reporting predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..operators import sequence_model
from ..operators.boosting import Boosting
from ..operators.merge import align_predictions, melt, union_by_name
from ..operators.models import (
    fit,
    predict,
    random_forest,
    train_trees,
)
from ..operators.report import multi_model_metrics
from ..operators.series import Series
from ..operators.split import split_ratio
from ..operators.windows import sequence_windows
from ..sources.staging import stage


def compare_models(
    table: DataFrame,
    features: Sequence[str],
    sequence_features: Sequence[str],
    label: str,
    entity: str,
    date: str = "date",
    ratio: float = 0.8,
    length: int = 12,
    num_trees: int = 100,
    rounds: int = 100,
) -> DataFrame:
    """Three models trained on the first part and compared on the rest.

    One row per test row with ``length`` earlier test rows. Predictions meet by
    entity and date.
    """
    keys = [entity, date]
    train, test = split_ratio(table, [date, entity], ratio)
    series = Series.of(entity, date)

    def windows(part: DataFrame) -> DataFrame:
        return stage(sequence_windows(part, series, sequence_features, length), "windows")

    forest = fit(random_forest(features, label, num_trees), train, label)
    boost = train_trees(train, label, features, Boosting(rounds), weighted=True)
    network = sequence_model.train(windows(train), entity, label)
    late = windows(test)
    truth = late.select(*keys, F.col(label).alias("true_label"))
    return align_predictions(
        truth,
        {
            "lstm_pred": network.predict(late),
            "rf_pred": predict(forest, test),
            "xgb_pred": boost.predict(test),
        },
        keys,
    )


def prediction_report(
    predictions: DataFrame, truth: str, models: Sequence[str], other: DataFrame | None = None
) -> DataFrame:
    """Metrics of all models in long form, next to those of ``other`` if given."""
    metrics = multi_model_metrics(predictions, truth, models, "Time-series")
    if other is not None:
        metrics = union_by_name([other, metrics])
    return melt(metrics, ["Model", "Dataset"], None, "Metric", "Score")
