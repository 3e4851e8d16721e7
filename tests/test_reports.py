import pytest

from seriesloom.operators.report import (
    classification_report,
    confusion_matrix,
    confusion_matrix_wide,
    entity_report,
    f1_macro,
    metric_delta,
    multi_model_metrics,
)
from seriesloom.plans import prediction_report

LABELS = ["Extreme", "Moderate", "No Drought"]
# confusion counts of three models over the same 343 rows, rows by truth
COUNTS = {
    "lstm": [[94, 1, 0], [15, 12, 3], [3, 5, 210]],
    "rf": [[28, 5, 62], [12, 2, 16], [81, 6, 131]],
    "xgb": [[22, 14, 59], [11, 3, 16], [59, 30, 129]],
}
# accuracy, weighted precision, weighted recall, weighted F1, macro F1
WANTED = {
    "lstm": [0.9213, 0.9174, 0.9213, 0.9146, 0.7942],
    "rf": [0.4694, 0.4759, 0.4694, 0.4699, 0.3220],
    "xgb": [0.4490, 0.4737, 0.4490, 0.4606, 0.3082],
}


def rows_of(counts):
    return [
        (LABELS[i], LABELS[j])
        for i in range(3)
        for j in range(3)
        for _ in range(counts[i][j])
    ]


@pytest.fixture(scope="module")
def predictions(spark):
    """The models' predictions, each next to the truth it was counted with."""
    columns = {m: rows_of(c) for m, c in COUNTS.items()}
    rows = [
        (i, columns["lstm"][i][0], *(columns[m][i][1] for m in COUNTS)) for i in range(343)
    ]
    schema = "id int, truth string, lstm string, rf string, xgb string"
    return spark.createDataFrame(rows, schema).repartition(3).cache()


def test_multi_model_metrics(predictions):
    got = {r.Model: r for r in multi_model_metrics(predictions, "truth", list(COUNTS), "ts").collect()}
    for model, wanted in WANTED.items():
        r = got[model]
        assert [r.Accuracy, r.Precision, r.Recall, r["F1-score"]] == pytest.approx(wanted[:4], abs=1e-4)


@pytest.mark.parametrize("model", list(COUNTS))
def test_report_and_macro_f1(predictions, model):
    report = {r.label: r for r in classification_report(predictions, "truth", model).collect()}
    assert set(report) == {*LABELS, "accuracy", "macro avg", "weighted avg"}
    assert report["accuracy"].f1_score == pytest.approx(WANTED[model][0], abs=1e-4)
    assert report["macro avg"].f1_score == pytest.approx(WANTED[model][4], abs=1e-4)
    assert report["weighted avg"].support == 343
    assert [report[l].support for l in LABELS] == [95, 30, 218]
    assert f1_macro(predictions, "truth", model).first()[0] == pytest.approx(WANTED[model][4], abs=1e-4)


def test_confusion_matrix_keeps_zeros(predictions):
    long = {(r.truth, r.pred): r.n for r in confusion_matrix(predictions, "truth", "lstm").collect()}
    want = {(a, b): COUNTS["lstm"][i][j] for i, a in enumerate(LABELS) for j, b in enumerate(LABELS)}
    assert long == want
    wide = {r.truth: [r[l] for l in LABELS] for r in
            confusion_matrix_wide(predictions, "truth", "rf", LABELS).collect()}
    assert [wide[l] for l in LABELS] == COUNTS["rf"]


def test_zero_division(spark):
    df = spark.createDataFrame([("a", "b"), ("a", "a"), ("c", "a")], "t string, p string")
    report = {r.label: r for r in classification_report(df, "t", "p").collect()}
    assert (report["b"].recall, report["b"].support) == (0.0, 0)
    assert (report["c"].precision, report["c"].recall) == (0.0, 0.0)
    assert report["a"].f1_score == pytest.approx(0.5)


def test_entity_report_with_absent_class(spark):
    rows = [("x", "a", "a"), ("x", "b", "a"), ("y", "a", "b")]
    df = spark.createDataFrame(rows, "e string, t string, p string")
    got = {r.e: r for r in entity_report(df, "e", "t", "p", {"ra": "a", "rb": "b"}).collect()}
    assert (got["x"].accuracy, got["x"].ra, got["x"].rb, got["x"].total_samples) == (0.5, 1.0, 0.0, 2)
    assert (got["y"].accuracy, got["y"].ra, got["y"].rb) == (0.0, 0.0, 0.0)


def test_prediction_report_and_delta(predictions):
    long = prediction_report(predictions, "truth", list(COUNTS))
    assert long.count() == 12
    delta = {r.Metric: r.delta for r in
             metric_delta(long, "Model", "Metric", "Score", "rf", "lstm").collect()}
    assert delta["Accuracy"] == pytest.approx(0.9213 - 0.4694, abs=2e-4)
