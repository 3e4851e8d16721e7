"""Counts, accuracies and classification reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import balance, report
from ..operators.columns import flag_correct
from ..operators.ordering import bottom_n, sort_desc_report, top_n
from ..plans.evaluation import prediction_report as report_plan
from ..sources.staging import staging_path
from ..sources.tables import write_metrics_json
from . import sql
from .inputs import predictions, round_columns, table
from .registry import query

P = f"WITH {sql.PREDICTIONS}"
MODELS = ["lstm_pred", "rf_pred", "xgb_pred"]


@query(
    "group_count",
    "SELECT l_suppkey, count(*) AS num_rows FROM lineitem GROUP BY l_suppkey",
)
def group_count(spark, sf_dir):
    counts = report.group_count(table(spark, sf_dir, "lineitem"), "l_suppkey")
    return sort_desc_report(counts, "num_rows", "l_suppkey")


@query("value_counts", 'SELECT o_orderstatus, count(*) AS "count" FROM orders GROUP BY o_orderstatus')
def value_counts(spark, sf_dir):
    return report.value_counts(table(spark, sf_dir, "orders"), "o_orderstatus")


SOURCES = ["true_label", *MODELS]
LONG = " UNION ALL ".join(f"SELECT {c} AS class, '{c}' AS source FROM predictions" for c in SOURCES)


@query(
    "class_distribution",
    f'{P} SELECT class, source, count(*) AS "count" FROM ({LONG}) GROUP BY ALL',
)
def class_distribution(spark, sf_dir):
    return report.class_distribution(predictions(spark, sf_dir), SOURCES)


ENTITY_ACCURACY = "SELECT entity, avg((true_label = rf_pred)::INT) AS accuracy FROM predictions GROUP BY entity"


def entity_accuracy(spark, sf_dir):
    flagged = flag_correct(predictions(spark, sf_dir), "true_label", "rf_pred")
    return report.group_accuracy(flagged, "entity")


@query("group_accuracy", f"{P} SELECT entity, round(accuracy, 9) AS accuracy FROM ({ENTITY_ACCURACY})")
def group_accuracy(spark, sf_dir):
    return round_columns(entity_accuracy(spark, sf_dir), ["accuracy"], 9)


@query("top_n", f"{P} SELECT entity, round(accuracy, 9) AS accuracy FROM ({ENTITY_ACCURACY} ORDER BY accuracy DESC, entity LIMIT 5)")
def top_5(spark, sf_dir):
    return round_columns(top_n(entity_accuracy(spark, sf_dir), 5, "accuracy", "entity"), ["accuracy"], 9)


@query("bottom_n", f"{P} SELECT entity, round(accuracy, 9) AS accuracy FROM ({ENTITY_ACCURACY} ORDER BY accuracy, entity LIMIT 5)")
def bottom_5(spark, sf_dir):
    return round_columns(bottom_n(entity_accuracy(spark, sf_dir), 5, "accuracy", "entity"), ["accuracy"], 9)


@query("sort_desc_report", f"{P} SELECT entity, round(accuracy, 9) AS accuracy FROM ({ENTITY_ACCURACY}) ORDER BY accuracy DESC, entity")
def sorted_report(spark, sf_dir):
    return sort_desc_report(
        round_columns(entity_accuracy(spark, sf_dir), ["accuracy"], 9), "accuracy", "entity"
    )


@query("mean_reference_line", f"{P} SELECT round(avg(accuracy), 9) AS mean_accuracy FROM ({ENTITY_ACCURACY})")
def mean_reference_line(spark, sf_dir):
    return round_columns(
        report.mean_reference_line(entity_accuracy(spark, sf_dir)), ["mean_accuracy"], 9
    )


@query("accuracy", f"{P} SELECT round(avg((true_label = lstm_pred)::INT), 9) AS accuracy FROM predictions")
def accuracy(spark, sf_dir):
    result = report.accuracy(predictions(spark, sf_dir), "true_label", "lstm_pred")
    return round_columns(result, ["accuracy"], 9)


@query(
    "confusion_matrix",
    """WITH l AS (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS label),
    pairs AS (SELECT event_type AS truth, CASE WHEN value < 20 THEN 'click' WHEN value < 60 THEN 'view'
      ELSE 'error' END AS pred FROM events)
    SELECT t.label AS truth, p.label AS pred, count(x.truth) AS n FROM l t CROSS JOIN l p
    LEFT JOIN pairs x ON x.truth = t.label AND x.pred = p.label GROUP BY ALL""",
)
def confusion_matrix(spark, sf_dir):
    guess = F.expr("CASE WHEN value < 20 THEN 'click' WHEN value < 60 THEN 'view' ELSE 'error' END AS guess")
    df = table(spark, sf_dir, "events").select("event_type", guess)
    return report.confusion_matrix(df, "event_type", "guess")


@query(
    "confusion_matrix_wide",
    f"""{P} SELECT true_label AS truth, count(*) FILTER (lstm_pred = 'F') AS "F",
    count(*) FILTER (lstm_pred = 'O') AS "O", count(*) FILTER (lstm_pred = 'P') AS "P"
    FROM predictions GROUP BY true_label""",
)
def confusion_matrix_wide(spark, sf_dir):
    df = predictions(spark, sf_dir)
    return report.confusion_matrix_wide(df, "true_label", "lstm_pred", ["F", "O", "P"])


def scores_sql(pairs: str, by: str = "", digits: int = 9) -> str:
    """CTEs ``scores`` and ``report`` from rows of truth and pred (and ``by``)."""
    key = f"{by}, " if by else ""
    on = f"t.{by} = p.{by} AND " if by else ""
    keyed = f"coalesce(t.{by}, p.{by}) AS {by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    r = lambda e: f"round({e}, {digits})"
    return f"""pairs AS ({pairs}),
    t AS (SELECT {key}truth AS label, count(*) AS support,
          count(*) FILTER (truth = pred) AS hits FROM pairs GROUP BY ALL),
    p AS (SELECT {key}pred AS label, count(*) AS predicted FROM pairs GROUP BY ALL),
    joined AS (SELECT {keyed}coalesce(t.label, p.label) AS label, coalesce(support, 0) AS support,
      coalesce(hits, 0) AS hits, coalesce(predicted, 0) AS predicted
      FROM t FULL JOIN p ON {on}t.label = p.label),
    scores AS (SELECT {key}label, support, hits,
      CASE WHEN predicted > 0 THEN hits / predicted ELSE 0 END::DOUBLE AS precision,
      CASE WHEN support > 0 THEN hits / support ELSE 0 END::DOUBLE AS recall,
      (2 * hits / (support + predicted))::DOUBLE AS f1_score FROM joined),
    report AS (
      SELECT {key}label::VARCHAR AS label, {r("precision")} AS precision, {r("recall")} AS recall,
        {r("f1_score")} AS f1_score, support::BIGINT AS support FROM scores
      UNION ALL SELECT {key}'accuracy', {r("sum(hits) / sum(support)")}, {r("sum(hits) / sum(support)")},
        {r("sum(hits) / sum(support)")}, sum(support)::BIGINT FROM scores {group}
      UNION ALL SELECT {key}'macro avg', {r("avg(precision)")}, {r("avg(recall)")},
        {r("avg(f1_score)")}, sum(support)::BIGINT FROM scores {group}
      UNION ALL SELECT {key}'weighted avg', {r("sum(precision * support) / sum(support)")},
        {r("sum(recall * support) / sum(support)")}, {r("sum(f1_score * support) / sum(support)")},
        sum(support)::BIGINT FROM scores {group})"""


METRICS = ["precision", "recall", "f1_score"]


@query(
    "classification_report",
    "WITH "
    + scores_sql(
        """SELECT event_type AS truth, CASE WHEN value < 20 THEN 'click' WHEN value < 60 THEN 'view'
        WHEN value < 61 THEN 'other' ELSE 'error' END AS pred FROM events"""
    )
    + " SELECT * FROM report",
)
def classification_report(spark, sf_dir):
    """With labels never predicted and one never true."""
    guess = F.expr(
        "CASE WHEN value < 20 THEN 'click' WHEN value < 60 THEN 'view' WHEN value < 61 THEN 'other'"
        " ELSE 'error' END AS guess"
    )
    df = table(spark, sf_dir, "events").select("event_type", guess)
    return round_columns(report.classification_report(df, "event_type", "guess"), METRICS, 9)


@query(
    "classification_report_by_entity",
    f"{P}, "
    + scores_sql("SELECT entity, true_label AS truth, xgb_pred AS pred FROM predictions", "entity")
    + " SELECT * FROM report",
)
def classification_report_by_entity(spark, sf_dir):
    df = report.classification_report(
        predictions(spark, sf_dir), "true_label", "xgb_pred", "entity"
    )
    return round_columns(df, METRICS, 9)


LABELS = "SELECT quality AS truth, toxic AS pred FROM labels"


@query(
    "f1_macro",
    "WITH " + scores_sql(LABELS) + " SELECT round(avg(f1_score), 9) AS f1_macro FROM scores",
)
def f1_macro(spark, sf_dir):
    df = report.f1_macro(table(spark, sf_dir, "labels"), "quality", "toxic")
    return round_columns(df, ["f1_macro"], 9)


MODEL_PAIRS = " UNION ALL ".join(
    f"SELECT '{m}' AS \"Model\", true_label AS truth, {m} AS pred FROM predictions" for m in MODELS
)
WIDE_METRICS = """wide AS (SELECT "Model", sum(hits) / sum(support) AS "Accuracy",
  sum(precision * support) / sum(support) AS "Precision", sum(recall * support) / sum(support) AS "Recall",
  sum(f1_score * support) / sum(support) AS "F1-score" FROM scores GROUP BY "Model")"""
WIDE = ["Accuracy", "Precision", "Recall", "F1-score"]
SCORES = f"{P}, " + scores_sql(MODEL_PAIRS, '"Model"') + ", " + WIDE_METRICS


@query(
    "multi_model_metrics",
    f'{SCORES} SELECT "Model", '
    + ", ".join(f'round("{c}", 9) AS "{c}"' for c in WIDE)
    + ", 'Time-series' AS \"Dataset\" FROM wide",
)
def multi_model_metrics(spark, sf_dir):
    df = predictions(spark, sf_dir)
    return round_columns(report.multi_model_metrics(df, "true_label", MODELS, "Time-series"), WIDE, 9)


@query(
    "prediction_report",
    f"{SCORES} "
    + " UNION ALL ".join(
        f"""SELECT "Model", 'Time-series' AS "Dataset", '{c}' AS "Metric", round("{c}", 9) AS "Score" FROM wide"""
        for c in WIDE
    )
    + " UNION ALL "
    + " UNION ALL ".join(
        f"""SELECT 'share_' || lower(o_orderstatus), 'Overall', '{c}',
        round(count(*) / (SELECT count(*) FROM orders), 9) FROM orders GROUP BY o_orderstatus"""
        for c in WIDE
    ),
)
def prediction_report(spark, sf_dir):
    """Next to the models, a baseline per class: always guess it."""
    counts = report.value_counts(table(spark, sf_dir, "orders"), "o_orderstatus")
    total = counts.agg(F.sum("count").alias("n")).select("n").scalar()
    share = F.col("count") / total
    other = counts.select(
        F.concat(F.lit("share_"), F.lower("o_orderstatus")).alias("Model"),
        *[share.alias(c) for c in WIDE],
        F.lit("Overall").alias("Dataset"),
    )
    long = report_plan(predictions(spark, sf_dir), "true_label", MODELS, other)
    return round_columns(long, ["Score"], 9)


RECALLS = {"f_recall": "F", "o_recall": "O", "x_recall": "X"}


@query(
    "entity_report",
    f"""{P} SELECT entity, round(avg((true_label = rf_pred)::INT), 9) AS accuracy,
    count(*) AS total_samples, """
    + ", ".join(
        f"""round(coalesce(count(*) FILTER (true_label = '{v}' AND rf_pred = '{v}')
        / nullif(count(*) FILTER (true_label = '{v}'), 0), 0)::DOUBLE, 9) AS {k}"""
        for k, v in RECALLS.items()
    )
    + " FROM predictions GROUP BY entity",
)
def entity_report(spark, sf_dir):
    df = report.entity_report(predictions(spark, sf_dir), "entity", "true_label", "rf_pred", RECALLS)
    df = round_columns(df, ["accuracy", *RECALLS], 9)
    return sort_desc_report(df, "accuracy", "entity")


@query(
    "metric_delta",
    f"""{SCORES}, long AS ("""
    + " UNION ALL ".join(f"""SELECT "Model", '{c}' AS "Metric", "{c}" AS s FROM wide""" for c in WIDE)
    + """) SELECT "Metric", round(b.s - a.s, 9) AS delta, round((b.s - a.s) * 100, 7) AS delta_pct
    FROM long a JOIN long b USING ("Metric") WHERE a."Model" = 'rf_pred' AND b."Model" = 'lstm_pred'""",
)
def metric_delta(spark, sf_dir):
    long = report_plan(predictions(spark, sf_dir), "true_label", MODELS)
    df = report.metric_delta(long, "Model", "Metric", "Score", "rf_pred", "lstm_pred")
    return df.withColumns({"delta": F.round("delta", 9), "delta_pct": F.round("delta_pct", 7)})


@query(
    "mean_cv_score",
    f"""{P}, folds AS (SELECT year(date) AS fold, avg((true_label = rf_pred)::INT) AS accuracy
    FROM predictions GROUP BY ALL) SELECT round(avg(accuracy), 9) AS mean_cv_accuracy FROM folds""",
)
def mean_cv_score(spark, sf_dir):
    df = predictions(spark, sf_dir).withColumn("fold", F.year("date"))
    flagged = flag_correct(df, "true_label", "rf_pred")
    folds = report.group_accuracy(flagged, "fold")
    return round_columns(report.mean_cv_score(folds), ["mean_cv_accuracy"], 9)


@query(
    "class_weights",
    """SELECT l_returnflag, count(*) AS n,
    round((SELECT count(*) FROM lineitem) / (3 * count(*)), 9) AS weight FROM lineitem GROUP BY l_returnflag""",
)
def class_weights(spark, sf_dir):
    df = balance.class_weights(table(spark, sf_dir, "lineitem"), "l_returnflag")
    return round_columns(df, ["weight"], 9)


@query(
    "class_weights_rows",
    """WITH w AS (SELECT event_type, (SELECT count(*) FROM events) / (5 * count(*)) AS w
    FROM events GROUP BY event_type)
    SELECT event_id, round(w, 9) AS weight FROM events JOIN w USING (event_type)""",
)
def class_weights_rows(spark, sf_dir):
    df = balance.with_class_weights(table(spark, sf_dir, "events"), "event_type")
    return round_columns(df.select("event_id", "weight"), ["weight"], 9)


@query(
    "sink_metrics_json",
    "WITH " + scores_sql(LABELS) + " SELECT label, precision, recall, f1_score, support FROM report",
)
def sink_metrics_json(spark, sf_dir):
    """A report through JSON and back."""
    df = report.classification_report(table(spark, sf_dir, "labels"), "quality", "toxic")
    df = round_columns(df, METRICS, 9)
    path = write_metrics_json(df, staging_path(spark, "metrics"))
    return spark.read.schema(df.schema).json(path)
