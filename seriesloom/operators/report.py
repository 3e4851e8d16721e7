"""Classification reports. All start from one count per (truth, prediction)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .series import names

ACCURACY = "accuracy"
MACRO = "macro avg"
WEIGHTED = "weighted avg"
MAX_PAIRS = 10_000  # of labels in a confusion matrix


def agrees(truth: str, prediction: str) -> Column:
    return F.coalesce(F.col(truth) == F.col(prediction), F.lit(False))


def group_count(df: DataFrame, entity: str | Sequence[str], output: str = "num_rows") -> DataFrame:
    return df.groupBy(*names(entity)).agg(F.count(F.lit(1)).alias(output))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Count per non-null value, most frequent first."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column)
    return counts.agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), column)


def class_distribution(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count per class and source column.

    Counts come before the unpivot, so that the long table is never shuffled.
    """
    counts = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    long = counts.unpivot(["_n"], list(columns), "source", "class")
    return long.groupBy("class", "source").agg(F.sum("_n").alias("count"))


def group_accuracy(
    df: DataFrame, entity: str | Sequence[str], correct: str = "correct"
) -> DataFrame:
    return df.groupBy(*names(entity)).agg(F.avg(F.col(correct).cast("double")).alias(ACCURACY))


def accuracy(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    """Share of equal labels; a missing prediction is a wrong one."""
    return df.agg(F.avg(agrees(truth, prediction).cast("double")).alias(ACCURACY))


def mean_reference_line(by_entity: DataFrame, column: str = ACCURACY) -> DataFrame:
    """Unweighted mean over entities."""
    return by_entity.agg(F.avg(column).alias(f"mean_{column}"))


def pair_counts(
    df: DataFrame, truth: str, prediction: str, by: str | Sequence[str] = ()
) -> DataFrame:
    """Rows per ``by``, truth and prediction; all a report needs, and small."""
    pairs = df.groupBy(*names(by), F.col(truth).alias("truth"), F.col(prediction).alias("pred"))
    return pairs.agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(
    df: DataFrame, truth: str, prediction: str, labels: Sequence | None = None
) -> DataFrame:
    """Long form: one row per pair of labels, zeros included.

    Without ``labels`` these are the labels seen on either side. The table is read
    once. The labels' number is squared in the result, so more than MAX_PAIRS pairs
    are an error.
    """
    few = pair_counts(df, truth, prediction).limit(MAX_PAIRS + 1)
    whole = few.agg(F.collect_list(F.struct("truth", "pred", "n")).alias("pairs"))
    too_many = F.raise_error(F.lit(f"more than {MAX_PAIRS} pairs of {truth} and {prediction}")).cast("boolean")
    whole = whole.where(F.when(F.size("pairs") > MAX_PAIRS, too_many).otherwise(True))
    if labels is None:
        sides = F.concat(F.col("pairs.truth"), F.col("pairs.pred"))
        all_labels = F.array_sort(F.array_distinct(F.filter(sides, lambda v: v.isNotNull())))
    else:
        all_labels = F.array(*[F.lit(v) for v in labels])
    found = F.filter("pairs", lambda p: (p["truth"] == F.col("truth")) & (p["pred"] == F.col("pred")))
    rows = whole.select("pairs", all_labels.alias("labels")).select("pairs", "labels", F.explode("labels").alias("truth"))
    grid = rows.select("pairs", "truth", F.explode("labels").alias("pred"))
    return grid.select("truth", "pred", F.coalesce(F.get(found, F.lit(0))["n"], F.lit(0)).alias("n"))


def confusion_matrix_wide(
    df: DataFrame, truth: str, prediction: str, labels: Sequence
) -> DataFrame:
    """One row per truth, one column per predicted label."""
    long = confusion_matrix(df, truth, prediction, labels)
    return long.groupBy("truth").pivot("pred", list(labels)).agg(F.first("n"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def class_scores(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support of each label from ``pair_counts``.

    A missing prediction is an error of its true class, and no class itself.
    """
    hit = F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("long")
    as_truth = F.struct(
        F.col("truth").alias("label"),
        F.col("n").alias("support"),
        zero.alias("predicted"),
        hit.cast("long").alias("hits"),
    )
    as_pred = F.struct(
        F.col("pred").alias("label"),
        zero.alias("support"),
        F.col("n").alias("predicted"),
        zero.alias("hits"),
    )
    sides = counts.select(*by, F.explode(F.array(as_truth, as_pred)).alias("side"))
    known = sides.where(F.col("side.label").isNotNull())
    sums = known.groupBy(*by, F.col("side.label").alias("label")).agg(
        *[F.sum(f"side.{c}").alias(c) for c in ("support", "predicted", "hits")]
    )
    hits, support, predicted = F.col("hits"), F.col("support"), F.col("predicted")
    return sums.select(
        *by,
        "label",
        ratio(hits, predicted).alias("precision"),
        ratio(hits, support).alias("recall"),
        ratio(2 * hits, support + predicted).alias("f1_score"),
        "support",
        "hits",
    )


def classification_report(
    df: DataFrame, truth: str, prediction: str, by: str | Sequence[str] = ()
) -> DataFrame:
    """Rows per class, then accuracy, macro and support-weighted averages.

    ``by`` makes one report per group in the same pass. The summaries are
    computed beside the class rows (a window over the few labels of a report).
    """
    by = names(by)
    return report_of_counts(pair_counts(df, truth, prediction, by), by)


def report_of_counts(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``classification_report`` of what ``pair_counts`` gives."""
    scores = class_scores(counts, by)
    report = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    total = F.sum("support").over(report)
    metrics = ("precision", "recall", "f1_score")
    macro = {m: F.avg(m).over(report) for m in metrics}
    weighted = {m: ratio(F.sum(F.col(m) * F.col("support")).over(report), total) for m in metrics}
    overall = ratio(F.sum("hits").over(report), total)

    def row(label: Column, values: dict[str, Column], support: Column) -> Column:
        return F.struct(
            label.cast("string").alias("label"),
            *[values[m].alias(m) for m in metrics],
            support.alias("support"),
        )

    summaries = F.array(
        row(F.lit(ACCURACY), dict.fromkeys(metrics, F.col("_accuracy")), F.col("_total")),
        row(F.lit(MACRO), {m: F.col(f"_macro_{m}") for m in metrics}, F.col("_total")),
        row(F.lit(WEIGHTED), {m: F.col(f"_weighted_{m}") for m in metrics}, F.col("_total")),
    )
    own = row(F.col("label"), {m: F.col(m) for m in metrics}, F.col("support"))
    first = F.row_number().over(report.orderBy("label"))
    full = scores.withColumns(
        {
            "_total": total,
            "_accuracy": overall,
            "_first": first,
            **{f"_macro_{m}": c for m, c in macro.items()},
            **{f"_weighted_{m}": c for m, c in weighted.items()},
        }
    )
    rows = F.when(F.col("_first") == 1, F.concat(F.array(own), summaries)).otherwise(F.array(own))
    return full.select(*by, F.explode(rows).alias("r")).select(*by, "r.*")


def f1_macro(df: DataFrame, truth: str, prediction: str, by: str | Sequence[str] = ()) -> DataFrame:
    by = names(by)
    scores = class_scores(pair_counts(df, truth, prediction, by), by)
    return scores.groupBy(*by).agg(F.avg("f1_score").alias("f1_macro"))


def multi_model_metrics(
    df: DataFrame, truth: str, predictions: Sequence[str], dataset: str
) -> DataFrame:
    """Accuracy and weighted precision, recall, F1 per model, wide.

    Distinct (truth, predictions...) combinations are counted before the unpivot.
    """
    counts = df.groupBy(truth, *predictions).agg(F.count(F.lit(1)).alias("_n"))
    pairs = (
        counts.unpivot([truth, "_n"], list(predictions), "Model", "pred")
        .groupBy("Model", F.col(truth).alias("truth"), "pred")
        .agg(F.sum("_n").alias("n"))
    )
    scores = class_scores(pairs, ["Model"])

    def weighted(metric: str) -> Column:
        return ratio(F.sum(F.col(metric) * F.col("support")), F.sum("support"))

    return scores.groupBy("Model").agg(
        ratio(F.sum("hits"), F.sum("support")).alias("Accuracy"),
        weighted("precision").alias("Precision"),
        weighted("recall").alias("Recall"),
        weighted("f1_score").alias("F1-score"),
        F.lit(dataset).alias("Dataset"),
    )


def entity_report(
    df: DataFrame,
    entity: str | Sequence[str],
    truth: str,
    prediction: str,
    recalls: dict[str, str],
) -> DataFrame:
    """Accuracy, support and the recall of named classes per entity.

    ``recalls`` maps output columns to class labels; 0 where a class is absent.
    """
    correct = agrees(truth, prediction)
    found = [
        ratio(
            F.count_if((F.col(truth) == F.lit(label)) & correct),
            F.count_if(F.col(truth) == F.lit(label)),
        ).alias(output)
        for output, label in recalls.items()
    ]
    return df.groupBy(*names(entity)).agg(
        F.avg(correct.cast("double")).alias(ACCURACY),
        F.count(F.lit(1)).alias("total_samples"),
        *found,
    )


def metric_delta(
    metrics: DataFrame, variant: str, metric: str, score: str, base: str, other: str
) -> DataFrame:
    """``other`` minus ``base`` per metric, also as a percentage as printed (x100)."""

    def of(name: str) -> Column:
        return F.max(F.when(F.col(variant) == F.lit(name), F.col(score)))

    deltas = metrics.groupBy(metric).agg((of(other) - of(base)).alias("delta"))
    return deltas.withColumn("delta_pct", F.col("delta") * 100)


def mean_cv_score(folds: DataFrame, score: str = ACCURACY) -> DataFrame:
    return folds.agg(F.avg(score).alias(f"mean_cv_{score}"))
