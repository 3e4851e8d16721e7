"""Training, scoring, cross-validation and search with MLlib."""

from __future__ import annotations

import random
from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import (
    GBTClassifier,
    MultilayerPerceptronClassifier,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import (
    IndexToString,
    OneHotEncoder,
    StandardScaler,
    StringIndexer,
    StringIndexerModel,
    VectorAssembler,
)
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame, Window, functions as F

from ..sources.staging import stage
from .balance import smote, with_class_weights
from .columns import align_to_schema
from . import boosting, forests
from .boosting import Boosting
from .forests import Binned, ForestModel, bin_table, edges_of
from .report import accuracy, class_scores, classification_report
from .split import BLOCK, fold, fold_blocks
from .trees import Forest

LABEL_CODE = "_label"
FEATURES = "_features"
WEIGHT = "_weight"
ONLY = "_only"  # the fold that a row belongs to, if not all


def random_forest(
    features: Sequence[str],
    label: str,
    num_trees: int = 300,
    max_depth: int = 10,
    weighted: bool = False,
    seed: int = 42,
    **params,
) -> Pipeline:
    """Label index, feature vector, forest, and the prediction as a label.

    ``weighted`` expects the column of ``with_class_weights``. MLlib stops at
    depth 30.
    """
    forest = RandomForestClassifier(
        labelCol=LABEL_CODE,
        featuresCol=FEATURES,
        numTrees=num_trees,
        maxDepth=max_depth,
        seed=seed,
        **params,
    )
    return _classifier(features, label, forest, weighted)


def boosted_trees(
    features: Sequence[str],
    label: str,
    max_iter: int = 50,
    max_depth: int = 5,
    step_size: float = 0.1,
    weighted: bool = False,
    seed: int = 42,
    **params,
) -> Pipeline:
    """Boosted trees for several classes: MLlib's are binary, so one per class."""
    boost = GBTClassifier(
        maxIter=max_iter, maxDepth=max_depth, stepSize=step_size, seed=seed, **params
    )
    each = OneVsRest(
        classifier=boost, labelCol=LABEL_CODE, featuresCol=FEATURES, parallelism=4
    )
    return _classifier(features, label, each, weighted)


def _classifier(features, label, estimator, weighted) -> Pipeline:
    if weighted:
        estimator.setWeightCol(WEIGHT)
    index = StringIndexer(
        inputCol=label, outputCol=LABEL_CODE, stringOrderType="alphabetAsc", handleInvalid="error"
    )
    assemble = VectorAssembler(inputCols=list(features), outputCol=FEATURES)
    return Pipeline(stages=[index, assemble, estimator])


def fit(pipeline: Pipeline, train: DataFrame, label: str) -> PipelineModel:
    """Fit, with balanced weights beside the rows if the classifier wants them.

    The result scores tables without a label: the label index is left out of it,
    and predictions are turned back into its labels.
    """
    index, *rest = pipeline.getStages()
    labels = index.fit(train)
    if _wants_weights(rest[-1]):
        train = with_class_weights(train, label, WEIGHT)
    fitted = Pipeline(stages=rest).fit(labels.transform(train))
    return PipelineModel([*fitted.stages, _decoder(labels)])


def _wants_weights(estimator: Estimator) -> bool:
    return estimator.hasParam("weightCol") and estimator.isDefined("weightCol")


def _decoder(labels: StringIndexerModel) -> Transformer:
    return IndexToString(
        inputCol="prediction", outputCol="predicted_label", labels=list(labels.labels)
    )


def predict(model: PipelineModel, df: DataFrame, output: str = "prediction") -> DataFrame:
    """The table with one more column, the predicted label."""
    scored = model.transform(df)
    return scored.select(*[F.col(c) for c in df.columns], F.col("predicted_label").alias(output))


def feature_order(model: PipelineModel) -> list[str]:
    """The feature columns a stored model was trained on, in order."""
    for step in model.stages:
        if isinstance(step, VectorAssembler):
            return step.getInputCols()
    raise ValueError("the model has no VectorAssembler")


def save_model(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def score_batch(
    model: PipelineModel | ForestModel | str, df: DataFrame, keep: Sequence[str], output: str = "prediction"
) -> DataFrame:
    """Bring a table to the model's columns (absent ones 0) and score all of it."""
    if isinstance(model, str):
        model = load_model(model)
    own = isinstance(model, ForestModel)
    order = model.features if own else feature_order(model)
    aligned = align_to_schema(df, [*keep, *[c for c in order if c not in keep]])
    return (model.predict(aligned, output) if own else predict(model, aligned, output)).select(*keep, output)


def sequence_classifier(
    length: int,
    n_features: int,
    entity: str,
    n_entities: int,
    n_classes: int,
    label: str,
    hidden: Sequence[int] = (32,),
    max_iter: int = 100,
    seed: int = 42,
) -> Pipeline:
    """Classify a window of rows together with the entity it comes from.

    The window comes flat, from ``with_window_vector``; the entity is one-hot,
    with a place for entities not seen in training.
    """
    width = length * n_features
    return Pipeline(
        stages=[
            StringIndexer(
                inputCol=label, outputCol=LABEL_CODE, stringOrderType="alphabetAsc"
            ),
            StringIndexer(
                inputCol=entity,
                outputCol="_entity",
                stringOrderType="alphabetAsc",
                handleInvalid="keep",
            ),
            OneHotEncoder(inputCol="_entity", outputCol="_who", dropLast=False),
            StandardScaler(
                inputCol="_window", outputCol="_scaled", withMean=True, withStd=True
            ),
            VectorAssembler(inputCols=["_scaled", "_who"], outputCol=FEATURES),
            MultilayerPerceptronClassifier(
                layers=[width + n_entities + 1, *hidden, n_classes],
                featuresCol=FEATURES,
                labelCol=LABEL_CODE,
                maxIter=max_iter,
                seed=seed,
            ),
        ]
    )


def with_window_vector(sequences: DataFrame) -> DataFrame:
    """The vector form of ``seq`` that ``sequence_classifier`` reads."""
    return sequences.withColumn("_window", array_to_vector(F.flatten("seq")))


def cross_validate(
    df: DataFrame,
    order: Sequence[str],
    label: str,
    pipeline: Pipeline,
    n_splits: int = 5,
    balance: Sequence[str] | None = None,
    reports: bool = False,
    **smote_params,
) -> DataFrame:
    """Accuracy (or the full report) per expanding fold.

    ``balance`` names the feature columns to grow the training part by SMOTE;
    the test part is never touched. Folds run one after the other: each is a
    set of Spark jobs over all executors.
    """
    blocks = stage(fold_blocks(df, order, n_splits), "folds")
    results = []
    for i in range(1, n_splits + 1):
        train, test = fold(blocks, i)
        if balance is not None:
            train = smote(train, label, balance, order, **smote_params)
        scored = predict(fit(pipeline, train, label), test)
        if reports:
            result = classification_report(scored, label, "prediction")
        else:
            result = accuracy(scored, label, "prediction")
        results.append(result.withColumn("fold", F.lit(i)))
    return reduce(lambda a, b: a.unionByName(b), results)


def sample_settings(
    space: Mapping[str, Any], n_iter: int, seed: int = 42
) -> list[dict[str, Any]]:
    """``n_iter`` settings. A list is a choice, ``(low, high)`` of ints a whole
    number below ``high``, ``(low, high)`` of floats any number between."""
    rng = random.Random(seed)

    def draw(values):
        if isinstance(values, list):
            return rng.choice(values)
        low, high = values
        if isinstance(low, int) and isinstance(high, int):
            return rng.randrange(low, high)
        return rng.uniform(low, high)

    return [{name: draw(space[name]) for name in sorted(space)} for _ in range(n_iter)]


def param_grid(space: Mapping[str, Sequence]) -> list[dict[str, Any]]:
    """Every combination, as settings by parameter name."""
    builder = ParamGridBuilder()
    for name, values in space.items():
        builder = builder.addGrid(Param(Params._dummy(), name, ""), list(values))
    return [{p.name: v for p, v in setting.items()} for setting in builder.build()]


def fold_table(
    df: DataFrame,
    order: Sequence[str],
    label: str,
    features: Sequence[str],
    n_splits: int = 5,
    balance: bool = False,
    **smote_params,
) -> Binned:
    """The table in bins, with the rows' fold blocks.

    With ``balance`` each fold also has the rows that SMOTE adds to its training part;
    they are of that fold alone and are never tested.
    """
    blocks = stage(fold_blocks(df, order, n_splits), "folds")
    rows = blocks.select(*features, label, F.col(BLOCK), F.lit(0).alias(ONLY))
    edges = edges_of(rows, features)
    if balance:
        for i in range(1, n_splits + 1):
            grown = smote(fold(blocks, i)[0], label, features, order, **smote_params).where("synthetic")
            rows = rows.unionByName(grown.select(*features, label, F.lit(-1).alias(BLOCK), F.lit(i).alias(ONLY)))
        rows = stage(rows, "balanced")
    return bin_table(rows, features, label, F.col(BLOCK), F.col(ONLY), edges=edges)


def trainer(setting: Forest | Boosting):
    """The module that trains such settings."""
    return boosting if isinstance(setting, Boosting) else forests


def train_trees(df: DataFrame, label: str, features: Sequence[str], setting: Forest | Boosting, weighted: bool = False) -> ForestModel:
    """One forest or boosted model on a whole table."""
    return trainer(setting).train(bin_table(df, features, label), setting, weighted)


def cross_validate_trees(
    df: DataFrame,
    order: Sequence[str],
    label: str,
    features: Sequence[str],
    settings: Sequence[Forest | Boosting],
    n_splits: int = 5,
    weighted: bool = False,
    balance: bool = False,
    **smote_params,
) -> DataFrame:
    """Rows per setting, fold, truth and prediction, from which any report follows."""
    table = fold_table(df, order, label, features, n_splits, balance, **smote_params)
    return trainer(settings[0]).cross_validate(table, settings, range(1, n_splits + 1), weighted)


def random_search(
    df: DataFrame,
    order: Sequence[str],
    label: str,
    features: Sequence[str],
    settings: Sequence[Mapping[str, Any]],
    n_splits: int = 5,
    weighted: bool = False,
    balance: bool = False,
    refit: bool = True,
    kind: type = Forest,
    **smote_params,
) -> tuple[DataFrame, dict[str, Any], ForestModel | None]:
    """Score forests or boosted trees by mean macro F1 over expanding folds; refit the best.

    Settings are those of ``Forest`` or ``Boosting``, the ``kind``. Returns a row per setting
    and fold, the best setting and its model. The table is binned once, and all
    settings on all folds are trained in the same passes.
    """
    tried = [kind(**s) for s in settings]
    table = fold_table(df, order, label, features, n_splits, balance, **smote_params)
    counts = trainer(tried[0]).cross_validate(table, tried, range(1, n_splits + 1), weighted)
    scores = class_scores(counts, ["setting", "fold"]).groupBy("setting", "fold").agg(F.avg("f1_score").alias("f1_macro"))
    params = F.element_at(F.array(*[F.lit(str(dict(s))) for s in settings]), F.col("setting") + 1)
    mean = F.avg("f1_macro").over(Window.partitionBy("setting"))
    scored = stage(scores.select("setting", params.alias("params"), "fold", "f1_macro", mean.alias("mean_f1_macro")), "scores")
    top = scored.orderBy(F.desc("mean_f1_macro"), "setting").first()
    best = dict(settings[top.setting])
    if not refit:
        return scored, best, None
    if balance:
        rows = smote(df, label, features, order, **smote_params).select(*features, label)
        table = bin_table(stage(rows, "balanced"), features, label, edges=table.edges)
    return scored, best, trainer(tried[0]).train(table, tried[top.setting], weighted)
