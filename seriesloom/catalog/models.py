"""Balancing, training, scoring, cross-validation and search.

They learn from the model-ready panel of the given tables. SQL cannot train, so the
rows of these queries are checked by tests; beside them stand queries of facts that
SQL can state: which rows are scored, that predictions are known classes, that a
model is the same from disk, how many rows a fold has.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import balance, encode, forests, models, report, sequence_model
from ..operators.split import split_years, timeseries_folds
from ..operators.boosting import Boosting
from ..operators.columns import feature_columns, normalize_key
from ..operators.merge import lookup_join
from ..operators.ordering import bottom_n, top_n
from ..operators.series import Series
from ..operators.trees import Forest
from ..operators.windows import sequence_windows
from ..plans import panel as plans
from ..plans.evaluation import compare_models as compare_plan
from ..plans.training import load_final, train_final
from ..sources.staging import stage, staging_path
from . import basic
from .inputs import ROLES, table
from .registry import query

LABEL = "target_1m_ahead"
NOT_FEATURES = [
    "entity", "year", "month", "date", "future_drought_class",
    "target_1m_ahead", "target_2m_ahead", "target_3m_ahead",
]
SEQUENCE = ["wet", "m1", "m2", "dry", "g", "t", "month_sin", "month_cos"]
KEYS = ["entity", "date"]
ORDER = ["date", "entity"]
TRAIN_YEARS, TEST_YEARS = range(1995, 2000), [2000, 2001]
TREES = 300
BOOST_ROUNDS = 100


def ready(spark, sf_dir):
    """The model-ready table, staged: training reads it many times."""
    features = plans.build_features(basic.clean_panel(spark, sf_dir), ROLES)
    return stage(plans.build_model_ready(features, ROLES), "ready")


def split_ready(spark, sf_dir):
    return split_years(ready(spark, sf_dir), TRAIN_YEARS, TEST_YEARS)


def features_of(df):
    return feature_columns(df, NOT_FEATURES)


def forest(df, **params):
    return models.random_forest(features_of(df), LABEL, **({"num_trees": TREES} | params))


def importances(spark, model):
    tree = model.stages[1]
    values = tree.featureImportances.toArray().tolist()
    names = models.feature_order(model)
    return spark.createDataFrame(
        list(zip(names, values)), "feature string, importance double"
    )


def vectors(spark, sf_dir):
    """Embeddings as feature columns, with uneven classes."""
    df = table(spark, sf_dir, "embeddings")
    dims = df.select(F.size("embedding")).first()[0]
    names = [f"f{i}" for i in range(dims)]
    label = F.when(F.col("label") < 5, "many").when(F.col("label") < 8, "some").otherwise("few")
    df = df.select("vec_id", label.alias("label"), *[F.col("embedding")[i].alias(n) for i, n in enumerate(names)])
    return df, names


CLASS_SQL = """WITH c AS (SELECT CASE WHEN label < 5 THEN 'many' WHEN label < 8 THEN 'some' ELSE 'few' END AS label,
  count(*) AS n FROM embeddings GROUP BY ALL)"""


@query("smote")
def smote(spark, sf_dir):
    df, names = vectors(spark, sf_dir)
    return balance.smote(df, "label", names, "vec_id")


@query("smote_counts", f"{CLASS_SQL} SELECT label, n AS before, (SELECT max(n) FROM c) AS after FROM c")
def smote_counts(spark, sf_dir):
    df, names = vectors(spark, sf_dir)
    grown = balance.smote(df, "label", names, "vec_id").groupBy("label")
    return grown.agg(
        F.count_if(~F.col("synthetic")).alias("before"), F.count(F.lit(1)).alias("after")
    )


@query("rf_train")
def rf_train(spark, sf_dir):
    train, _ = split_ready(spark, sf_dir)
    return importances(spark, models.fit(forest(train), train, LABEL))


@query("rf_predict")
def rf_predict(spark, sf_dir):
    train, test = split_ready(spark, sf_dir)
    model = models.fit(forest(train), train, LABEL)
    return models.predict(model, test).select(*KEYS, LABEL, "prediction")


@query("rf_smote_weighted")
def rf_smote_weighted(spark, sf_dir):
    """Balanced rows and balanced weights together, then the report."""
    train, test = split_ready(spark, sf_dir)
    grown = stage(balance.smote(train, LABEL, features_of(train), KEYS), "grown")
    model = models.fit(forest(train, weighted=True), grown, LABEL)
    return report.classification_report(models.predict(model, test), LABEL, "prediction")


BOOSTING = Boosting(BOOST_ROUNDS)


@query("boost_train")
def boost_train(spark, sf_dir):
    """Boosted trees with class weights, and their report on the test years."""
    train, test = split_ready(spark, sf_dir)
    model = models.train_trees(train, LABEL, features_of(train), BOOSTING, weighted=True)
    return report.classification_report(model.predict(test), LABEL, "prediction")


@query("boost_predict")
def boost_predict(spark, sf_dir):
    """With the entity one-hot, absent from training or not."""
    train, test = split_ready(spark, sf_dir)
    values = encode.categories(train, "entity")
    wide = encode.one_hot_encode(train.withColumn("who", F.col("entity")), "who", values)
    late = encode.one_hot_encode(test.withColumn("who", F.col("entity")), "who", values)
    model = models.train_trees(wide, LABEL, features_of(wide), BOOSTING, weighted=True)
    return model.predict(late).select(*KEYS, LABEL, "prediction")


@query("boost_smote")
def boost_smote(spark, sf_dir):
    """Boosted trees on rows that SMOTE has balanced, and their report on the test years."""
    train, test = split_ready(spark, sf_dir)
    features = features_of(train)
    grown = stage(balance.smote(train, LABEL, features, KEYS), "grown")
    model = models.train_trees(grown, LABEL, features, BOOSTING)
    return report.classification_report(model.predict(test), LABEL, "prediction")


SEQUENCE_KEYS = ["entity", "date"]


def scored_windows(spark, sf_dir):
    """Windows of the test years with the prediction of a model trained on those before."""
    df = stage(sequence_windows(ready(spark, sf_dir), Series.of("entity", "date"), SEQUENCE, 12), "windows")
    train, test = split_years(df, TRAIN_YEARS, TEST_YEARS)
    return sequence_model.train(train, "entity", LABEL, weighted=True).predict(test)


@query("sequence_classify")
def sequence_classify(spark, sf_dir):
    return scored_windows(spark, sf_dir).select(*SEQUENCE_KEYS, LABEL, "prediction", "probability")


@query("sequence_entity_report")
def sequence_entity_report(spark, sf_dir):
    """How well each entity's windows are classified: the five best and the five worst, by name."""
    scored = stage(scored_windows(spark, sf_dir), "scored")
    recalls = {"extreme_recall": "Extreme", "moderate_recall": "Moderate"}
    numbers = normalize_key(table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("number")), "name")
    by_entity = lookup_join(report.entity_report(scored, "entity", LABEL, "prediction", recalls), numbers, "entity", "name")
    by_entity = stage(by_entity.drop("name"), "by-entity")
    best, worst = (some(by_entity, 5, report.ACCURACY, "entity") for some in (top_n, bottom_n))
    return best.withColumn("place", F.lit("best")).unionByName(worst.withColumn("place", F.lit("worst")))


@query("final_training")
def final_training(spark, sf_dir):
    """Balanced final forest: the report on the test years, as stored."""
    train, test = split_ready(spark, sf_dir)
    done = train_final(train, test, LABEL, features_of(train), KEYS, staging_path(spark, "final"))
    return spark.read.schema(done.report.schema).json(done.metrics_path)


@query("model_save_load")
def model_save_load(spark, sf_dir):
    """Predictions of a model before and after it went to disk."""
    train, test = split_ready(spark, sf_dir)
    model = models.fit(forest(train), train, LABEL)
    path = models.save_model(model, staging_path(spark, "model"))
    before = models.predict(model, test, "before")
    return models.predict(models.load_model(path), before, "after").select(*KEYS, "before", "after")


@query("score_batch")
def score_batch(spark, sf_dir):
    """A stored model on a table that lacks one of its columns."""
    train, test = split_ready(spark, sf_dir)
    path = models.save_model(models.fit(forest(train), train, LABEL), staging_path(spark, "model"))
    return models.score_batch(path, test.drop("m4_pct"), [*KEYS, LABEL])


FOREST = {"num_trees": TREES, "max_depth": 10}


@query("cross_validate")
def cross_validate(spark, sf_dir):
    """Weighted forests over expanding folds of the training years."""
    df, _ = split_ready(spark, sf_dir)
    pairs = models.cross_validate_trees(df, ORDER, LABEL, features_of(df), [Forest(**FOREST)], weighted=True)
    return fold_accuracy(pairs)


def fold_accuracy(pairs):
    right = F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0))
    return pairs.groupBy("fold").agg((right / F.sum("n")).alias("accuracy"))


@query("cross_validate_smote")
def cross_validate_smote(spark, sf_dir):
    """Forests on folds whose training part SMOTE has grown, with their full reports."""
    df, _ = split_ready(spark, sf_dir)
    pairs = models.cross_validate_trees(
        df, ORDER, LABEL, features_of(df), [Forest(**FOREST)], weighted=True, balance=True
    )
    return report.report_of_counts(pairs, ["fold"])


# The search space and the grid of forests
FOREST_SPACE = {
    "num_trees": (100, 500),
    "max_depth": (5, 30),
    "min_split": (2, 10),
    "min_leaf": (1, 5),
    "features": ["sqrt", "log2", "all"],
}
FOREST_GRID = {
    "num_trees": [200, 500, 800],
    "max_depth": [None, 10, 20],
    "min_split": [2, 5, 10],
    "min_leaf": [1, 2, 4],
    "features": ["sqrt", "log2"],
}
# The search space of boosted trees
BOOST_SPACE = {
    "rounds": (200, 1200),
    "max_depth": (3, 15),
    "rate": (0.01, 0.31),
    "subsample": (0.6, 1.0),
    "features": (0.6, 1.0),
    "min_child_weight": (1, 10),
    "gamma": (0.0, 5.0),
}
SEARCH_SETTINGS, SEARCH_FOLDS = 50, 5


def searched(spark, sf_dir, space=FOREST_SPACE, **options):
    df, _ = split_ready(spark, sf_dir)
    settings = models.sample_settings(space, SEARCH_SETTINGS)
    return models.random_search(df, ORDER, LABEL, features_of(df), settings, SEARCH_FOLDS, **options)


@query("random_search")
def random_search(spark, sf_dir):
    """SEARCH_SETTINGS settings of the whole space over SEARCH_FOLDS folds of the training years."""
    scores, _, _ = searched(spark, sf_dir)
    return scores.select("setting", "params", "mean_f1_macro").distinct()


@query("random_search_smote")
def random_search_smote(spark, sf_dir):
    """The same search where each fold's training part is grown by SMOTE and weighted by class."""
    return searched(spark, sf_dir, weighted=True, balance=True)[0]


@query("boost_search")
def boost_search(spark, sf_dir):
    """Settings of boosted trees with class weights: every score of every fold."""
    return searched(spark, sf_dir, BOOST_SPACE, weighted=True, kind=Boosting)[0]


@query("param_grid")
def param_grid(spark, sf_dir):
    """Every setting of the grid, with the accuracy of its forest on the test years."""
    df = ready(spark, sf_dir).where(F.col("year").between(min(TRAIN_YEARS), max(TEST_YEARS)))
    late = F.col("year").isin(TEST_YEARS).cast("int")
    binned = forests.bin_table(df, features_of(df), LABEL, part=late, edges=forests.edges_of(df.where(late == 0), features_of(df)))
    grid = models.param_grid(FOREST_GRID)
    pairs = forests.cross_validate(binned, [Forest(**s) for s in grid], [1])
    right = F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0))
    values = [F.element_at(F.array(*[F.lit(str(s[k])) for s in grid]), F.col("setting") + 1).alias(k) for k in FOREST_GRID]
    return pairs.groupBy("setting").agg((right / F.sum("n")).alias("accuracy")).select("accuracy", *values)


@query("compare_models")
def compare_models(spark, sf_dir):
    df = ready(spark, sf_dir)
    return compare_plan(
        df,
        features_of(df),
        SEQUENCE,
        LABEL,
        "entity",
        ratio=0.8,
        num_trees=TREES,
        rounds=BOOST_ROUNDS,
    )


# ---- facts about the above that SQL can state

YEARS = {"train": "1995 AND 1999", "test": "2000 AND 2001"}


def ready_sql(part: str) -> str:
    return f"(SELECT * FROM ({basic.READY}) WHERE year BETWEEN {YEARS[part]})"


SCORED_SQL = f"""SELECT count(*) AS rows, count(DISTINCT entity) AS entities, min(CAST(date AS VARCHAR)) AS first,
    max(CAST(date AS VARCHAR)) AS last, CAST(0 AS BIGINT) AS unknown FROM {ready_sql('test')}"""


def scored_facts(spark, sf_dir, scored):
    """Rows, entities and dates scored, and predictions that are no class of the training years."""
    train, _ = split_ready(spark, sf_dir)
    classes = train.select(F.col(LABEL).alias("prediction")).distinct().withColumn("known", F.lit(True))
    checked = scored.join(classes, "prediction", "left")
    day = F.col("date").cast("date").cast("string")
    return checked.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("entity").alias("entities"),
        F.min(day).alias("first"),
        F.max(day).alias("last"),
        F.count_if(F.col("known").isNull()).alias("unknown"),
    )


@query("rf_predict_facts", SCORED_SQL)
def rf_predict_facts(spark, sf_dir):
    return scored_facts(spark, sf_dir, rf_predict(spark, sf_dir))


WINDOWS_SQL = f"""WITH w AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date) AS place FROM ({basic.READY}))
    SELECT count(*) AS rows, count(DISTINCT entity) AS entities, min(CAST(date AS VARCHAR)) AS first, max(CAST(date AS VARCHAR)) AS last,
    CAST(0 AS BIGINT) AS unknown FROM w WHERE place > 12 AND year BETWEEN {YEARS['test']}"""


@query("sequence_classify_facts", WINDOWS_SQL)
def sequence_classify_facts(spark, sf_dir):
    return scored_facts(spark, sf_dir, sequence_classify(spark, sf_dir))


REPORT_SQL = f"SELECT {LABEL} AS label, count(*) AS support FROM {ready_sql('test')} WHERE {LABEL} IS NOT NULL GROUP BY ALL"


def report_facts(reported):
    """Rows of each true class in a report."""
    summaries = [report.ACCURACY, report.MACRO, report.WEIGHTED]
    return reported.where(~F.col("label").isin(summaries) & (F.col("support") > 0)).select("label", "support")


@query("boost_train_facts", REPORT_SQL)
def boost_train_facts(spark, sf_dir):
    return report_facts(boost_train(spark, sf_dir))


@query("boost_smote_facts", REPORT_SQL)
def boost_smote_facts(spark, sf_dir):
    return report_facts(boost_smote(spark, sf_dir))


@query("rf_smote_weighted_facts", REPORT_SQL)
def rf_smote_weighted_facts(spark, sf_dir):
    return report_facts(rf_smote_weighted(spark, sf_dir))


@query(
    "final_training_facts",
    f"""SELECT count(*) AS rows, CAST(0 AS BIGINT) AS changed, CAST(1 AS BIGINT) AS same_order,
    (SELECT count(*) FROM {ready_sql('test')} WHERE {LABEL} IS NOT NULL) AS reported FROM {ready_sql('test')}""",
)
def final_training_facts(spark, sf_dir):
    """The stored model scores as the trained one, on the features in the same order; the stored report has every row."""
    train, test = split_ready(spark, sf_dir)
    path = staging_path(spark, "final")
    done = train_final(train, test, LABEL, features_of(train), KEYS, path)
    stored = load_final(spark, path)
    both = stored.predict(done.model.predict(test, "before"), "after")
    metrics = spark.read.schema(done.report.schema).json(done.metrics_path).where(F.col("label") == report.MACRO)
    return both.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~F.col("before").eqNullSafe(F.col("after"))).alias("changed"),
        F.lit(int(stored.features == features_of(train))).cast("long").alias("same_order"),
        F.lit(metrics.first().support).alias("reported"),
    )


@query("compare_models_facts", f"SELECT CAST(3 AS BIGINT) AS models, CAST(0 AS BIGINT) AS missing")
def compare_models_facts(spark, sf_dir):
    """Every compared row has a prediction of each model."""
    compared = compare_models(spark, sf_dir)
    predictions = [c for c in compared.columns if c.endswith("_pred")]
    missing = sum((F.col(c).isNull().cast("long") for c in predictions), F.lit(0))
    return compared.agg(F.lit(len(predictions)).cast("long").alias("models"), F.sum(missing).alias("missing"))


@query("boost_predict_facts", SCORED_SQL)
def boost_predict_facts(spark, sf_dir):
    return scored_facts(spark, sf_dir, boost_predict(spark, sf_dir))


@query("score_batch_facts", SCORED_SQL)
def score_batch_facts(spark, sf_dir):
    return scored_facts(spark, sf_dir, score_batch(spark, sf_dir))


@query(
    "model_save_load_facts",
    f"SELECT count(*) AS rows, CAST(0 AS BIGINT) AS changed FROM {ready_sql('test')}",
)
def model_save_load_facts(spark, sf_dir):
    both = model_save_load(spark, sf_dir)
    return both.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~F.col("before").eqNullSafe(F.col("after"))).alias("changed"),
    )


@query(
    "cross_validate_facts",
    f"""WITH n AS (SELECT count(*) AS n FROM {ready_sql('train')}), f AS (SELECT unnest(range(1, 6)) AS fold)
    SELECT CAST(fold AS INTEGER) AS fold, n - (6 - fold) * (n // 6) AS train, n // 6 AS test FROM n, f""",
)
def cross_validate_facts(spark, sf_dir):
    """Rows that each fold of the cross-validation trains on and tests on."""
    df, _ = split_ready(spark, sf_dir)
    folds = timeseries_folds(df, ORDER).groupBy("fold")
    return folds.agg(F.count_if(F.col("role") == "train").alias("train"), F.count_if(F.col("role") == "test").alias("test"))


SEARCH_SQL = f"""SELECT CAST(fold AS INTEGER) AS fold, {SEARCH_SETTINGS} AS settings, {SEARCH_SETTINGS} AS scored
    FROM (SELECT unnest(range(1, {SEARCH_FOLDS + 1})) AS fold)"""


def search_facts(scores):
    """Settings scored on each fold, and scores between 0 and 1."""
    between = F.count_if(F.col("f1_macro").between(0, 1)).cast("int")
    return scores.groupBy("fold").agg(F.count_distinct("setting").cast("int").alias("settings"), between.alias("scored"))


@query("random_search_facts", SEARCH_SQL)
def random_search_facts(spark, sf_dir):
    return search_facts(searched(spark, sf_dir, refit=False)[0])


@query("boost_search_facts", SEARCH_SQL)
def boost_search_facts(spark, sf_dir):
    return search_facts(searched(spark, sf_dir, BOOST_SPACE, weighted=True, kind=Boosting, refit=False)[0])


@query(
    "param_grid_facts",
    f"SELECT CAST(162 AS BIGINT) AS settings, CAST(162 AS BIGINT) AS scored, (SELECT count(*) FROM {ready_sql('test')}) AS rows",
)
def param_grid_facts(spark, sf_dir):
    """Settings of the grid, those with a share of right rows, and the rows that this is a share of."""
    test = split_ready(spark, sf_dir)[1].agg(F.count(F.lit(1)).alias("rows"))
    grid = param_grid(spark, sf_dir)
    whole = F.col("accuracy") * F.col("rows")
    counted = grid.join(F.broadcast(test), how="cross").groupBy("rows")  # one row
    return counted.agg(F.count(F.lit(1)).alias("settings"), F.count_if(F.abs(whole - F.round(whole)) < 1e-6).alias("scored")).select("settings", "scored", "rows")


@query(
    "smote_facts",
    f"{CLASS_SQL} SELECT label, n AS kept, CAST(0 AS BIGINT) AS outside FROM c",
)
def smote_facts(spark, sf_dir):
    """Rows kept as they were, and synthetic rows outside the ranges of their class."""
    df, names = vectors(spark, sf_dir)
    grown = balance.smote(df, "label", names, "vec_id")
    doubles = df.select("label", *[F.col(c).cast("double").alias(c) for c in names])
    ranges = doubles.groupBy("label").agg(
        F.array(*[F.min(c) for c in names]).alias("low"), F.array(*[F.max(c) for c in names]).alias("high")
    )
    kept = grown.where("not synthetic").select("label", *names).exceptAll(doubles)
    lost = doubles.exceptAll(grown.where("not synthetic").select("label", *names))
    wrong = kept.unionByName(lost).groupBy("label").count().withColumnRenamed("count", "wrong")
    values = grown.where("synthetic").select("label", F.array(*names).alias("vec")).join(ranges, "label")
    inside = F.forall(
        F.arrays_zip("vec", "low", "high"), lambda v: (v["vec"] >= v["low"] - 1e-9) & (v["vec"] <= v["high"] + 1e-9)
    )
    outside = values.groupBy("label").agg(F.count_if(~inside).alias("outside"))
    counts = doubles.groupBy("label").count()
    return (
        counts.join(wrong, "label", "left")
        .join(outside, "label", "left")
        .select("label", (F.col("count") - F.coalesce("wrong", F.lit(0))).alias("kept"), F.coalesce("outside", F.lit(0)).alias("outside"))
    )
