"""Forests: the same trees in one task and level by level, splits against plain loops, scores against MLlib's."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.operators import forests, models, trees
from seriesloom.operators.report import class_scores, f1_macro
from seriesloom.operators.trees import Forest

FEATURES = ["a", "b", "c", "d"]


def rows_of(n, seed=1):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 4))
    y = np.where(x[:, 0] + 0.5 * x[:, 1] > 0.6, "high", np.where(x[:, 2] > 0.9, "mid", "low"))
    y = np.where(r.random(n) < 0.1, r.choice(["high", "mid", "low"], n), y)
    return [(i, *map(float, x[i]), str(y[i])) for i in range(n)]


@pytest.fixture(scope="module")
def table(spark):
    df = spark.createDataFrame(rows_of(900), "i long, a double, b double, c double, d double, y string").repartition(4, "i")
    return df.selectExpr("*", "int(least(3, i div 225)) AS part", "'z' AS bins", "7 AS unit").cache()


@pytest.fixture(scope="module")
def binned(table):
    return forests.bin_table(table, FEATURES, "y", F.col("part"))


def plain_tree(bins, y, times, forest, weights, n_bins, tree, path=1):
    """Nodes by recursion and loops over every feature and bin: path -> (feature, bin, counts)."""
    classes = len(weights)
    counts = np.bincount(y, times, classes)
    node = {path: (-1, 0, counts.tolist())}
    depth = path.bit_length() - 1
    if depth >= forest.depth or counts.sum() < max(forest.min_split, 2 * forest.min_leaf) or counts.max() == counts.sum():
        return node
    pure = lambda c: ((c * weights) ** 2).sum() / max((c * weights).sum(), 1e-300)
    best = pure(counts)
    best += trees.LEAST_GAIN * max(best, 1)
    found = None
    for f in trees.usable_features(forest.seed, np.array([tree]), np.array([path]), len(bins), forest.per_node(len(bins)))[0]:
        for cut in range(n_bins - 1):
            left = bins[f] <= cut
            a, b = (np.bincount(y[m], times[m], classes) for m in (left, ~left))
            if min(a.sum(), b.sum()) >= forest.min_leaf and pure(a) + pure(b) > best + 1e-12:
                best, found = pure(a) + pure(b), (int(f), cut, left)
    if found is None:
        return node
    f, cut, left = found
    node[path] = (f, cut, counts.tolist())
    for side, use in enumerate((left, ~left)):
        node |= plain_tree(bins[:, use], y[use], times[use], forest, weights, n_bins, tree, 2 * path + side)
    return node


@pytest.mark.parametrize("forest", [Forest(3, None, 2, 1, "all"), Forest(3, 4, 12, 5, "sqrt"), Forest(3, 6, 2, 2, 0.75, seed=-9)])
@pytest.mark.parametrize("weights", [np.ones(3), np.array([0.5, 4.0, 1.25])])
def test_trees_equal_plain_recursion(forest, weights):
    r = np.random.default_rng(2)
    bins = r.integers(0, 6, (4, 150)).astype(np.uint8)
    y = r.integers(0, 3, 150)
    rows = np.arange(150) * 7
    grown, _ = trees.grow_trees(bins, y, rows, np.arange(3), forest, weights, 6)
    got = {}
    for level in grown:
        for t, p, f, b, c in zip(level.tree, level.path, level.feature, level.bin, level.counts):
            got[int(t), int(p)] = (int(f), int(b) if f >= 0 else 0, c.tolist())
    expected = {}
    for t in range(3):
        times = trees.taken(forest.seed, np.array([t]), rows)[0]
        use = times > 0
        for p, node in plain_tree(bins[:, use], y[use], times[use], forest, weights, 6, t).items():
            expected[t, p] = node
    assert got == expected


def test_rows_are_taken_once_on_average():
    times = trees.taken(5, np.arange(40), np.arange(2000))
    assert abs(times.mean() - 1) < 0.02 and abs((times == 0).mean() - np.exp(-1)) < 0.01
    assert (times[:, 100:200] == trees.taken(5, np.arange(40), np.arange(100, 200))).all()
    assert len({t.tobytes() for t in times}) == 40


FORESTS = [Forest(6, 8, 2, 1, "sqrt"), Forest(5, None, 6, 3, "all"), Forest(4, 2, 2, 1, "log2", seed=3)]


@pytest.mark.parametrize("weighted", [True])
def test_level_by_level_gives_the_same_forests(binned, weighted, monkeypatch):
    """Nodes of more than 60 rows are split by summed histograms, in waves of few trees."""
    monkeypatch.setattr(forests, "WAVE_TREES", 3)
    small = 60 * len(FEATURES)
    local = forests.cross_validate(binned, FORESTS, [1, 3], weighted)
    spread = forests.cross_validate(binned, FORESTS, [1, 3], weighted, local_bytes=small)
    key = lambda df: sorted(map(tuple, df.select("setting", "fold", "truth", "pred", "n").collect()))
    assert key(local) == key(spread)
    assert local.groupBy("setting", "fold").agg(F.sum("n").alias("n")).select("n").distinct().collect() == [(225,)]
    nodes = [
        sorted((r.tree, r.path, r.feature, r.bin if r.feature >= 0 else 0, tuple(r.counts)) for r in forests.train(binned, FORESTS[1], weighted, fold=3, local_bytes=size).nodes.collect())
        for size in (1 << 20, small)
    ]
    assert nodes[0] == nodes[1] and len({n[0] for n in nodes[0]}) == 5


def test_model_scores_a_table_in_any_number_of_passes(binned, table, monkeypatch):
    model = forests.train(binned, Forest(12, 8), fold=3)
    once = model.predict(table.where("part = 3").select("i", "y", "c", "b", "a", "d", "unit")).select("i", "unit", "y", "prediction").orderBy("i").collect()
    monkeypatch.setattr(forests, "MODEL_BYTES", 1)
    assert model.predict(table.where("part = 3")).select("i", "unit", "y", "prediction").orderBy("i").collect() == once
    votes = forests.cross_validate(binned, [Forest(12, 8)], [3]).where("truth = pred").agg(F.sum("n")).first()[0]
    assert sum(r.y == r.prediction for r in once) == votes > 0.7 * len(once)


def test_macro_f1_is_that_of_the_library(spark):
    """Held out, on rows that both learn from: within 0.02 of MLlib's forest."""
    df = spark.createDataFrame(rows_of(4000, seed=5), "i long, a double, b double, c double, d double, y string").withColumn("part", (F.col("i") >= 2500).cast("int"))
    library = models.fit(models.random_forest(FEATURES, "y", 100, 10), df.where("part = 0"), "y")
    expected = f1_macro(models.predict(library, df.where("part = 1")), "y", "prediction").first()[0]
    pairs = forests.cross_validate(forests.bin_table(df, FEATURES, "y", F.col("part")), [Forest(100, 10)], [1])
    found = class_scores(pairs).agg(F.avg("f1_score")).first()[0]
    assert abs(found - expected) < 0.02


def test_missing_values_labels_and_ties(spark):
    rows = [(None, 1.0, "x"), (float("nan"), 1.0, "x"), (float("-inf"), 1.0, "x"), (float("inf"), 1.0, "y"), (2.0, 1.0, "y"), (2.0, 1.0, "y"), (1.0, 1.0, None)] * 8
    df = spark.createDataFrame(rows, "a double, b double, y string")
    binned = forests.bin_table(df, ["a", "b"], "y")
    assert binned.rows == 48 and binned.labels == ["x", "y"]
    found = forests.train(binned, Forest(9, 3, features="all")).predict(df).select("y", "prediction").distinct().collect()
    assert {tuple(r) for r in found} >= {("x", "x"), ("y", "y")} and ("x", "y") not in {tuple(r) for r in found}
    with pytest.raises(ValueError):
        forests.bin_table(df.where("y IS NULL"), ["a", "b"], "y")
    one = forests.bin_table(df.where("y = 'x'"), ["a", "b"], "y")
    assert {r.prediction for r in forests.train(one, Forest(2)).predict(df).collect()} == {"x"}


def test_search_reports_every_setting_and_refits_the_best(spark, table):
    settings = [{"num_trees": 5, "max_depth": 1}, {"num_trees": 15, "max_depth": 8, "features": "all"}]
    scores, best, model = models.random_search(table, ["i"], "y", FEATURES, settings, n_splits=3)
    rows = scores.collect()
    assert {(r.setting, r.fold) for r in rows} == {(s, f) for s in range(2) for f in (1, 2, 3)}
    means = {s: np.mean([r.f1_macro for r in rows if r.setting == s]) for s in range(2)}
    assert all(abs(r.mean_f1_macro - means[r.setting]) < 1e-12 for r in rows)
    assert best == settings[max(means, key=means.get)]
    right = model.predict(table).where("y = prediction").count()
    assert right > 0.85 * table.count()


def test_balanced_folds_test_original_rows_alone(table):
    binned = models.fold_table(table, ["i"], "y", FEATURES, n_splits=2, balance=True)
    tested = {f: sum(n for (part, only, _), n in binned.counts.items() if part == f and only == 0) for f in (1, 2)}
    assert tested == {1: 300, 2: 300}
    for f in (1, 2):
        weights = binned.weights(f, True)
        assert np.allclose(weights, 1)  # every class is as large as the largest
