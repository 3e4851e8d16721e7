"""Boosted trees: margins against plain loops, both ways of training, scores and searches."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.operators import boosting, forests, models
from seriesloom.operators.boosting import Boosting

FEATURES = ["a", "b", "c"]


def rows_of(n, seed=1, noise=0.1):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 3))
    y = np.where(x[:, 0] * x[:, 1] > 0.3, "p", np.where(x[:, 2] > 0, "q", "r"))
    y = np.where(r.random(n) < noise, r.choice(["p", "q", "r"], n), y)
    return [(i, *map(float, x[i]), str(y[i])) for i in range(n)]


@pytest.fixture(scope="module")
def table(spark):
    df = spark.createDataFrame(rows_of(800), "i long, a double, b double, c double, y string").repartition(3, "i")
    return df.withColumn("part", F.least(F.lit(3), F.floor(F.col("i") / 200)).cast("int")).cache()


@pytest.fixture(scope="module")
def binned(table):
    return forests.bin_table(table, FEATURES, "y", F.col("part"))


def plain_margins(bins, y, rows, weights, classes, setting, n_bins):
    """Loops over rounds, classes, nodes, features, bins and rows."""
    n = len(y)
    margins = [[0.0] * classes for _ in range(n)]
    for number in range(setting.rounds):
        shares = []
        for m in margins:
            e = [math.exp(v - max(m)) for v in m]
            shares.append([v / sum(e) for v in e])
        for c in range(classes):
            tree = np.array([number * classes + c])
            taken = boosting.sampled(setting, tree, rows)[0]
            allowed = boosting.usable(setting, tree, len(bins))[0]
            g = [weights[i] * (shares[i][c] - (y[i] == c)) * bool(taken[i]) for i in range(n)]
            h = [weights[i] * max(2 * shares[i][c] * (1 - shares[i][c]), 1e-16) * bool(taken[i]) for i in range(n)]

            def add(members, depth, g=g, h=h, c=c, allowed=allowed):
                total_g, total_h = sum(g[i] for i in members), sum(h[i] for i in members)
                worth = lambda a, b: a * a / (b + setting.l2)
                options = []
                for f in range(len(bins)) if depth < setting.max_depth else ():
                    if not allowed[f]:
                        continue
                    for cut in range(n_bins - 1):
                        left = [i for i in members if bins[f][i] <= cut]
                        a, b = sum(g[i] for i in left), sum(h[i] for i in left)
                        if b < setting.min_child_weight or total_h - b < setting.min_child_weight:
                            continue
                        gain = worth(a, b) + worth(total_g - a, total_h - b) - worth(total_g, total_h)
                        options.append((gain, f, cut))
                best = max(options, default=(0, 0, 0))[0]
                if best <= max(setting.gamma, 1e-6):
                    for i in members:
                        margins[i][c] -= setting.rate * total_g / (total_h + setting.l2)
                    return
                f, cut = next((f, cut) for gain, f, cut in options if gain >= best - 1e-9 * (1 + best))
                add([i for i in members if bins[f][i] <= cut], depth + 1)
                add([i for i in members if bins[f][i] > cut], depth + 1)

            add(list(range(n)), 0)
    return np.array(margins).T


@pytest.mark.parametrize("setting", [Boosting(3, 3), Boosting(2, 6, 0.1, 0.7, 0.6, 2.0, 0.5, 0.3, seed=9)])
def test_margins_equal_a_plain_loop(setting):
    r = np.random.default_rng(3)
    n = 500
    bins = r.integers(0, 8, (4, n)).astype(np.uint8)
    y = ((bins[0] > 3).astype(int) + (bins[1] > 5) * (r.random(n) < 0.8)).astype(np.int64)
    weights = np.where(y == 0, 0.5, 2.0)
    rows = np.arange(n) * 3
    margins, _ = boosting.boost(bins, y, rows, weights, 3, setting, 8)
    assert np.allclose(margins, plain_margins(bins, y, rows, weights, 3, setting, 8), atol=1e-9)


def test_rows_of_weight_zero_are_scored_alone():
    r = np.random.default_rng(4)
    bins = r.integers(0, 16, (3, 300)).astype(np.uint8)
    y = (bins[0] + bins[1] > 15).astype(np.int64)
    once, _ = boosting.boost(bins[:, :200], y[:200], np.arange(200), np.ones(200), 2, Boosting(5), 16)
    both, _ = boosting.boost(bins, y, np.arange(300), np.r_[np.ones(200), np.zeros(100)], 2, Boosting(5), 16)
    assert np.allclose(both[:, :200], once)
    assert (both[:, 200:].argmax(axis=0) == y[200:]).mean() > 0.85


def test_separable_classes_are_learned(spark):
    df = spark.createDataFrame(rows_of(1500, seed=5, noise=0), "i long, a double, b double, c double, y string")
    model = models.train_trees(df.where("i < 1000"), "y", FEATURES, Boosting(40))
    late = model.predict(df.where("i >= 1000"))
    assert late.where("y = prediction").count() > 0.93 * 500
    early = models.train_trees(df.where("i < 1000"), "y", FEATURES, Boosting(2)).predict(df.where("i >= 1000"))
    assert early.where("y = prediction").count() < late.where("y = prediction").count()


SETTINGS = [Boosting(3, 3), Boosting(3, 4, 0.1, 0.8, 0.7, 3.0, 1.0)]


@pytest.mark.parametrize("weighted", [True])
def test_both_ways_give_the_same_trees(binned, weighted, monkeypatch):
    monkeypatch.setattr(boosting, "STATE_ROUNDS", 2)
    monkeypatch.setattr(boosting, "HIST_BYTES", 16 * 3 * 32 * 6)  # six nodes in a pass
    local = boosting.cross_validate(binned, SETTINGS, [3], weighted)
    spread = boosting.cross_validate(binned, SETTINGS, [3], weighted, local_bytes=0)
    key = lambda df: sorted(map(tuple, df.select("setting", "fold", "truth", "pred", "n").collect()))
    assert key(local) == key(spread)
    assert {r.n for r in local.groupBy("setting", "fold").agg(F.sum("n").alias("n")).collect()} == {200}
    one, other = (boosting.train(binned, SETTINGS[1], weighted, fold=3, local_bytes=size).nodes.orderBy("tree", "path").collect() for size in (1 << 20, 0))
    assert [(r.tree, r.path, r.feature, r.bin if r.feature >= 0 else 0) for r in one] == [(r.tree, r.path, r.feature, r.bin if r.feature >= 0 else 0) for r in other]
    assert np.allclose([r.counts for r in one], [r.counts for r in other])


def test_model_scores_as_training_did(binned, table):
    model = boosting.train(binned, SETTINGS[0], fold=3)
    right = model.predict(table.where("part = 3")).where("y = prediction").count()
    assert right == boosting.cross_validate(binned, [SETTINGS[0]], [3]).where("truth = pred").agg(F.sum("n")).first()[0]


def test_search_keeps_every_score(table):
    settings = models.sample_settings({"rounds": (2, 6), "rate": (0.1, 0.4), "gamma": (0.0, 1.0)}, 3)
    scores, best, model = models.random_search(table, ["i"], "y", FEATURES, settings, n_splits=2, weighted=True, kind=Boosting)
    assert scores.count() == 6 and best in settings and isinstance(model, boosting.BoostModel)
    assert model.predict(table).where("y = prediction").count() > 400


def test_missing_values_and_one_class(spark):
    rows = [(None, "x"), (float("nan"), "x"), (float("-inf"), "x"), (float("inf"), "y"), (2.0, "y"), (1.0, None)] * 9
    df = spark.createDataFrame(rows, "a double, y string")
    found = models.train_trees(df, "y", ["a"], Boosting(8)).predict(df)
    assert {tuple(r) for r in found.where("y IS NOT NULL").select("y", "prediction").collect()} == {("x", "x"), ("y", "y")}
    assert {r.prediction for r in models.train_trees(df.where("y = 'x'"), "y", ["a"], Boosting(2)).predict(df).collect()} == {"x"}
