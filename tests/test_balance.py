import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.operators.balance import class_weights, smote, with_class_weights
from seriesloom.operators import neighbor_tree
from seriesloom.operators.neighbor_tree import near_in_class
from seriesloom.operators.neighbors import nearest_in_class


def brute_force(rows, k):
    out = {}
    for i, c, v in rows:
        d = sorted(
            np.linalg.norm(np.array(v) - np.array(w)) for j, e, w in rows if e == c and j != i
        )
        out[i] = d[:k]
    return out


@pytest.mark.parametrize("kind", ["clusters", "copies", "small"])
def test_neighbours_match_brute_force(spark, kind):
    rng = random.Random(11)
    rows = []
    if kind == "clusters":
        for i in range(240):
            centre = (i % 5) * 10
            rows.append((i, i % 2, [centre + rng.random() for _ in range(3)]))
    elif kind == "copies":
        # a third of all rows are one point
        for i in range(150):
            v = [1.0, 2.0, 3.0] if i % 3 == 0 else [rng.random() * 5 for _ in range(3)]
            rows.append((i, 0, v))
    else:
        rows = [(i, i % 3, [rng.random()]) for i in range(9)]
    df = spark.createDataFrame(rows, "id bigint, cls int, vec array<double>")
    df = df.withColumn("is_query", F.lit(True))
    found = nearest_in_class(df, 5, pivots_per_class=6, block_rows=16).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.id, r.nth)):
        got.setdefault(r.id, []).append(r.dist)
    want = brute_force(rows, 5)
    assert got.keys() == want.keys()
    for i in want:
        assert got[i] == pytest.approx(want[i], abs=1e-9)


def test_smote_balances_and_stays_between_parents(spark):
    rng = random.Random(2)
    rows = [(i, "a" if i % 6 else "b", rng.random(), rng.random() * 3) for i in range(120)]
    rows += [(1000 + i, "c", 9.0, rng.random()) for i in range(4)]
    df = spark.createDataFrame(rows, "key int, y string, p double, q double")
    out = smote(df, "y", ["p", "q"], "key", leaf_rows=8).cache()
    counts = {r.y: r["count"] for r in out.groupBy("y").count().collect()}
    assert counts == {"a": 100, "b": 100, "c": 100}
    assert out.where(~F.col("synthetic")).count() == 124
    for label in ("b", "c"):
        own = np.array([(p, q) for _, y, p, q in rows if y == label])
        pairs = [(a, b) for a in own for b in own]
        for r in out.where((F.col("y") == label) & F.col("synthetic")).collect():
            x = np.array([r.p, r.q])
            off = [abs(np.linalg.norm(x - a) + np.linalg.norm(x - b) - np.linalg.norm(a - b)) for a, b in pairs]
            assert min(off) < 1e-9
    again = smote(df, "y", ["p", "q"], "key", leaf_rows=8)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, out.collect()))


def test_class_weights(spark):
    df = spark.createDataFrame([("a",)] * 6 + [("b",)] * 2 + [("c",)], "y string")
    got = {r.y: r.weight for r in class_weights(df, "y").collect()}
    assert got == pytest.approx({"a": 0.5, "b": 1.5, "c": 3.0})
    assert with_class_weights(df, "y").agg(F.sum("weight")).first()[0] == pytest.approx(9.0)


def neighbours(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.id, r.nth)):
        out.setdefault(r.id, []).append((r.nid, r.dist))
    return out


@pytest.mark.parametrize("n, leaf_rows", [(3000, 64), (20_000, 64), (20_000, 512)])
def test_tree_finds_nine_tenths_of_the_neighbours(spark, n, leaf_rows):
    """Uniform rows: nothing to help the search. The number of leaves is 47 to 313."""
    x = np.random.default_rng(7).random((n, 6))
    rows = [(i, 0, x[i].tolist()) for i in range(n)]
    df = spark.createDataFrame(rows, "id bigint, cls int, vec array<double>")
    every = n // 300
    found = neighbours(near_in_class(df.withColumn("is_query", F.col("id") % every == 0), 5, leaf_rows))
    asked = range(0, n, every)
    assert found.keys() == set(asked) and {len(v) for v in found.values()} == {5}
    hits = 0
    for i in asked:
        d = np.linalg.norm(x - x[i], axis=1)
        d[i] = np.inf
        true = set(np.argsort(d)[:5].tolist())
        hits += len(true & {j for j, _ in found[i]})
        assert [d[j] for j, _ in found[i]] == pytest.approx([dist for _, dist in found[i]])
    assert hits >= 0.9 * 5 * len(asked)


def test_tree_by_class_with_copies(spark):
    """A third of all rows are one point, spread over classes with one and many leaves."""
    rng = random.Random(3)
    rows = [(i, "big" if i % 7 else "small", [1.0, 2.0] if i % 3 == 0 else [rng.random() * 9, rng.random()]) for i in range(1400)]
    df = spark.createDataFrame(rows, "id bigint, cls string, vec array<double>").withColumn("is_query", F.col("id") % 4 == 0)
    found = neighbours(near_in_class(df.repartition(5), 5, leaf_rows=40, probes=400))
    want = brute_force(rows, 5)
    cls = {i: c for i, c, _ in rows}
    assert found.keys() == {i for i, _, _ in rows if i % 4 == 0}
    for i, near in found.items():
        assert [d for _, d in near] == pytest.approx(want[i], abs=1e-9)  # every leaf is looked into
        assert len({j for j, _ in near} - {i}) == 5 and {cls[j] for j, _ in near} == {cls[i]}


def test_leaves_stay_small(spark):
    """Clusters of very different size, many more rows than a leaf: the largest leaf is a few times the mean."""
    r = np.random.default_rng(4)
    x = np.concatenate([r.normal(0, 0.01, (6000, 3)), r.normal(3, 1, (2000, 3))])
    points = spark.createDataFrame([(i, 0, v.tolist(), False, [i]) for i, v in enumerate(x)], "pid bigint, cls int, vec array<double>, is_query boolean, ids array<bigint>")
    members, _ = neighbor_tree._dealt(points, {0: 8000}, {0: 125}, 8, 42)
    sizes = [r["count"] for r in members.groupBy("leaf").count().collect()]
    assert sum(sizes) == 8000 and len(sizes) > 100 and max(sizes) < 8 * 64


def test_a_row_travels_once_to_the_leaves_of_a_bunch(spark):
    """Asking rows are sent by bunch, with the nearest of all leaves: not one copy of the vector per leaf."""
    x = np.random.default_rng(6).random((6000, 3))
    points = spark.createDataFrame([(i, 0, v.tolist(), i % 20 == 0, [i]) for i, v in enumerate(x)], "pid bigint, cls int, vec array<double>, is_query boolean, ids array<bigint>")
    members, asked = neighbor_tree._dealt(points, {0: 6000}, {0: 94}, 40, 42)
    bunch_of = {r.leaf: r.bunch for r in members.select("leaf", "bunch").distinct().collect()}
    seen = {}
    for r in asked.collect():
        assert r.bunch not in seen.setdefault(r.pid, {}) and {bunch_of[i] for i in r.leaves} == {r.bunch}
        seen[r.pid][r.bunch] = r.leaves
    assert seen.keys() == set(range(0, 6000, 20))
    assert sum(map(len, seen.values())) <= 300 * 20
    for i, by_bunch in seen.items():
        leaves = [j for some in by_bunch.values() for j in some]
        assert len(set(leaves)) == len(leaves) == 40
        far = np.linalg.norm(x[list(bunch_of.keys() - set(leaves))] - x[i], axis=1)
        assert np.linalg.norm(x[leaves] - x[i], axis=1).max() <= np.sort(far)[0] + 1e-9


def test_smote_can_search_exactly(spark):
    rng = random.Random(5)
    rows = [(i, "a" if i % 5 else "b", rng.random(), rng.random()) for i in range(200)]
    df = spark.createDataFrame(rows, "key int, y string, p double, q double")
    key = lambda out: sorted(tuple(map(str, r)) for r in out.collect())
    exact = smote(df, "y", ["p", "q"], "key", exact=True, pivots_per_class=4, block_rows=8)
    assert key(exact) == key(smote(df, "y", ["p", "q"], "key"))  # one leaf: the same neighbours


def test_many_classes(spark):
    rows = [(i, i % 260 if i < 2600 else 999, float(i % 7), float(i % 11)) for i in range(2700)]
    df = spark.createDataFrame(rows, "key int, y int, p double, q double")
    out = smote(df, "y", ["p", "q"], "key")
    assert {r["count"] for r in out.groupBy("y").count().collect()} == {100}
    assert out.where("not synthetic").count() == len(rows)
