"""The forest by what must hold of it: plain splits, the same trees however nodes are shared out, walks down the trees."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from flowlake.operators import forest as fo
from flowlake.operators import ml, shapley

NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def data(spark):
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(400, 4))
    x[:, 3] = rnd.integers(0, 3, 400)
    y = (x[:, 0] + x[:, 1] * x[:, 3] + rnd.normal(size=400) > 0.3).astype(int)
    rows = [(i, *map(float, r), int(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    return ml.assemble(spark.createDataFrame(rows, "id long, a double, b double, c double, d double, y int").repartition(2, "id"), NAMES).cache()


def trees_of(model: fo.Forest) -> list[dict]:
    return [fo.from_bytes(r["nodes"]) for r in model.nodes.orderBy("tree").collect()]


def leaf(tree: dict, bins: np.ndarray) -> float:
    at = 0
    while tree["feature"][at] >= 0:
        at = tree["left" if bins[tree["feature"][at]] <= tree["cut"][at] else "right"][at]
    return tree["answer"][at]


def test_trees_are_rows_and_the_same_when_large_nodes_are_split_by_all_tasks(spark, data, monkeypatch):
    model = ml.random_forest(data, trees=5, depth=6)
    want = trees_of(model)
    assert model.nodes.count() == 5 and all(len(t["cut"]) > 5 for t in want)
    monkeypatch.setattr(fo, "LIMIT", 40)
    for got, tree in zip(trees_of(ml.random_forest(data, trees=5, depth=6)), want, strict=True):
        for c in fo.FIELDS:
            assert got[c] == pytest.approx(tree[c])


def test_scores_importances_and_attributions_follow_the_trees(spark, data):
    model = ml.random_forest(data, trees=6, depth=5)
    trees = trees_of(model)
    rows = data.orderBy("id").toPandas()
    bins = np.column_stack([np.searchsorted(c, rows[f], side="left") for f, c in zip(NAMES, model.bounds, strict=True)])
    want = np.array([np.mean([leaf(t, b) for t in trees]) for b in bins])
    got = ml.attack_score(model, data).orderBy("id").toPandas()
    assert got["id"].tolist() == list(range(400)) and got["score"].to_numpy() == pytest.approx(want)
    assert list(got.columns) == [*data.columns, "score"]
    shares = []
    for t in trees:
        assert t["cover"][0] == pytest.approx(sum(t["cover"][t["feature"] < 0]))
        by = np.bincount(t["feature"][t["feature"] >= 0], (t["gain"] * t["cover"])[t["feature"] >= 0], 4)
        shares.append(by / by.sum())
    per = [r["importance"] for r in ml.importances(model, NAMES, spark).collect()]
    assert per == pytest.approx(np.mean(shares, axis=0)) and min(per[:2]) > per[2]
    phi = shapley.attributions(data, "id", NAMES, shapley.fitted_trees(model, spark, ""))
    total = phi.groupBy("row_id").agg((F.sum("phi") + F.max("base")).alias("t")).orderBy("row_id").toPandas()["t"]
    assert phi.count() == 1600 and total.to_numpy() == pytest.approx(want, abs=1e-12)


def test_trees_and_their_values_do_not_pass_through_the_driver(spark, data, monkeypatch):
    model = ml.random_forest(data, trees=3, depth=4)
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda value: pytest.fail("broadcast by the driver"))
    phi = shapley.attributions(data, "id", NAMES, shapley.fitted_trees(model, spark, ""))
    assert phi.count() == 1600 and phi.select("base").distinct().count() == 1


def test_as_good_as_the_learner_of_spark(data):
    train, test = data.filter("id % 4 > 0"), data.filter("id % 4 = 0")
    theirs = RandomForestClassifier(featuresCol="vec", labelCol="y", numTrees=30, maxDepth=6, minInstancesPerNode=2, seed=1).fit(train)
    share = [ml.attack_score(m, test).filter("(score >= 0.5) = (y = 1)").count() / 100 for m in (ml.random_forest(train, trees=30, depth=6), theirs)]
    assert share[0] > 0.6 and abs(share[0] - share[1]) <= 0.08


def test_best_split_is_that_of_all_tries():
    rnd = np.random.default_rng(5)
    own, weight = rnd.poisson(0.4, (30, fo.BINS, 2)).astype(float), np.array([0.7, 1.6])
    hist = np.stack([np.stack([h, h[rnd.permutation(fo.BINS)], h[::-1]]) for h in own])  # the same draws along three features
    impurity = lambda c: 1 - ((c / c.sum()) ** 2).sum()
    for h, slot, cut, gain, left in zip(hist, *fo.best_splits(hist, weight), strict=True):
        tries = {}
        for f in range(3):
            for b in range(fo.BINS):
                a, z = h[f, :b + 1].sum(axis=0), h[f, b + 1:].sum(axis=0)
                if min(a.sum(), z.sum()) >= 2:
                    w = ((a + z) * weight).sum()
                    tries[f, b] = impurity((a + z) * weight) - sum((s * weight).sum() / w * impurity(s * weight) for s in (a, z))
        assert gain == pytest.approx(max(tries.values())) == pytest.approx(tries[slot, cut])
        assert left.tolist() == h[slot, :cut + 1].sum(axis=0).tolist()


def test_leaves_of_one_parent_and_one_answer_are_one():
    nodes = {"id": np.array([4, 1, 2, 3, 5]), "feature": np.array([-1, 0, 1, -1, -1]), "cut": np.array([0, 3, 4, 0, 0]), "gain": np.array([0, 0.2, 0.1, 0, 0]), "counts": np.array([[3.0, 1], [6, 5], [5, 1], [1, 4], [2, 0]])}
    got = fo.pruned(nodes, np.ones(2))
    assert got["feature"].tolist() == [0, -1, -1] and got["left"].tolist() == [1, -1, -1] and got["right"].tolist() == [2, -1, -1]
    assert got["answer"].tolist() == pytest.approx([5 / 11, 1 / 6, 4 / 5]) and got["gain"].tolist() == [0.2, 0, 0]


def test_bounds_take_all_middles_of_few_values_and_even_shares_of_many():
    assert fo.bounds_of(np.array([1.0, 1, 2, 4])).tolist() == [1.5, 3.0] and not len(fo.bounds_of(np.ones(5)))
    many = np.random.default_rng(1).permutation(3200).astype(float)
    cuts = fo.bounds_of(many)
    assert len(cuts) == 31 and np.bincount(np.searchsorted(cuts, many)).tolist() == pytest.approx([100] * 32, abs=2)


def test_rows_without_a_label_take_no_part_and_none_is_an_error(spark, data):
    holed = data.withColumn("y", F.when(F.col("id") % 2 == 0, F.col("y")))
    half = ml.random_forest(holed, trees=2, depth=3)
    assert 50 < trees_of(half)[0]["cover"][0] < 350
    with pytest.raises(ValueError, match="no row"):
        ml.random_forest(data.filter("id < 0"), trees=1)
