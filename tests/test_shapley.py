"""Shapley values of trees against the definition: all subsets of features."""

from __future__ import annotations

import pickle
from itertools import combinations
from math import factorial
from types import SimpleNamespace

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from flowlake.operators import shapley as sh

FEATURES = 4


def grown(seed: int, depth: int) -> sh.Tree:
    """A random tree whose features repeat on paths."""
    rnd = np.random.default_rng(seed)
    rows: list[list[float]] = []

    def grow(cover: float, level: int) -> int:
        node = len(rows)
        rows.append([int(rnd.integers(FEATURES)), float(rnd.integers(0, 5)), -1, -1, cover, float(rnd.normal())])
        if level < depth and cover >= 2 and rnd.random() < 0.85:
            part = float(rnd.integers(1, int(cover)))
            rows[node][2] = grow(part, level + 1)
            rows[node][3] = grow(cover - part, level + 1)
        return node

    grow(64.0, 0)
    a = np.array(rows)
    return sh.Tree(a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4], a[:, 5], 0.5)


def value(tree: sh.Tree, x: np.ndarray, known: frozenset[int], node: int = 0) -> float:
    if tree.left[node] < 0:
        return tree.answer[node] * tree.scale
    f, left, right = tree.feature[node], tree.left[node], tree.right[node]
    if f in known:
        return value(tree, x, known, left if x[f] <= tree.cut[node] else right)
    return sum(tree.cover[c] * value(tree, x, known, c) for c in (left, right)) / tree.cover[node]


def by_definition(trees, x) -> np.ndarray:
    total = lambda known: sum(value(t, x, frozenset(known)) for t in trees)
    phi = np.zeros(FEATURES)
    for i in range(FEATURES):
        rest = [f for f in range(FEATURES) if f != i]
        for n in range(FEATURES):
            weight = factorial(n) * factorial(FEATURES - n - 1) / factorial(FEATURES)
            phi[i] += sum(weight * (total({*s, i}) - total(s)) for s in combinations(rest, n))
    return phi


@given(st.integers(0, 10_000), st.integers(0, 7))
@settings(max_examples=60, deadline=None)
def test_equal_to_the_definition(seed, depth):
    trees = [grown(seed, depth), grown(seed + 1, depth)]
    groups = sh.leaves_of(trees)
    x = np.random.default_rng(seed).integers(-1, 6, (5, FEATURES)).astype(float)
    phi = sh.shapley(x, groups, FEATURES)
    for row, got in zip(x, phi, strict=True):
        assert got == pytest.approx(by_definition(trees, row), abs=1e-10)
        answer = sum(value(t, row, frozenset(range(FEATURES))) for t in trees)
        assert sh.expected(groups) + got.sum() == pytest.approx(answer, abs=1e-10)


def test_a_deep_path_of_many_features():
    k = 30
    n = 2 * k + 1
    inner = np.arange(n) % 2 == 0
    left = np.where(inner & (np.arange(n) < n - 1), np.arange(n) + 1, -1)
    right = np.where(inner & (np.arange(n) < n - 1), np.arange(n) + 2, -1)
    cover = np.array([2.0 ** (k - i // 2) / (1 if i % 2 == 0 else 1) for i in range(n)])
    cover[1::2] = cover[0:-1:2] - cover[2::2]
    tree = sh.Tree(np.arange(n) // 2, np.zeros(n), left, right, cover, np.where(np.arange(n) == n - 1, 1.0, 0.0))
    x = np.ones((1, k))
    phi = sh.shapley(x, sh.leaves_of([tree]), k)
    assert phi[0] == pytest.approx(np.full(k, (1 - 2.0**-k) / k), abs=1e-12)  # all features are alike


@pytest.fixture(scope="module")
def rows(spark):
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(150, 3))
    data = [(i, *map(float, r), int(r[0] + r[1] * r[2] > 0)) for i, r in enumerate(x)]
    df = spark.createDataFrame(data, "id long, a double, b double, c double, y int")
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="vec").transform(df).cache()


@pytest.mark.parametrize("kind,more", [
    (DecisionTreeClassifier, {"maxDepth": 5}), (RandomForestClassifier, {"numTrees": 4, "maxDepth": 4, "seed": 1}), (GBTClassifier, {"maxIter": 4, "maxDepth": 3, "seed": 1}),
], ids=["tree", "forest", "boosted"])
def test_fitted_models_add_up(spark, rows, tmp_path, kind, more):
    learner = kind(featuresCol="vec", labelCol="y", **more)
    model = learner.fit(rows)
    phi = sh.attributions(rows, "id", ["a", "b", "c"], sh.fitted_trees(model, spark, str(tmp_path)))
    margin = vector_to_array("rawPrediction" if isinstance(learner, GBTClassifier) else "probability")[1]
    answers = {r["id"]: r["answer"] for r in model.transform(rows).select("id", margin.alias("answer")).collect()}
    got = {r["row_id"]: r["total"] for r in phi.groupBy("row_id").agg((F.sum("phi") + F.max("base")).alias("total")).collect()}
    assert len(got) == 150 and all(got[i] == pytest.approx(answers[i], abs=1e-9) for i in got)


def test_a_shared_folder_may_have_a_plain_path_on_a_cluster(spark, rows, tmp_path):
    cluster = SimpleNamespace(sparkContext=SimpleNamespace(master="spark://host:7077"), read=spark.read)
    model = DecisionTreeClassifier(featuresCol="vec", labelCol="y", maxDepth=2).fit(rows)
    assert len(sh.fitted_trees(model, cluster, str(tmp_path))) == 1


def test_broadcast_trees_need_no_class_of_this_package(spark, rows, tmp_path, monkeypatch):
    sent, ship = [], spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda value: sent.append(value) or ship(value))
    model = DecisionTreeClassifier(featuresCol="vec", labelCol="y", maxDepth=3).fit(rows)
    sh.attributions(rows, "id", ["a", "b", "c"], sh.fitted_trees(model, spark, str(tmp_path)))
    assert len(sent) == 1 and b"flowlake" not in pickle.dumps(sent[0])


def test_tasks_get_nodes_and_not_the_paths_of_all_leaves(spark, monkeypatch):
    sent, ship = [], spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda value: sent.append(value) or ship(value))
    k, n = 30, 61
    inner = (np.arange(n) % 2 == 0) & (np.arange(n) < n - 1)
    left, right = (np.where(inner, np.arange(n) + d, -1) for d in (1, 2))
    chain = sh.Tree(np.arange(n) // 2, np.zeros(n), left, right, np.ones(n), np.ones(n))
    names = [f"f{i}" for i in range(k)]
    sh.attributions(spark.createDataFrame([(1, *[0.5] * k)], ["id", *names]), "id", names, [chain])
    assert sum(np.asarray(a).nbytes for tree in sent[0] for a in tree) <= 64 * n


def test_a_side_without_training_weight_adds_nothing():
    tree = sh.Tree(np.array([0, 1, -1, -1, -1]), np.zeros(5), np.array([1, 2, -1, -1, -1]), np.array([4, 3, -1, -1, -1]), np.array([8.0, 8, 0, 8, 0]), np.array([0.0, 0, 5, 1, 9]))
    x = np.array([[-1.0, -1.0], [-1.0, 1.0], [1.0, 1.0]])
    phi = sh.shapley(x, sh.leaves_of([tree]), 2)
    for row, got in zip(x, phi, strict=True):
        known = lambda *s: value(tree, row, frozenset(s))  # noqa: B023, E731
        want = [(known(i) - known() + known(0, 1) - known(1 - i)) / 2 for i in (0, 1)]
        assert got == pytest.approx(want, abs=1e-10)


def test_top_features_and_importance(spark):
    values = spark.createDataFrame([(1, "a", 7.0, 0.5, 0.1), (1, "b", 8.0, -0.9, 0.1), (1, "c", 9.0, 0.5, 0.1), (2, "a", 1.0, 0.0, 0.1)], "row_id long, feature string, value double, phi double, base double")
    top = [tuple(r) for r in sh.top_features(values, 2).orderBy("row_id", "rank").collect()]
    assert top == [(1, 1, "b", 8.0, -0.9, "DECREASES_THREAT"), (1, 2, "a", 7.0, 0.5, "INCREASES_THREAT"), (2, 1, "a", 1.0, 0.0, "NEUTRAL")]
    assert [(r["feature"], r["rank"]) for r in sh.importance(values).orderBy("rank").collect()] == [("b", 1), ("c", 2), ("a", 3)]
