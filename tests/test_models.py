"""Learners by what must hold of them: plain fits of the same loss, frozen statistics, paths of trees."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlake.operators import ml

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data(spark):
    rnd = np.random.default_rng(6)
    x = rnd.normal(size=(240, 3)) * [1.0, 3.0, 0.5] + [0.0, 2.0, -1.0]
    y = (x @ [1.0, -0.4, 0.8] + rnd.normal(size=240) > 0.2).astype(int)
    rows = [(i, *map(float, r), int(t), f"d{i % 3}") for i, (r, t) in enumerate(zip(x, y, strict=True))]
    return x, y, spark.createDataFrame(rows, "id long, a double, b double, c double, y int, dataset string").cache()


def newton(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.0) -> np.ndarray:
    """Minimum of the weighted logistic loss plus half the ridge on the slopes; the intercept comes last."""
    z, penalty = np.c_[x, np.ones(len(x))], np.diag([ridge] * x.shape[1] + [0.0])
    beta = np.zeros(z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ beta))
        slope = z.T @ (weight * (p - y)) + penalty @ beta
        beta -= np.linalg.solve(z.T @ (z * (weight * p * (1 - p))[:, None]) + penalty, slope)
    return beta


def test_logistic_equals_a_plain_newton_fit(data):
    x, y, df = data
    model = ml.logistic(ml.assemble(df, NAMES))
    weight = len(y) / (2.0 * np.bincount(y))[y]
    assert np.r_[model.coefficients.toArray(), model.intercept] == pytest.approx(newton(x, y, weight), abs=2e-3)


def test_platt_equals_a_plain_ridge_fit(data):
    x, y, df = data
    scored = df.withColumn("score", 1 / (1 + F.exp(-F.col("a"))))
    slope, intercept = ml.platt(scored)
    want = newton((1 / (1 + np.exp(-x[:, 0])))[:, None], y, np.ones(len(y)), ridge=1.0)
    assert [slope, intercept] == pytest.approx(want, abs=2e-3)
    got = [r[0] for r in scored.select(ml.apply_platt(F.col("score"), slope, intercept)).collect()]
    assert 0 < min(got) and max(got) < 1


def test_scores_are_probabilities_and_statistics_are_frozen(data):
    x, _, df = data
    frozen = ml.freeze(ml.fit_statistics(df.filter("id < 100"), NAMES))
    part = x[:100]
    for k, name in enumerate(NAMES):
        assert frozen[name] == pytest.approx((np.median(part[:, k]), part[:, k].mean(), part[:, k].std()))
    scaled = ml.apply_statistics(df, NAMES, frozen).orderBy("id").select(*NAMES).toPandas().to_numpy()
    assert scaled == pytest.approx((x - part.mean(axis=0)) / part.std(axis=0))
    for fit in (lambda d: ml.random_forest(d, trees=5, depth=4), lambda d: ml.gradient_boosting(d, rounds=3, depth=2), lambda d: ml.decision_tree(d, depth=3)):
        got = [r["score"] for r in ml.attack_score(fit(ml.assemble(df, NAMES)), ml.assemble(df, NAMES)).select("score").collect()]
        assert 0 <= min(got) < 0.4 and 0.6 < max(got) <= 1


def test_rows_go_to_the_model_of_their_dataset(data):
    _, _, df = data
    models = {n: ml.logistic(ml.assemble(df.filter(F.col("dataset") == n), NAMES)) for n in ("d0", "d1")}
    got = {r["id"]: r["score"] for r in ml.routed_union(df, "dataset", models, NAMES, ["id"]).collect()}
    assert len(got) == 240 and all(got[i] is None for i in range(2, 240, 3))
    for n, model in models.items():
        own = {r["id"]: r["score"] for r in ml.attack_score(model, ml.assemble(df.filter(F.col("dataset") == n), NAMES)).collect()}
        assert own == {i: got[i] for i in own} and len(own) == 80


def test_isolation_scores_equal_walks_down_the_trees(data):
    x, _, df = data
    forest = ml.isolation_forest(df, NAMES, "id", trees=7, sample=64)
    nodes = {(r["tree"], r["node"]): r for r in forest.collect()}

    def depth(tree: int, row: np.ndarray) -> float:
        at = nodes[tree, 0]
        while at["feature"] >= 0:
            at = nodes[tree, at["left"] if row[at["feature"]] <= at["threshold"] else at["right"]]
        return at["depth_value"]

    got = {r["id"]: r["score"] for r in ml.isolation_scores(df, NAMES, forest, 64).collect()}
    harmonic = np.log(63.0) + 0.5772156649015329
    scale = 2 * harmonic - 2 * 63 / 64
    for i in range(0, 240, 7):
        mean = np.mean([depth(t, x[i]) for t in range(7)])
        assert got[i] == pytest.approx(1 / (1 + np.exp(10 * (0.5 - 2 ** (-mean / scale)))))
    far = max(range(240), key=lambda i: np.abs((x[i] - x.mean(axis=0)) / x.std(axis=0)).max())
    assert got[far] > np.median(list(got.values()))


def test_batch_scoring_counts_what_it_refuses(data):
    _, _, df = data
    frozen = ml.freeze(ml.fit_statistics(df, NAMES))
    model = ml.decision_tree(ml.assemble(ml.apply_statistics(df, NAMES, frozen), NAMES), depth=3)
    holed = df.withColumn("b", F.when(F.col("id") % 10 == 0, float("inf")).when(F.col("id") % 10 == 1, None).otherwise(F.col("b")))
    scored, violations = ml.batch_score(model, holed, NAMES, frozen, ["id"])
    got = {r["id"]: r["score"] for r in scored.collect()}
    assert len(got) == 240 and {i for i, s in got.items() if s is None} == {i for i in range(240) if i % 10 in (0, 1)}
    assert {r["feature"]: r["violations"] for r in violations.collect()} == {"a": 0, "b": 48, "c": 0}


def test_sweep_and_transfer_name_their_learners(data):
    _, _, df = data
    sweep = ml.rung_sweep(df.filter("id % 3 > 0"), df.filter("id % 3 = 0"), {"R1": ["a"], "R3": NAMES}, trees=4, depth=4, rounds=3, boosted_depth=2)
    rows = {(r["rung"], r["model"]): r for r in sweep.collect()}
    assert set(rows) == {(r, m) for r in ("R1", "R3") for m in ("forest", "boosted")} and all(r["n"] == 80 and r["accuracy"] > 0.5 for r in rows.values())
    got = {(r["model"], r["population"]): r["n"] for r in ml.transfer_eval(df.filter("id < 150"), df.filter("id >= 150"), NAMES, trees=4, depth=4).collect()}
    assert got == {(m, p): n for m in ("majority", "logistic", "tree", "forest") for p, n in (("source", 150), ("target", 90))}
