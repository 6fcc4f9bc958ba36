"""Hashed bootstrap draws: their distribution, their reproducibility, and the intervals they give."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlake.operators import bootstrap as bs


def uniform(text: str) -> float:
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16) / 2**52


def test_weights_are_the_inverse_of_the_distribution(spark, monkeypatch):
    monkeypatch.setattr(bs, "BUCKETS", 64)
    rows = bs.weights(spark, 50, 7).collect()
    for r in rows[::97]:
        assert r["w"] == sum(uniform(f"7|{r['bucket']}|{r['b']}") >= c for c in bs.POISSON_ONE)
    w = np.array([r["w"] for r in rows])
    assert len(w) == 3200 and w.mean() == pytest.approx(1, abs=0.06) and w.var() == pytest.approx(1, abs=0.12)


@pytest.mark.parametrize("n", [0, 1, 3, 40, 5_000, 2_000_000])
def test_count_draws_follow_poisson(spark, n):
    cells = spark.createDataFrame([("c", n)], "cell string, n long")
    w = np.array([r["w"] for r in bs.count_draws(cells, 2000).collect()])
    assert len(w) == 2000
    assert w.mean() == pytest.approx(n, abs=4 * np.sqrt(n / 2000) + 1e-9)
    assert w.var() == pytest.approx(n, rel=0.15) if n else not w.any()


def test_count_draws_equal_the_cumulated_probabilities(spark):
    from math import exp, factorial

    cells = spark.createDataFrame([("a", 4), ("b", 4), ("c", 9)], "cell string, n long")
    for r in bs.count_draws(cells, 40).collect():
        n, u, total, k = {"a": 4, "b": 4, "c": 9}[r["cell"]], uniform(f"42|{r['cell']}|{r['b']}"), 0.0, 0
        while True:
            total += exp(-n) * n**k / factorial(k)
            if total > u:
                break
            k += 1
        assert r["w"] == k


def scored(spark, n=4000):
    rnd = np.random.default_rng(1)
    y = rnd.integers(0, 2, n)
    score = np.round(np.clip(rnd.normal(0.4 + 0.2 * y, 0.2), 0, 1), 3)
    other = np.round(np.clip(score + rnd.normal(0, 0.1, n), 0, 1), 3)
    return y, score, other, spark.createDataFrame(list(zip(map(str, range(n)), y.tolist(), score.tolist(), other.tolist(), strict=True)), "row_id string, y int, score double, score_b double")


def test_intervals_agree_with_resampling_rows(spark):
    y, score, other, df = scored(spark)
    rnd = np.random.default_rng(3)
    hit, hit_b = (score >= 0.5) == y, (other >= 0.5) == y
    plain = np.array([[hit[i].mean(), hit[i].mean() - hit_b[i].mean()] for i in (rnd.integers(0, len(y), len(y)) for _ in range(1000))])
    got = {r["metric"]: r for r in bs.metric_ci(df, resamples=400).collect()}["accuracy"]
    counts = {r["metric"]: r for r in bs.counts_ci(df.withColumn("pred", (F.col("score") >= 0.5).cast("int")), resamples=400).collect()}["accuracy"]
    for found in (got, counts):
        assert found["mean"] == pytest.approx(hit.mean(), abs=0.002) and found["std"] == pytest.approx(plain[:, 0].std(), rel=0.15)
    pair = {r["metric"]: r for r in bs.paired_comparison(df, "y", "score", "score_b", resamples=400).collect()}["accuracy"]
    low, high = np.percentile(plain[:, 1], [2.5, 97.5])
    assert pair["delta"] == pytest.approx(hit.mean() - hit_b.mean()) and pair["ci_lower"] == pytest.approx(low, abs=0.004) and pair["ci_upper"] == pytest.approx(high, abs=0.004)


def test_class_draws_keep_every_size():
    rnd = np.random.default_rng(5)
    counts, sizes = np.array([0, 3, 500, 1, 0, 96]), np.array([600, 0, 17, 600])
    got = bs.class_draws(counts, sizes, rnd)
    assert got.sum(axis=0).tolist() == sizes.tolist() and not got[[0, 4]].any()
    many = bs.class_draws(counts, np.full(20_000, 600), rnd)
    assert many.mean(axis=1) == pytest.approx(counts, rel=0.05, abs=0.05)
    p = counts / 600
    assert many.var(axis=1) == pytest.approx(600 * p * (1 - p), rel=0.06)


def test_auc_interval_keeps_class_sizes_and_agrees_with_resampling_rows(spark, monkeypatch):
    y, score, _, df = scored(spark, 1500)
    monkeypatch.setattr(bs, "RANGES", 16)
    got = bs.auc_ci(df, resamples=300).first()
    rnd = np.random.default_rng(9)
    pos, neg = score[y == 1], score[y == 0]

    def auc() -> float:
        p, n = rnd.choice(pos, len(pos)), np.sort(rnd.choice(neg, len(neg)))
        left, right = np.searchsorted(n, p, "left"), np.searchsorted(n, p, "right")
        return (left + (right - left) / 2).sum() / len(p) / len(n)

    plain = np.array([auc() for _ in range(1000)])
    assert got["resamples"] == 300 and got["mean"] == pytest.approx(plain.mean(), abs=0.003) and got["std"] == pytest.approx(plain.std(), rel=0.15)
    assert bs.auc_ci(df.filter("y = 1"), resamples=20).collect() == []


def test_pairs_share_their_resamples(spark):
    rows = [(b, 10, float(b % 7), float(b % 7) + 1.0) for b in range(200)]
    sums = spark.createDataFrame(rows, "bucket long, n long, a double, b double")
    got = {r["pair"]: r for r in bs.paired_differences(sums, {"ab": F.col("a") - F.col("b"), "ba": F.col("b") - F.col("a"), "same": F.col("a") - F.col("a")}, resamples=200).collect()}
    assert got["ab"]["delta"] == pytest.approx(-0.1) and got["ab"]["ci_lower"] == pytest.approx(-got["ba"]["ci_upper"])
    assert got["ab"]["significant"] and got["ab"]["p_value"] == 0 and not got["same"]["significant"] and got["same"]["p_value"] == 1
