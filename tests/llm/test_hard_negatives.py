from __future__ import annotations

import math
import random

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flowlake.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(seed: int = 1, n: int = 260, dim: int = 8, labels: int = 4) -> list[tuple]:
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 1) for _ in range(dim)] for _ in range(labels)]
    rows = [(i, [c + rnd.gauss(0, 0.8) for c in centres[i % labels]], i % labels) for i in range(n)]
    rows += [(i, list(rows[i][1]), rows[i][2]) for i in (0, 3, 100, 100)]  # repeated rows, an anchor among them
    rows += [(n + i, list(rows[5][1]), (5 + i) % labels) for i in range(12)]  # ties between labels
    rows += [(300, [30.0 * x for x in rows[1][1]], 1), (400, [0.0] * dim, 2), (401, [0.0] * dim, 3), (402, [0.0] * dim, 2)]
    rows += [(500, None, 1), (501, [1.0] * (dim - 1) + [None], 1), (502, [float("nan")] * dim, 1), (503, [float("inf")] * dim, 1), (504, [1.0] * dim, None)]
    rows += [(None, list(rows[6][1]), 2), (None, list(rows[7][1]), 1), (600, [1.0, 2.0], 1), (601, [1.0, 2.1], 1), (602, [1.0, 1.9], 2), (700, [], 1), (701, [], 1), (702, [], 2)]
    rows += [(800, [3.0e38] * dim, 1)]  # its squared length leaves a long
    rnd.shuffle(rows)
    return rows


def brute_force(rows: list[tuple]) -> list[tuple]:
    found, usable = [], []
    for uid, (i, x, y) in enumerate(rows):
        if y is None or x is None or any(v is None or not math.isfinite(v) for v in x) or sum((256.0 * v) ** 2 for v in x) >= 2.0**61:
            continue
        if i is not None and i % 7 == 0:
            y = (y + 1) % 10
        usable.append((uid, i, [math.floor(256 * v) for v in map(float, np.float32(x))], y))
    key = lambda s: (-s[0], (s[1] is not None, s[1] or 0))
    for uid, i, x, y in usable:
        if i is None or i % 100:
            continue
        scored = sorted(((sum(a * b for a, b in zip(x, v, strict=True)), j, z) for u, j, v, z in usable if u != uid and len(v) == len(x)), key=key)
        for p, pid, _ in [s for s in scored if s[2] == y][:5]:
            inside = [s for s in scored if s[2] != y and 80 * p <= 100 * s[0] <= 100 * p][:5]
            found += [(i, pid, r + 1, s[1], p, s[0]) for r, s in enumerate(inside)]
    return sorted(found, key=repr)


def query(spark, rows, tmp_path) -> list[tuple]:
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit(c) for c in ("uid", "x", "bucket", "block", "score", "anchor", "dim")})
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    return sorted(map(tuple, hn.op13_hard_negatives(spark, str(tmp_path)).collect()), key=repr)


@pytest.mark.parametrize("bucket,block,seeds,dense", [(4096, 1024, 4096, 0.5), (40, 2, 30, 0.5), (40, 2, 30, 1.0)])
def test_equal_to_brute_force(spark, tmp_path, monkeypatch, bucket, block, seeds, dense):
    for name, value in (("BUCKET", bucket), ("BLOCK", block), ("SEEDS", seeds), ("DENSE", dense)):
        monkeypatch.setattr(hn, name, value)
    rows = vectors()
    want = brute_force(rows)
    assert query(spark, rows, tmp_path) == want and len(want) > 40


def test_sql_states_the_same_search(spark, tmp_path):
    rows = [r for r in vectors(2) if r[0] is not None and r[0] != 800]
    con = duckdb.connect()
    con.execute("create table embeddings (vec_id bigint, embedding float[], label int)")
    con.executemany("insert into embeddings values (?, ?, ?)", rows)
    assert sorted(con.execute(hn.OP13_SQL).fetchall(), key=repr) == brute_force(rows)


@given(st.integers(0, 10_000), st.integers(1, 6), st.floats(-0.2, 1.0))
@settings(max_examples=150, deadline=None)
def test_pruning_loses_no_pair(seed, dim, share):
    rnd = np.random.default_rng(seed)
    side = lambda n: hn.Bucket(np.arange(n), np.arange(n), rnd.integers(0, 3, n), rnd.integers(-300, 300, (n, dim)) * (rnd.random((n, dim)) < 0.7), dim)
    anchors, bucket = side(6), side(50)
    least = np.floor(share * anchors.length * bucket.longest).astype(np.int64)
    want = {(i, j) for i in range(6) for j in range(50) if int(anchors.x[i] @ bucket.x[j]) >= least[i]}
    got = {(int(w[a]), int(r[b])) for w, r, s in hn.pairs_above(anchors, bucket, least) for a, b in zip(*np.nonzero(s >= least[w][:, None]), strict=True)}
    assert got == want


def test_coordinates_prune_where_the_threshold_is_high():
    rnd = np.random.default_rng(3)
    x = rnd.integers(-300, 300, (500, 8))
    bucket = hn.Bucket(np.arange(500), np.arange(500), np.zeros(500), x, 8)
    anchors = hn.Bucket(np.arange(5), np.arange(5), np.zeros(5), x[:5], 8)
    shares = anchors.real / anchors.length[:, None]
    found = hn.candidates(bucket, shares, np.full(5, 0.95))
    assert all(c is not None and len(c) < 50 and i in c for i, c in enumerate(found))


def test_first_of_breaks_ties_by_id():
    scores, ids = np.array([[5, 5, 5, 9, 5, 5, 5, 5]]), np.array([7, 1, 6, 8, 3, 2, 5, 4])
    i, j = hn.first_of(scores, np.ones_like(scores, bool), ids)
    assert ids[j].tolist() == [8, 1, 2, 3, 4] and set(i) == {0}


def test_long_products_stay_exact(spark, tmp_path):
    rows = [(i, [2.0e6 + i, 1.9e6 - i, 3.0], i % 2) for i in range(1, 40)] + [(100, [2.0e6, 2.0e6, 1.0], 0)]
    assert query(spark, rows, tmp_path) == brute_force(rows) != []


def test_copies_of_blocks_do_not_go_through_the_driver(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, [1], [1], [0], [3])], "dim int, block long, uid array<long>, vec_id array<long>, label array<long>, x array<long>")
    rows.write.parquet(str(tmp_path / "blocks"))  # a file is small, whatever comes out of it
    blocks = spark.read.parquet(str(tmp_path / "blocks"))
    buckets = blocks.withColumnRenamed("block", "bucket")
    thresholds = spark.createDataFrame([(1, 0, 5)], "anchor long, slot int, value long")
    for df in (hn.met(blocks, buckets, 1, 3), hn.with_array(blocks, thresholds, "least", 0)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert [j for j in ("SortMergeJoin [dim", "BroadcastHashJoin [dim") if j in plan] == ["SortMergeJoin [dim"]
    assert hn.met(blocks, buckets, 1, 3).count() == 1


def test_empty_table(spark, tmp_path):
    assert query(spark, [], tmp_path) == []
