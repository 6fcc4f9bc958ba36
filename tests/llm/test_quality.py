from __future__ import annotations

import random
import zlib

import numpy as np

from flowlake.llm import quality as Q

from .corpus import documents, empty, frame, words

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=400):
    rnd = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        good = i % 4 != 0
        text = " ".join(words(rnd, rnd.randint(20, 80)))
        rows.append((i, text if good else text.upper().replace(" ", "!! "), "en", "s", len(text)))
        labels.append((i, int(good), 0))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    scored = Q.classify(frame(spark, rows), spark.createDataFrame(labels, LABELS)).collect()
    held = [r for r in scored if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    truth = {d: q for d, q, _ in labels}
    assert len(scored) == len(rows) and len(held) > 40
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.98
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in scored)


def test_held_out_labels_teach_nothing(spark):
    rows, labels = corpus()
    flipped = [(d, 1 - q if zlib.crc32(str(d).encode()) % 5 == 0 else q, t) for d, q, t in labels]
    a, b = ({r["doc_id"]: r["score"] for r in Q.classify(frame(spark, rows), spark.createDataFrame(x, LABELS)).collect()} for x in (labels, flipped))
    assert a == b


def test_scores_are_sums_of_tables():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = Q.fit(x, y)
    assert (0, 1) in model.pairs and ((model.score(x) > 0.5) == y).mean() > 0.9
    one = x[:1]
    total = model.intercept + sum(t[np.searchsorted(e, v, side="right")] for e, t, v in zip(model.edges, model.tables, one[0], strict=True))
    bins = [np.searchsorted(e, v, side="right") for e, v in zip(model.coarse, one[0], strict=True)]
    total += sum(t[bins[a], bins[b]] for (a, b), t in model.pairs.items())
    assert abs(model.score(one)[0] - 1 / (1 + np.exp(-total))) < 1e-12


def test_cross_tree_finds_the_best_cut_by_hand():
    rng = np.random.default_rng(2)
    slope, curve = rng.normal(size=(4, 5)), rng.random((4, 5)) + 0.1
    gain, leaves = Q.cross_tree(slope, curve, 1.0)
    best = max(
        sum(slope[a, b].sum() ** 2 / (curve[a, b].sum() + 1.0) for a in (slice(0, i), slice(i, 4)) for b in (slice(0, j), slice(j, 5)))
        for i in range(1, 4) for j in range(1, 5)
    )
    assert abs(gain - best) < 1e-9 and leaves.shape == slope.shape


def test_awkward_rows_labels_and_tables(spark):
    odd = spark.createDataFrame([(1, None, 0), (None, 1, 0), (2, 7, 1), (3, 1, 1)], LABELS)
    assert len(Q.classify(frame(spark), odd).collect()) == len(documents())
    none = spark.createDataFrame([], LABELS)
    assert {r["score"] for r in Q.classify(frame(spark), none).collect()} == {0.5}
    assert Q.classify(empty(spark), odd).collect() == []


def test_accepted_keeps_columns(spark):
    rows, labels = corpus()
    df = frame(spark, rows)
    got = Q.accepted(df, spark.createDataFrame(labels, LABELS))
    assert got.columns == df.columns
    assert {r["doc_id"] for r in got.select("doc_id").collect()} == {d for d, q, _ in labels if q}
