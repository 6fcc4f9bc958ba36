"""Exact Shapley values of tree ensembles (path-dependent), on batches of rows.

The value of a set of features is the ensemble's mean answer when only they are known: at a split on a
known feature the row decides, at any other both sides count by the share of training weight they got.

A leaf contributes its answer times one factor per feature on its path. For a known feature the factor is
1 or 0 (does the row meet all conditions of the path on it?), for an unknown one it is the product of the
weight shares at its splits. With ``o`` and ``z`` for the two factors, the Shapley value of feature i at
that leaf is

    answer * (o_i - z_i) * integral from 0 to 1 of the product over j != i of (o_j t + z_j (1 - t)) dt,

a polynomial of degree k - 1 for k features on the path, so Gauss-Legendre quadrature with (k + 1) // 2
nodes is exact. Leaves of one subtree share the factors of their common path: a tree is walked once, all rows of a
block at each node. Going down, the product of the factors so far changes by one factor; coming up, the sum of
answer times product over the leaves below gives the node's feature its share.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlake.operators.forest import Forest, from_bytes
from flowlake.session import durable

ROWS = 2048  # walked at once; few enough for a core's cache
NEUTRAL = 1e-5  # fixed value: smaller attributions push neither way


@dataclass
class Tree:
    """Arrays by node: split feature, threshold (left when ``x <= cut``), children (-1 for leaves), training
    weight, and the answer of a leaf; ``scale`` is the tree's factor in the ensemble."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    cover: np.ndarray
    answer: np.ndarray
    scale: float = 1.0


@dataclass
class Walk:
    """A tree made ready. ``times``, ``gain``, ``ends`` and ``ending`` are tables by (side or none, node, state, quadrature
    node). The states: 0 the row missed the feature's conditions before, 1 it meets them so far and goes right, 2 left.
    ``times`` is what the product changes by towards a side and ``gain`` the weight of the leaves below it in the value of
    the node's feature; ``ends`` and ``ending`` are both sums over those children that are leaves."""

    tree: Tree
    seen: np.ndarray
    times: np.ndarray
    gain: np.ndarray
    ends: np.ndarray
    ending: np.ndarray
    expected: float


def walk_of(tree: Tree) -> Walk:
    width, n, inner = max(int(tree.feature.max(initial=-1)) + 1, 1), len(tree.left), tree.left >= 0
    shares = np.divide(tree.cover[[tree.left, tree.right]], tree.cover, out=np.zeros((2, n)), where=inner & (tree.cover > 0))
    before, seen, most = np.ones(n), np.zeros(n, bool), 0
    reach = np.ones(n)
    node, z, used = np.zeros(1, int), np.ones((1, width)), np.zeros((1, width), bool)
    while len(node):  # level by level, all nodes of a level at once
        most = max(most, int(used.sum(axis=1).max()))
        at = np.flatnonzero(inner[node])
        node, z, used, rows = node[at], z[at], used[at], np.arange(len(at))
        f = tree.feature[node]
        before[node], seen[node] = z[rows, f], used[rows, f]
        used[rows, f] = True
        sides = []
        for child, share in zip((tree.left[node], tree.right[node]), shares[:, node], strict=True):
            lower = z.copy()
            lower[rows, f] *= share
            reach[child] = reach[node] * share
            sides.append(lower)
        node, z, used = np.concatenate([tree.left[node], tree.right[node]]), np.concatenate(sides), np.concatenate([used, used])
    t, w = np.polynomial.legendre.leggauss(max(1, (most + 1) // 2))
    t, w = (t + 1) / 2, w / 2
    on = lambda share: t + share[..., None] * (1 - t)
    after = shares * before
    answer = tree.answer * tree.scale
    times, gain = np.empty((2, n, 3, len(t))), np.zeros((2, n, 3, len(t)))
    for side, (meets, misses) in enumerate(((2, 1), (1, 2))):
        times[side, :, 0] = shares[side][:, None]
        times[side, :, meets] = on(after[side]) / on(before)
        times[side, :, misses] = after[side][:, None] * (1 - t) / on(before)
        old = (1 - before)[:, None] / on(before)
        gain[side, :, meets] = w * ((1 - after[side])[:, None] / on(after[side]) - old)
        gain[side, :, misses] = w * (-1 / (1 - t) - old)
    last = np.where(inner, [~inner[tree.left], ~inner[tree.right]], False) * answer[[tree.left, tree.right]]
    ends = times * last[:, :, None, None]
    return Walk(tree, seen, times, gain, ends.sum(axis=0), (ends * gain).sum(axis=0), float((answer * reach)[~inner].sum()))


def leaves_of(trees: Sequence[Tree]) -> list[Walk]:
    """The trees made ready to be walked down to their leaves."""
    return [walk_of(t) for t in trees]


def expected(walks: Sequence[Walk]) -> float:
    """The ensemble's answer when nothing is known."""
    return float(sum(w.expected for w in walks))


def shapley(x: np.ndarray, walks: Sequence[Walk], features: int) -> np.ndarray:
    """Shapley values of each row (rows, features)."""
    phi, columns = np.zeros((features, len(x))), np.ascontiguousarray(x.T)
    for walk in walks:
        if walk.tree.left[0] >= 0:
            explained(walk, columns, phi)
    return np.ascontiguousarray(phi.T)


def explained(walk: Walk, columns: np.ndarray, phi: np.ndarray) -> None:
    """Add a tree's values to ``phi`` (feature, row)."""
    tree, met = walk.tree, {}
    feature, cut, left, right, seen = (v.tolist() for v in (tree.feature, tree.cut, tree.left, tree.right, walk.seen))
    times, gain, ends, ending = walk.times, walk.gain, walk.ends, walk.ending
    rows, ones = columns.shape[1], np.ones(times.shape[-1])

    def summed(product: np.ndarray, factor: np.ndarray) -> np.ndarray:
        return np.multiply(product, factor, out=factor) @ ones

    def visit(i: int, product: np.ndarray) -> np.ndarray:
        j, go = feature[i], columns[feature[i]] <= cut[i]
        so_far = met.get(j) if seen[i] else None
        state = go.astype(np.intp)
        state += 1
        if so_far is not None:
            state *= so_far
        below = None
        if left[left[i]] < 0 or left[right[i]] < 0:
            below = ends[i].take(state, axis=0)
            below *= product
            phi[j] += summed(product, ending[i].take(state, axis=0))
        for side, child in ((0, left[i]), (1, right[i])):
            if left[child] >= 0:
                way = go if side == 0 else ~go
                met[j] = way if so_far is None else way & so_far
                factor = times[side, i].take(state, axis=0)
                got = visit(child, np.multiply(product, factor, out=factor))
                phi[j] += summed(got, gain[side, i].take(state, axis=0))
                below = got if below is None else np.add(below, got, out=below)
        if so_far is not None:
            met[j] = so_far
        return below

    visit(0, np.ones((rows, len(ones))))


def fitted_trees(model, spark: SparkSession, folder: str) -> list[Tree] | Forest:
    """A ``Forest`` as it is, else the trees of a fitted MLlib tree, forest or boosted ensemble, read from the model's saved form. Their size is
    bounded by the model's parameters (trees times two to the depth). A classifier's answer is the
    probability of class 1, a boosted tree's its weighted output. ``folder`` must be storage that driver and
    executors share; a mounted one has a plain path."""
    if isinstance(model, Forest):
        return model
    path = f"{folder.rstrip('/')}/trees-{uuid.uuid4().hex}"
    model.write().overwrite().save(path)
    data = spark.read.parquet(f"{path}/data")
    single = "nodeData" not in data.columns
    data = data.select(F.lit(0).alias("treeID"), "*") if single else data.select("treeID", "nodeData.*")
    boosted = hasattr(model, "treeWeights") and hasattr(model, "evaluateEachIteration")
    stats = F.col("impurityStats")
    # a regression tree keeps count, sum and sum of squares, a classifier's the weight of each class
    cover = stats[0] if boosted else F.aggregate(stats, F.lit(0.0), lambda a, b: a + b)
    answer = F.col("prediction") if boosted else stats[1] / F.greatest(cover, F.lit(1e-300))
    table = data.select(
        "treeID", "id", "leftChild", "rightChild", F.col("split.featureIndex").alias("feature"), F.coalesce(F.try_element_at("split.leftCategoriesOrThreshold", F.lit(1)), F.lit(0.0)).alias("cut"),
        cover.cast("double").alias("cover"), answer.cast("double").alias("answer"),
    ).toArrow().to_pandas().sort_values(["treeID", "id"])  # numbers in columns, no object per node
    count = table["treeID"].nunique()
    scales = list(model.treeWeights) if boosted else [1.0 / max(count, 1)] * count
    return [
        Tree(*(g[c].to_numpy(kind) for c, kind in (("feature", int), ("cut", float), ("leftChild", int), ("rightChild", int), ("cover", float), ("answer", float))), float(scale))
        for scale, (_, g) in zip(scales, table.groupby("treeID"), strict=True)
    ]


def attributions(df: DataFrame, row_id: str, features: Sequence[str], trees: Sequence[Tree] | Forest) -> DataFrame:
    """Long table (row_id, feature, value, phi, base): ``base`` plus the sum of a row's phi is the ensemble's answer.

    The trees of a ``Forest`` meet the rows in a shuffle. Other trees are shipped to the tasks as nodes. A task makes
    one tree ready at a time."""
    feats = list(features)
    if isinstance(trees, Forest):
        return forest_attributions(df, row_id, feats, trees)
    base = sum(expected(leaves_of([t])) for t in trees)
    # plain arrays: a broadcast names its classes, and executors need not have this package
    shared = df.sparkSession.sparkContext.broadcast([(t.feature, t.cut, t.left, t.right, t.cover, t.answer, t.scale) for t in trees])

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x, ids = pdf[feats].to_numpy(float), pdf[row_id].to_numpy()
            phi = np.zeros(x.shape)
            for t in shared.value:
                walks = leaves_of([Tree(*t)])
                for a in range(0, len(x), ROWS):
                    phi[a:a + ROWS] += shapley(x[a:a + ROWS], walks, len(feats))
            for a in range(0, len(x), ROWS):
                part = x[a:a + ROWS]
                yield pd.DataFrame({"row_id": np.repeat(ids[a:a + ROWS], len(feats)), "feature": feats * len(part), "value": part.ravel(), "phi": phi[a:a + ROWS].ravel(), "base": base})

    kind = df.schema[row_id].dataType.simpleString()
    spread = df.select(row_id, *feats).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), row_id)  # a row costs far more than its bytes tell
    return spread.mapInPandas(explain, f"row_id {kind}, feature string, value double, phi double, base double")


def forest_attributions(df: DataFrame, row_id: str, feats: list[str], forest: Forest) -> DataFrame:
    scale, width = 1.0 / forest.trees, len(feats)

    def tree_of(t: dict[str, np.ndarray]) -> Tree:
        return Tree(t["feature"].astype(int), t["cut"], t["left"], t["right"], t["cover"], t["answer"], scale)

    def bases(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"base": [expected(leaves_of([tree_of(from_bytes(n))])) for n in pdf["nodes"]]})

    def work(trees: list[dict[str, np.ndarray]], number: int, ids: np.ndarray, bins: np.ndarray) -> pa.RecordBatch:
        phi = sum(shapley(bins, leaves_of([tree_of(t)]), width) for t in trees)
        return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([ids.tobytes()]), pa.array([phi.tobytes()])], ["number", "ids", "phi"])

    def add(key, pdf: pd.DataFrame) -> pd.DataFrame:
        phi = np.zeros(len(pdf["phi"].iloc[0]) // 8)
        for part in pdf["phi"]:
            phi += np.frombuffer(part)
        return pd.DataFrame({"_of": np.frombuffer(pdf["ids"].iloc[0], np.int64), "phis": list(phi.reshape(-1, width))})

    base = forest.nodes.mapInPandas(bases, "base double").agg(F.sum("base")).first()[0]
    rows = durable(df.select(F.monotonically_increasing_id().alias("_uid"), F.col(row_id).alias("row_id"), F.array(*[F.col(f).cast("double") for f in feats]).alias("x")))
    parts = forest.meet(rows.select("_uid", "x"), work, "number long, ids binary, phi binary", ROWS)
    phis = parts.groupBy("number").applyInPandas(add, "_of long, phis array<double>")
    both = rows.join(phis, rows["_uid"] == phis["_of"])
    names = F.array(*[F.lit(f) for f in feats])
    long = both.select("row_id", F.explode(F.arrays_zip(names.alias("feature"), F.col("x").alias("value"), F.col("phis").alias("phi"))).alias("c"))
    return long.select("row_id", "c.feature", "c.value", "c.phi", F.lit(base).alias("base"))


def importance(values: DataFrame) -> DataFrame:
    """Mean absolute value per feature and its rank."""
    per = values.groupBy("feature").agg(F.avg(F.abs("phi")).alias("mean_abs_phi"))
    return per.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean_abs_phi"), "feature")))  # one row per feature


def top_features(values: DataFrame, k: int = 5) -> DataFrame:
    """Each row's ``k`` features of largest absolute value, and which way they push."""
    key = F.struct((-F.abs("phi")).alias("size"), "feature", "value", "phi")
    ranked = values.groupBy("row_id").agg(F.slice(F.sort_array(F.collect_list(key)), 1, k).alias("top"))
    rows = ranked.select("row_id", F.posexplode("top").alias("pos", "t"))
    way = F.when(F.col("t.phi") > NEUTRAL, "INCREASES_THREAT").when(F.col("t.phi") < -NEUTRAL, "DECREASES_THREAT").otherwise("NEUTRAL")
    return rows.select("row_id", (F.col("pos") + 1).alias("rank"), "t.feature", "t.value", "t.phi", way.alias("direction"))
