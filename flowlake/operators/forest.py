"""A random forest of deep trees, grown from shuffled rows; trees stay on the executors' side.

Features are cut into at most ``BINS`` bins and a row becomes one byte per feature. Each tree draws every row a Poisson(1)
number of times. Nodes of more than ``LIMIT`` drawn rows are split by histograms summed over all tasks; the rows of any
smaller node travel to one task, which grows all of the tree below it. A tree ends as one row of bytes (its size is bounded
by two to the depth), and to score or explain rows, blocks of rows meet groups of trees in a shuffle. The driver sees bin
bounds, the splits of large nodes and class counts.

A split is the one of largest gain (Gini, weighted by class) among a random subset of the features, drawn for each node, of
the square root of their number; both sides keep ``LEAST`` draws or more. Of leaves that predict the same class two with one
parent become one.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlake.session import durable

BINS = 32
BOUND_ROWS = 10_000  # bounds of bins come from about as many rows; trees grow on all
LIMIT = 1 << 17  # draws of a node whose rows may meet in one task
LEAST = 2
BLOCK = 8192
CELLS = 1 << 20  # histogram cells held at once
RECORD = "shard int, kind int, number long, a binary, b binary"


# ---- rows as blocks of bytes ---------------------------------------------------------------------

def bounds_of(column: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Ascending cuts of a feature: midpoints of all its values where these are few, else of about equal shares."""
    values, counts = np.unique(column, return_counts=True)
    middle = (values[:-1] + values[1:]) / 2
    if len(middle) < bins:
        return middle
    at = np.searchsorted(np.cumsum(counts), np.arange(1, bins) * len(column) / bins)
    return middle[np.unique(np.minimum(at, len(middle) - 1))]


def packed(rows: DataFrame, bounds: Sequence[np.ndarray], size: int = BLOCK) -> DataFrame:
    """(number, a: the numbers of the first column, b: a byte per feature) of (long, features) in blocks of ``size`` rows."""
    cuts = list(bounds)

    def block(number: int, ids: list, parts: list) -> pa.RecordBatch:
        x = np.concatenate(parts)
        low = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)]).astype(np.uint8)
        return pa.RecordBatch.from_pydict({"number": [number], "a": [np.concatenate(ids).astype(np.int64).tobytes()], "b": [low.tobytes()]}, schema=kind)

    kind = pa.schema([("number", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, parts, held = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(cuts))
            for a in range(0, batch.num_rows, size):
                ids.append(batch.column(0)[a:a + size].to_numpy(zero_copy_only=False))
                parts.append(x[a:a + size])
                held += len(parts[-1])
                if held >= size:
                    yield block(number, ids, parts)
                    number, ids, parts, held = number + 1, [], [], 0
        if held:
            yield block(number, ids, parts)

    return rows.mapInArrow(work, "number long, a binary, b binary")


def unpacked(a: bytes, b: bytes) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(a, np.int64)
    return ids, np.frombuffer(b, np.uint8).reshape(len(ids), -1)


# ---- splits --------------------------------------------------------------------------------------

def mixed(v: np.ndarray) -> np.ndarray:
    v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return v ^ (v >> np.uint64(31))


def subset(seed: int, tree: int, nodes: np.ndarray, features: int) -> np.ndarray:
    """(node, feature numbers): the features a node may split on, the same wherever it is asked."""
    most = math.ceil(math.sqrt(features))
    start = mixed(np.array([(seed * 1_000_003 + tree) & 0xFFFFFFFF], np.uint64))
    keys = mixed(mixed(start + nodes.astype(np.uint64))[:, None] + np.arange(1, features + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.sort(np.argsort(keys, axis=1, kind="stable")[:, :most], axis=1)


def histograms(bins: np.ndarray, y: np.ndarray, draws: np.ndarray, at: np.ndarray, chosen: np.ndarray, classes: int) -> np.ndarray:
    """Draws per (node, chosen feature, bin, class)."""
    n, m = chosen.shape
    key = (at[:, None] * m + np.arange(m)) * BINS + np.take_along_axis(bins, chosen[at], axis=1)
    key = (key * classes + y[:, None]).ravel()
    return np.bincount(key, np.repeat(draws, m), n * m * BINS * classes).reshape(n, m, BINS, classes)


def gini(counts: np.ndarray) -> np.ndarray:
    return 1.0 - ((counts / np.maximum(counts.sum(axis=-1, keepdims=True), 1e-300)) ** 2).sum(axis=-1)


def best_splits(hist: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each node the place of its feature, the last bin of the left side, the gain (not above 0: none) and the left draws."""
    left = np.cumsum(hist, axis=2)
    whole = left[:, :1, -1:, :]
    right = whole - left
    wl, wr, w = left * weight, right * weight, whole * weight
    gain = gini(w) - (wl.sum(axis=-1) * gini(wl) + wr.sum(axis=-1) * gini(wr)) / np.maximum(w.sum(axis=-1), 1e-300)
    gain[(left.sum(axis=-1) < LEAST) | (right.sum(axis=-1) < LEAST)] = 0.0
    n, _, bins = gain.shape
    best = gain.reshape(n, -1).argmax(axis=1)
    slot, cut, rows = best // bins, best % bins, np.arange(n)
    return slot, cut, gain[rows, slot, cut], left[rows, slot, cut]


def grown(bins: np.ndarray, y: np.ndarray, draws: np.ndarray, tree: int, root: int, depth: int, seed: int, weight: np.ndarray) -> dict[str, np.ndarray]:
    """All nodes from ``root`` down (numbered 2 i and 2 i + 1 below i), grown level by level on the rows at hand."""
    classes, features = len(weight), bins.shape[1]
    counts = np.bincount(y, draws, classes)[None, :]
    ids, at, level, found = np.array([root], np.int64), np.zeros(len(y), np.int64), root.bit_length() - 1, []
    while len(ids):
        cut, feature, gain, left = np.zeros(len(ids), np.int64), np.full(len(ids), -1), np.zeros(len(ids)), np.zeros_like(counts)
        open_ = np.flatnonzero((gini(counts * weight) > 1e-15) & (level < depth))
        step = max(1, CELLS // (math.ceil(math.sqrt(features)) * BINS * classes))
        for a in range(0, len(open_), step):
            part = open_[a:a + step]
            first, last = np.searchsorted(at, [part[0], part[-1] + 1])  # rows lie in the order of nodes
            place = np.full(len(ids), -1)
            place[part] = np.arange(len(part))
            own = np.flatnonzero(place[at[first:last]] >= 0) + first
            chosen = subset(seed, tree, ids[part], features)
            slot, c, g, le = best_splits(histograms(bins[own], y[own], draws[own], place[at[own]], chosen, classes), weight)
            good = g > 0
            feature[part[good]], cut[part[good]], gain[part[good]], left[part[good]] = chosen[np.flatnonzero(good), slot[good]], c[good], g[good], le[good]
        found.append((ids, feature, cut, gain, counts))
        split = np.flatnonzero(feature >= 0)
        below = np.full(len(ids), -1)
        below[split] = np.arange(len(split))
        rows = np.flatnonzero(below[at] >= 0)
        parent = at[rows]
        child = 2 * below[parent] + (bins[rows, feature[parent]] > cut[parent])
        order = np.argsort(child, kind="stable")
        rows, at = rows[order], child[order]
        bins, y, draws = bins[rows], y[rows], draws[rows]
        ids = np.column_stack([2 * ids[split], 2 * ids[split] + 1]).ravel()
        counts = np.stack([left[split], counts[split] - left[split]], axis=1).reshape(-1, classes)
        level += 1
    return dict(zip(("id", "feature", "cut", "gain", "counts"), (np.concatenate(v) for v in zip(*found, strict=True)), strict=True))


def pruned(nodes: dict[str, np.ndarray], weight: np.ndarray) -> dict[str, np.ndarray]:
    """Nodes in the order of their numbers with the places of their children, after leaves of one parent and one answer are one."""
    order = np.argsort(nodes["id"], kind="stable")
    ids, feature, cut, gain, counts = (nodes[c][order] for c in ("id", "feature", "cut", "gain", "counts"))
    counts = counts * weight
    predicted, feature, keep = counts.argmax(axis=1), feature.copy(), np.ones(len(ids), bool)
    left = np.searchsorted(ids, 2 * ids)
    level = np.floor(np.log2(ids)).astype(int)
    for d in range(level.max(), -1, -1):
        at = np.flatnonzero((level == d) & (feature >= 0))
        a, b = left[at], left[at] + 1
        at = at[(feature[a] < 0) & (feature[b] < 0) & (predicted[a] == predicted[b])]
        feature[at], keep[left[at]], keep[left[at] + 1] = -1, False, False
    place = np.cumsum(keep) - 1
    inner = feature >= 0
    safe = np.minimum(left, len(ids) - 2) if len(ids) > 1 else left * 0
    lower = np.where(inner, place[safe], -1)
    total = counts.sum(axis=1)
    full = {
        "feature": feature, "cut": cut, "left": lower, "right": np.where(inner, lower + 1, -1), "cover": total,
        "answer": counts[:, 1] / np.maximum(total, 1e-300), "gain": np.where(inner, gain, 0.0),
    }
    return {c: v[keep] for c, v in full.items()}


FIELDS = {"feature": np.int16, "cut": np.int16, "left": np.int32, "right": np.int32, "cover": np.float64, "answer": np.float64, "gain": np.float64}


def to_bytes(tree: dict[str, np.ndarray]) -> bytes:
    return b"".join([np.int64(len(tree["cut"])).tobytes(), *[tree[c].astype(k).tobytes() for c, k in FIELDS.items()]])


def from_bytes(data: bytes) -> dict[str, np.ndarray]:
    n, at, out = int(np.frombuffer(data, np.int64, 1)[0]), 8, {}
    for c, k in FIELDS.items():
        out[c] = np.frombuffer(data, k, n, at)
        at += n * np.dtype(k).itemsize
    return out


# ---- growing -------------------------------------------------------------------------------------

def drawn(seed: int, tree: int, number: int, n: int) -> np.ndarray:
    """How often a tree draws each row of a block."""
    return np.random.default_rng([seed, tree, number]).poisson(1.0, n)


def routed(bins: np.ndarray, top: dict[int, tuple[int, int]]) -> np.ndarray:
    """The node each row reaches by the splits so far (node: feature and cut)."""
    at = np.ones(len(bins), np.int64)
    for node in sorted(top):
        here = np.flatnonzero(at == node)
        f, cut = top[node]
        at[here] = 2 * node + (bins[here, f] > cut)
    return at


def large_nodes(blocks: DataFrame, n: int, trees: int, depth: int, seed: int, weight: np.ndarray, features: int) -> list[dict[int, tuple]]:
    """Per tree the splits of its nodes of more than ``LIMIT`` draws: feature, cut, gain and draws per class."""
    tops: list[dict[int, tuple]] = [{} for _ in range(trees)]
    wide = [[1] if n > LIMIT else [] for _ in range(trees)]
    classes = len(weight)
    for _ in range(depth):
        if not any(wide):
            break
        open_, splits = [list(w) for w in wide], [{i: s[:2] for i, s in t.items()} for t in tops]

        def count(batches: Iterator[pa.RecordBatch], open_=open_, splits=splits) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                for k in range(batch.num_rows):
                    number, (y, bins) = batch.column(0)[k].as_py(), unpacked(batch.column(1)[k].as_py(), batch.column(2)[k].as_py())
                    for tree, nodes in enumerate(open_):
                        if nodes:
                            draws, at = drawn(seed, tree, number, len(y)), routed(bins, splits[tree])
                            for node in nodes:
                                own = np.flatnonzero((at == node) & (draws > 0))
                                chosen = subset(seed, tree, np.array([node]), features)
                                h = histograms(bins[own], y[own], draws[own], np.zeros(len(own), np.int64), chosen, classes)
                                sums[tree, node] = sums.get((tree, node), 0.0) + h
            keys = list(sums)
            yield pa.RecordBatch.from_pydict({"tree": pa.array([k[0] for k in keys], pa.int32()), "node": pa.array([k[1] for k in keys], pa.int64()), "h": pa.array([sums[k].tobytes() for k in keys], pa.binary())})

        def choose(key, pdf: pd.DataFrame) -> pd.DataFrame:
            hist = sum(np.frombuffer(h) for h in pdf["h"]).reshape(1, -1, BINS, classes)
            slot, cut, gain, left = best_splits(hist, weight)
            f = subset(seed, int(key[0]), np.array([key[1]]), features)[0, slot[0]]
            return pd.DataFrame([(int(key[0]), int(key[1]), int(f), int(cut[0]), float(gain[0]), left[0].tolist(), hist[0, 0].sum(axis=0).tolist())], columns=["tree", "node", "feature", "cut", "gain", "left_draws", "draws"])

        counted = blocks.mapInArrow(count, "tree int, node long, h binary").groupBy("tree", "node")
        rows = counted.applyInPandas(choose, "tree int, node long, feature int, cut int, gain double, left_draws array<double>, draws array<double>").collect()
        wide = [[] for _ in range(trees)]
        for r in rows:
            if r["gain"] > 0:
                tops[r["tree"]][r["node"]] = (r["feature"], r["cut"], r["gain"], tuple(r["draws"]))
                lower = sum(r["left_draws"]), sum(r["draws"]) - sum(r["left_draws"])
                wide[r["tree"]] += [c for c, size in zip((2 * r["node"], 2 * r["node"] + 1), lower, strict=True) if size > LIMIT and c.bit_length() <= depth]
    return tops


def fit(train: DataFrame, label: str, trees: int, depth: int, seed: int) -> Forest:
    """Class weights are balanced. ``train`` has the features in ``vec``; rows without a label take no part."""
    rows = durable(train.filter(F.col(label).isNotNull()).select(F.col(label).cast("long").alias("y"), vector_to_array("vec").alias("x")))
    per = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    n, classes = sum(per.values()), max([1, *per]) + 1
    if not n:
        raise ValueError("no row to learn from")
    weight = np.array([n / (len(per) * per[c]) if c in per else 0.0 for c in range(classes)])
    some = rows if n <= BOUND_ROWS else rows.filter(F.pmod(F.xxhash64("x", "y"), F.lit(n)) < BOUND_ROWS)
    some = np.stack(some.select("x").toPandas()["x"].to_numpy())
    features, bounds = some.shape[1], [bounds_of(some[:, j]) for j in range(some.shape[1])]
    blocks = durable(packed(rows, bounds))
    tops = large_nodes(blocks, n, trees, depth, seed, weight, features)
    splits = [{i: s[:2] for i, s in t.items()} for t in tops]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                number, (y, bins) = batch.column(0)[k].as_py(), unpacked(batch.column(1)[k].as_py(), batch.column(2)[k].as_py())
                for tree in range(trees):
                    draws = drawn(seed, tree, number, len(y))
                    at = np.where(draws > 0, routed(bins, splits[tree]), 0)
                    for node in np.unique(at[at > 0]):
                        own = at == node
                        yield pa.RecordBatch.from_pydict({
                            "tree": pa.array([tree], pa.int32()), "node": pa.array([node], pa.int64()), "number": pa.array([number], pa.int64()), "y": [y[own].astype(np.uint8).tobytes()], "draws": [draws[own].astype(np.uint8).tobytes()], "bins": [bins[own].tobytes()],
                        })

    def grow(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("number")
        y, draws, bins = (np.frombuffer(b"".join(pdf[c]), np.uint8) for c in ("y", "draws", "bins"))
        got = grown(bins.reshape(len(y), -1), y.astype(np.int64), draws.astype(float), int(key[0]), int(key[1]), depth, seed, weight)
        return pd.DataFrame({"tree": [int(key[0])], **{c: [v.ravel()] for c, v in got.items()}})

    def whole(key, pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(key[0])
        top = sorted(tops[tree].items())
        parts = {c: np.concatenate([*pdf[c], np.array([v for _, s in top for v in pick(_, s)], float)]) for c, pick in (
            ("id", lambda i, s: [i]), ("feature", lambda i, s: [s[0]]), ("cut", lambda i, s: [s[1]]), ("gain", lambda i, s: [s[2]]), ("counts", lambda i, s: s[3]))}
        parts = {c: v.astype(np.int64) if c in ("id", "feature", "cut") else v for c, v in parts.items()}
        return pd.DataFrame({"tree": [tree], "nodes": [to_bytes(pruned(parts | {"counts": parts["counts"].reshape(-1, classes)}, weight))]})

    tasks = max(4 * train.sparkSession.sparkContext.defaultParallelism, int(train.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = blocks.mapInArrow(deal, "tree int, node long, number long, y binary, draws binary, bins binary").repartition(tasks, "tree", "node")
    parts = dealt.groupBy("tree", "node").applyInPandas(grow, "tree int, id array<long>, feature array<long>, cut array<long>, gain array<double>, counts array<double>")
    return Forest(durable(parts.groupBy("tree").applyInPandas(whole, "tree int, nodes binary")), trees, bounds)


# ---- use -----------------------------------------------------------------------------------------

@dataclass
class Forest:
    """``nodes``: one row per tree, its nodes as bytes; cuts are numbers of bins, whose bounds are in ``bounds``."""

    nodes: DataFrame
    trees: int
    bounds: list[np.ndarray]

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802, as Spark's own models name it
        """Gain times weight per feature, each tree's shares and then the mean of trees."""
        features = len(self.bounds)

        def shares(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for data in pdf["nodes"]:
                    t = from_bytes(data)
                    inner = t["feature"] >= 0
                    total = np.bincount(t["feature"][inner], t["gain"][inner] * t["cover"][inner], features)
                    yield pd.DataFrame({"feature": np.arange(features), "share": total / total.sum() if total.sum() > 0 else total})

        got = self.nodes.mapInPandas(shares, "feature int, share double").groupBy("feature").agg(F.sum("share").alias("s")).collect()
        by = {r["feature"]: r["s"] for r in got}
        total = sum(by.values())
        return Vectors.dense([by.get(j, 0.0) / total if total > 0 else 0.0 for j in range(features)])

    def meet(self, rows: DataFrame, work: Callable, schema: str, size: int = BLOCK) -> DataFrame:
        """``work(trees, ids, bins)`` gives a batch for each block of (id, x) of ``rows`` and each group of trees."""
        shards = min(self.trees, 4 * rows.sparkSession.sparkContext.defaultParallelism)
        a = self.nodes.select((F.col("tree") % shards).cast("int").alias("shard"), F.lit(0).alias("kind"), F.col("tree").cast("long").alias("number"), F.col("nodes").alias("a"), F.lit(b"").alias("b"))
        b = packed(rows, self.bounds, size).select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "number", "a", "b")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shard, trees = -1, []
            for batch in batches:
                for k in range(batch.num_rows):
                    at, kind, number, first, second = (batch.column(c)[k].as_py() for c in range(5))
                    if at != shard:
                        shard, trees = at, []
                    if kind == 0:
                        trees.append(from_bytes(first))
                    else:
                        yield work(trees, number, *unpacked(first, second))

        return a.unionByName(b).repartitionById(shards, "shard").sortWithinPartitions("shard", "kind", "number").mapInArrow(run, schema)

    def score(self, df: DataFrame, out: str) -> DataFrame:
        """P(class = 1): the mean over trees of the share of class 1 in the row's leaf."""
        rows = durable(df.withColumn("_uid", F.monotonically_increasing_id()))

        def work(trees: list[dict], number: int, ids: np.ndarray, bins: np.ndarray) -> pa.RecordBatch:
            total, every = np.zeros(len(ids)), np.arange(len(ids))
            for t in trees:
                at = np.zeros(len(ids), np.int64)
                live = every if t["feature"][0] >= 0 else every[:0]
                while len(live):
                    node = at[live]
                    node = np.where(bins[live, t["feature"][node]] <= t["cut"][node], t["left"][node], t["right"][node])
                    at[live] = node
                    live = live[t["feature"][node] >= 0]
                total += t["answer"][at]
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], ["_of", "_s"])

        sums = self.meet(rows.select("_uid", vector_to_array("vec").alias("x")), work, "_of long, _s double").groupBy("_of").agg((F.sum("_s") / F.lit(float(self.trees))).alias(out))
        return rows.join(sums, rows["_uid"] == sums["_of"]).drop("_uid", "_of")
