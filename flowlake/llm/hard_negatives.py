"""Operator 13: hard negatives by inner-product search with coordinate pruning.

Vectors are numbered by length, longest first, and cut into buckets of ``BUCKET`` rows; a bucket is one
row of the index and holds its vectors, their labels and ids, its greatest length, and for every
coordinate the rows in the order of that coordinate's share of the length. Anchors are packed in blocks
of ``BLOCK``. Every block of anchors meets every bucket once, as a join on the pair of their numbers.

Inside a pair an anchor asks for rows above a threshold. If even the longest vector of the bucket in the
anchor's own direction stays below it, the bucket is skipped. Otherwise the threshold is a least cosine,
and with it every coordinate of a row that can qualify lies in an interval around the anchor's own
coordinate. The intervals of the anchor's ``FOCUS`` largest coordinates are found in the sorted lists by
binary search, the rows in all of them are the candidates, and candidates are verified by their exact
integer product. Anchors whose intervals leave over ``DENSE`` of the bucket in every list are verified against it in one matrix product.

First the anchors' positives are searched, then for each positive the rows of other labels in its interval
of scores. The thresholds start from ``SEEDS`` rows chosen by hash (a bounded sample; it only lets the
search skip sooner and never changes a result) and rows of a bucket that miss its own first ``TOP`` are not sent on.

Components become ``floor(256 x)`` in whole numbers; products are exact in double precision while all lengths
in a pair multiply to less than 2^53, and taken in 64-bit integers otherwise.

Defined cases: rows with a null label, a null vector or a null or non-finite component take no part, nor
do rows whose squared length reaches 2^61 when scaled by 256, as their scores need not fit a long; a row is scored only
against anchors with as many components, so an empty vector only meets empty ones (score 0); a null id
is no anchor and comes first among ties; rows that repeat an id are rows of their own, and an anchor leaves out itself
only; a positive with a score below 0 has an empty interval and gives no row; an empty table gives an
empty result; further columns are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ordered_rank, small_batches, staged, table

TOP, ANCHOR_ONE_IN, RELABELLED_ONE_IN, LABELS, SCALE = 5, 100, 7, 10, 256
LEAST_PERCENT = 80
#: the least whole number of which a hundredfold reaches ``LEAST_PERCENT`` times the score, without a product that leaves a long
LEAST_SCORE = f"score div 100 * {LEAST_PERCENT} + (score % 100 * {LEAST_PERCENT} + 99) div 100"
BUCKET, BLOCK, SEEDS = 4096, 1024, 4096
FOCUS, DENSE = 4, 0.5
NO_ID = -(2**63)
LONGEST = 2**61
CELLS = 1 << 21  # products held at once
HIT = "anchor bigint, anchor_id bigint, slot int, row_id bigint, uid bigint, score bigint"


# ---- rows and index ------------------------------------------------------------------------------


def usable(vectors: DataFrame) -> DataFrame:
    """uid, vec_id, label (as the contract changes it), x (whole numbers), squared, dim, anchor."""
    x = F.transform(F.col("embedding"), lambda v: F.floor(F.lit(SCALE) * v.cast("double")))
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    size = F.aggregate("embedding", F.lit(0.0), lambda s, v: s + F.pow(F.lit(float(SCALE)) * v.cast("double"), F.lit(2.0)))
    moved = F.coalesce(F.col("vec_id") % RELABELLED_ONE_IN == 0, F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    rows = rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(fine).where(size < F.lit(float(LONGEST)))
    rows = rows.select(
        F.monotonically_increasing_id().alias("uid"), "vec_id", F.when(moved, (F.col("label") + 1) % LABELS).otherwise(F.col("label")).alias("label"), x.alias("x")
    )
    squared = F.aggregate("x", F.lit(0).cast("long"), lambda s, v: s + v * v)
    return rows.select(
        "*", squared.alias("squared"), F.size("x").alias("dim"), F.coalesce(F.col("vec_id") % ANCHOR_ONE_IN == 0, F.lit(False)).alias("anchor")
    )


def packed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of each ``keys`` (few by construction) as one row of arrays, longest vectors first."""
    member = F.struct((-F.col("squared")).alias("shorter"), "uid", "vec_id", "label", "x")
    rows = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(member)).alias("m"))
    return rows.select(
        *keys, F.col("m.uid").alias("uid"), F.transform("m.vec_id", lambda v: F.coalesce(v, F.lit(NO_ID))).alias("vec_id"), F.col("m.label").alias("label"), F.flatten("m.x").alias("x"),
    )


class Bucket:
    """Vectors of similar length and their sorted coordinate lists."""

    def __init__(self, uid, vec_id, label, x, dim: int):
        self.uid, self.vec_id, self.label = (np.asarray(v, np.int64) for v in (uid, vec_id, label))
        self.x = np.asarray(x, np.int64).reshape(len(self.uid), dim)
        self.real = self.x.astype(float)
        self.length = np.sqrt((self.real**2).sum(axis=1))
        self.longest = float(self.length.max(initial=0.0))
        self.lists: tuple[np.ndarray, np.ndarray] | None = None

    def sorted_lists(self) -> tuple[np.ndarray, np.ndarray]:
        """For each coordinate the rows in its order, and its values in that order, as shares of the length."""
        if self.lists is None:
            shares = self.real / np.maximum(self.length, 1.0)[:, None]
            order = np.argsort(shares, axis=0, kind="stable")
            self.lists = np.ascontiguousarray(order.T), np.ascontiguousarray(np.take_along_axis(shares, order, axis=0).T)
        return self.lists


def feasible(share: np.ndarray, cosine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The interval of a coordinate of any unit vector within the angle ``acos(cosine)`` of an anchor
    whose own coordinate is ``share``; a hair wider, for rounding (an angle near 0 is only known to 1e-8)."""
    own, reach = np.arccos(np.clip(share, -1, 1)), np.arccos(np.clip(cosine - 1e-12, -1, 1))
    return np.cos(np.minimum(own + reach, np.pi)) - 1e-7, np.cos(np.maximum(own - reach, 0.0)) + 1e-7


def candidates(bucket: Bucket, shares: np.ndarray, cosine: np.ndarray) -> list[np.ndarray | None]:
    """Per anchor the rows that all feasible intervals allow; None where they leave most of the bucket."""
    n = len(bucket.uid)
    found: list[np.ndarray | None] = [None] * len(shares)
    order, values = bucket.sorted_lists()
    focus = np.argsort(-np.abs(shares), axis=1, kind="stable")[:, :FOCUS]
    low, high = feasible(np.take_along_axis(shares, focus, axis=1), cosine[:, None])
    for i in np.flatnonzero(cosine > 0):
        ends = [(np.searchsorted(values[c], a, "left"), np.searchsorted(values[c], b, "right"), c) for c, a, b in zip(focus[i], low[i], high[i], strict=True)]
        ends.sort(key=lambda e: e[1] - e[0])
        if not ends or ends[0][1] - ends[0][0] > DENSE * n:
            continue
        rows = order[ends[0][2], ends[0][0]:ends[0][1]]
        for a, b, c in ends[1:]:
            if b - a < n:
                allowed = np.zeros(n, bool)
                allowed[order[c, a:b]] = True
                rows = rows[allowed[rows]]
        found[i] = rows
    return found


def products(anchors: Bucket, which: np.ndarray, bucket: Bucket, rows: np.ndarray | slice) -> np.ndarray:
    if anchors.longest * bucket.longest < 2.0**53 / 2:
        return (anchors.real[which] @ bucket.real[rows].T).astype(np.int64)
    return anchors.x[which] @ bucket.x[rows].T


def pairs_above(anchors: Bucket, bucket: Bucket, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor, row, score) that may reach ``least`` (whole numbers; the lowest one means no threshold), in
    parts: (anchors, rows, matrix of scores)."""
    everything, bound = np.arange(len(bucket.uid)), anchors.length * bucket.longest
    alive = np.flatnonzero(bound * (1 + 1e-12) >= least)
    if not len(alive) or not len(everything):
        return
    cosine = np.where(bound[alive] > 0, least[alive] / np.maximum(bound[alive], 1.0), -1.0)
    shares = anchors.real[alive] / np.maximum(anchors.length[alive], 1.0)[:, None]
    chosen = candidates(bucket, shares, cosine)
    whole = alive[[c is None for c in chosen]]
    step = max(1, CELLS // len(everything))
    for k in range(0, len(whole), step):
        yield whole[k:k + step], everything, products(anchors, whole[k:k + step], bucket, slice(None))
    for i, rows in zip(alive, chosen, strict=True):
        if rows is not None and len(rows):
            yield np.array([i]), rows, products(anchors, np.array([i]), bucket, rows)


def first_of(scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray, most: int = TOP) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the first ``most`` allowed cells of each row: higher scores first, then smaller ids."""
    masked = np.where(allowed, scores, np.iinfo(np.int64).min)
    if masked.shape[1] > most:
        last = -np.partition(-masked.astype(float), most - 1, axis=1)[:, most - 1:most]
        allowed = allowed & (masked.astype(float) >= last)
    i, j = np.nonzero(allowed)
    order = np.lexsort((ids[j], -scores[i, j], i))
    i, j = i[order], j[order]
    starts = np.r_[0, np.flatnonzero(np.diff(i)) + 1] if len(i) else np.zeros(0, int)
    rank = np.arange(len(i)) - np.repeat(starts, np.diff(np.r_[starts, len(i)]))
    return i[rank < most], j[rank < most]


def positives(anchors: Bucket, bucket: Bucket, least: np.ndarray) -> pd.DataFrame:
    """Each anchor's first rows of its own label in this bucket that reach ``least``."""
    parts = []
    for which, rows, scores in pairs_above(anchors, bucket, least):
        same = (anchors.label[which][:, None] == bucket.label[rows]) & (anchors.uid[which][:, None] != bucket.uid[rows]) & (scores >= least[which][:, None])
        i, j = first_of(scores, same, bucket.vec_id[rows])
        parts.append((which[i], np.zeros(len(i), int), rows[j], scores[i, j]))
    return hits(anchors, bucket, parts)


def negatives(anchors: Bucket, bucket: Bucket, low: np.ndarray, high: np.ndarray) -> pd.DataFrame:
    """Per anchor and slot (positive) the first rows of other labels with ``low <= score <= high``."""
    none = np.iinfo(np.int64).max
    wanted = np.where(low <= high, low, none).min(axis=1)
    parts = []
    for which, rows, scores in pairs_above(anchors, bucket, wanted):
        other = anchors.label[which][:, None] != bucket.label[rows]
        for slot in range(low.shape[1]):
            inside = other & (scores >= low[which, slot][:, None]) & (scores <= high[which, slot][:, None])
            i, j = first_of(scores, inside, bucket.vec_id[rows])
            parts.append((which[i], np.full(len(i), slot), rows[j], scores[i, j]))
    return hits(anchors, bucket, parts)


def hits(anchors: Bucket, bucket: Bucket, parts: list[tuple]) -> pd.DataFrame:
    a, slot, row, score = (np.concatenate([p[k] for p in parts] or [np.zeros(0, int)]).astype(np.int64) for k in range(4))
    return pd.DataFrame({
        "anchor": anchors.uid[a], "anchor_id": anchors.vec_id[a], "slot": slot.astype(np.int32), "row_id": bucket.vec_id[row], "uid": bucket.uid[row], "score": score,
    })


# ---- the search ----------------------------------------------------------------------------------


def met(anchors: DataFrame, buckets: DataFrame, blocks: int, bins: int) -> DataFrame:
    """Every block of anchors beside every bucket of as many components: an equal join on the pair's numbers.

    Copies of blocks weigh far more than their files tell, so both sides are shuffled; none may go through the driver."""
    a = anchors.withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    b = buckets.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    b = b.select("dim", "block", "bucket", *[F.col(c).alias(f"b_{c}") for c in ("uid", "vec_id", "label", "x")])
    return a.join(b.hint("merge"), ["dim", "block", "bucket"])


def search(pairs: DataFrame, find) -> DataFrame:
    """``find(anchors, bucket, array)`` on every pair, in Arrow batches of a few pairs."""
    small_batches(pairs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                array = lambda c, k=k, batch=batch: batch.column(c)[k].values.to_numpy(zero_copy_only=False)
                dim = batch.column("dim")[k].as_py()
                sides = [Bucket(*[array(p + c) for c in ("uid", "vec_id", "label", "x")], dim) for p in ("", "b_")]
                found = find(*sides, array)
                if len(found):
                    yield pa.RecordBatch.from_pandas(found, preserve_index=False)

    return pairs.mapInArrow(work, HIT)


def best(found: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "row_id", "uid")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= TOP)


def with_array(blocks: DataFrame, values: DataFrame, column: str, default: int) -> DataFrame:
    """Add to each block of anchors an array of ``TOP`` values per member, by (anchor, slot), ``default`` where there is none."""
    w = blocks.select("dim", "block", F.posexplode("uid").alias("place", "anchor"))
    slots = F.transform(F.sequence(F.lit(0), F.lit(TOP - 1)), lambda s: F.coalesce(F.try_element_at("by_slot", s), F.lit(default).cast("long")))
    by_anchor = values.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct(F.col("slot").cast("int"), F.col("value")))).alias("by_slot"))
    rows = w.join(by_anchor, "anchor", "left").withColumn("by_slot", F.coalesce("by_slot", F.create_map().cast("map<int,bigint>")))
    rows = rows.select("dim", "block", F.struct("place", slots.alias("v")).alias("p")).groupBy("dim", "block").agg(F.sort_array(F.collect_list("p")).alias("p"))
    return blocks.join(rows.select("dim", "block", F.flatten("p.v").alias(column)).hint("merge"), ["dim", "block"])


LOWEST, HIGHEST = -(2**62), 2**62


def mine(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(positives: anchor, anchor_id, slot, row_id, score; negatives: the same with rank, slot naming the positive)."""
    spark = vectors.sparkSession
    rows = staged(usable(vectors), "hard-rows")
    ranked = ordered_rank(rows.withColumn("shorter", -F.col("squared")), "dim", ["shorter", "vec_id"], "place", "hard-order")
    buckets = staged(packed(ranked.withColumn("bucket", F.expr(f"place div {BUCKET}")), ["dim", "bucket"]), "hard-buckets")
    anchors = rows.where("anchor")
    numbered = ordered_rank(anchors.withColumn("shorter", -F.col("squared")), "dim", ["shorter", "vec_id"], "place", "hard-anchors")
    blocks = staged(packed(numbered.withColumn("block", F.expr(f"place div {BLOCK}")), ["dim", "block"]), "hard-blocks")
    bins, n_blocks = ((t.agg(F.max(c)).first()[0] or 0) + 1 for t, c in ((buckets, "bucket"), (blocks, "block")))
    chosen = rows.orderBy(F.xxhash64("uid"), "uid").limit(SEEDS)  # only to start with high thresholds
    seeds = staged(packed(chosen.withColumn("bucket", F.lit(0).cast("long")), ["dim", "bucket"]), "hard-seeds")

    start = best(search(met(blocks, seeds, n_blocks, 1), lambda a, b, _: positives(a, b, np.full(len(a.uid), LOWEST))), ["anchor"])
    fifth = start.where(F.col("rank") == TOP).select("anchor", F.lit(0).alias("slot"), F.col("score").alias("value"))
    known = staged(with_array(blocks, fifth, "least", LOWEST), "hard-positive-thresholds")
    own = best(search(met(known, buckets, n_blocks, bins), lambda a, b, value: positives(a, b, value("least").reshape(-1, TOP)[:, 0])), ["anchor"])
    own = staged(own.select("anchor", "anchor_id", (F.col("rank") - 1).alias("slot"), "row_id", "uid", "score"), "hard-positives")

    high = own.select("anchor", "slot", F.col("score").alias("value"))
    low = own.where("score >= 0").select("anchor", "slot", F.expr(LEAST_SCORE).alias("value"))
    known = staged(with_array(with_array(blocks, high, "high", LOWEST), low, "low", HIGHEST), "hard-intervals")
    shaped = lambda value: (value("low").reshape(-1, TOP), value("high").reshape(-1, TOP))
    start = best(search(met(known, seeds, n_blocks, 1), lambda a, b, value: negatives(a, b, *shaped(value))), ["anchor", "slot"])
    raised = start.where(F.col("rank") == TOP).select("anchor", "slot", F.col("score").alias("more"))
    low = low.join(raised, ["anchor", "slot"], "left").select("anchor", "slot", F.greatest("value", "more").alias("value"))
    known = staged(with_array(known.drop("low"), low, "low", HIGHEST), "hard-thresholds")
    others = best(search(met(known, buckets, n_blocks, bins), lambda a, b, value: negatives(a, b, *shaped(value))), ["anchor", "slot"])
    return own, others


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, others = mine(table(spark, sf_dir, "embeddings"))
    own = own.select("anchor", "slot", F.col("row_id").alias("positive_id"), F.col("score").alias("positive_score"))
    pairs = others.join(own, ["anchor", "slot"])
    no_null = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias
    return pairs.select("anchor_id", no_null("positive_id")("positive_id"), "rank", no_null("row_id")("negative_id"), "positive_score", F.col("score").alias("negative_score"))


OP13_SQL = f"""
with rows as (select vec_id, case when vec_id % {RELABELLED_ONE_IN} = 0 then (label + 1) % {LABELS} else label end as label,
                     list_transform(embedding, lambda v: floor({SCALE} * v::double)) as x, row_number() over () as uid
              from embeddings where label is not null and embedding is not null
              and len(list_filter(embedding, lambda v: v is null or not isfinite(v))) = 0),
scored as (select a.uid as anchor, a.vec_id as anchor_id, r.uid, r.vec_id, a.label = r.label as same, cast(list_dot_product(a.x, r.x) as bigint) as score
           from rows a join rows r on a.vec_id % {ANCHOR_ONE_IN} = 0 and a.uid <> r.uid and len(a.x) = len(r.x)),
positives as (select * from scored where same qualify row_number() over (partition by anchor order by score desc, vec_id, uid) <= {TOP}),
mined as (select p.anchor_id, p.vec_id as positive_id, row_number() over (partition by p.anchor, p.uid order by n.score desc, n.vec_id, n.uid) as rank,
                 n.vec_id as negative_id, p.score as positive_score, n.score as negative_score
          from positives p join scored n on n.anchor = p.anchor and not n.same and {LEAST_PERCENT} * p.score <= 100 * n.score and n.score <= p.score)
select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score from mined where rank <= {TOP}
"""
