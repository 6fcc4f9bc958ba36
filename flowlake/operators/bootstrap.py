"""Bootstrap intervals whose draws are functions of a hash, so that any engine repeats them.

Rows are dealt into ``BUCKETS`` groups by the MD5 of their id and summed per group, once and in one pass. A resample gives
each group a Poisson(1) weight, read off the MD5 of (seed, group, resample) by the inverse of the
distribution, and adds up the groups. The weights are the same for everything that is summed, so any number
of metrics, detectors or policies share their resamples. The spread of a mean or a ratio of sums is that of
weighting single rows, up to a relative error of sqrt(2 / BUCKETS), two parts in a hundred; the work of a
resample does not grow with the table. Where only counts are known, each count n becomes a
Poisson(n) draw by the same inverse (``count_draws``).
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate
from math import exp, factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlake.operators.metrics import confusion, score_counts
from flowlake.operators.ordered import attach_row

CELLS = ("tn", "fp", "fn", "tp")
BUCKETS, RESAMPLES, SEED = 4096, 1000, 42
#: P(X <= k) of a Poisson variable of mean 1; beyond the last one the rest of the distribution is below 2^-52
POISSON_ONE = list(accumulate(exp(-1.0) / factorial(k) for k in range(18)))
RANGES = 256


# ---- hashed draws ------------------------------------------------------------------------------------


def uniform(text: Column) -> Column:
    """52 bits of the MD5 of a text, as a number in [0, 1)."""
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(2**52)


def bucket_of(row_id: str) -> Column:
    return F.conv(F.substring(F.md5(F.col(row_id).cast("string")), 1, 8), 16, 10).cast("long") % BUCKETS


def poisson_one(u: Column) -> Column:
    return sum(((u >= c).cast("int") for c in POISSON_ONE[1:]), (u >= POISSON_ONE[0]).cast("int"))


def weights(spark: SparkSession, resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """(bucket, b, w): the weight of every group in every resample."""
    cell = spark.range(BUCKETS * resamples).select((F.col("id") % BUCKETS).alias("bucket"), F.expr(f"id div {BUCKETS}").alias("b"))
    u = uniform(F.concat_ws("|", F.lit(str(seed)), F.col("bucket").cast("string"), F.col("b").cast("string")))
    return cell.withColumn("u", u).withColumn("w", poisson_one(F.col("u"))).drop("u")  # the hash is a column of its own, taken once


def resampled(sums: DataFrame, columns: Sequence[str], resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """Per resample ``b`` the weighted sums of ``columns``. ``sums`` has a row per bucket, ``BUCKETS`` at most."""
    drawn = weights(sums.sparkSession, resamples, seed).join(F.broadcast(sums), "bucket")
    return drawn.groupBy("b").agg(*[F.sum(F.col("w") * F.col(c)).cast("double").alias(c) for c in columns])


def count_draws(cells: DataFrame, resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """(cell, b, w): for each ``cell`` (a text) with its count ``n`` a Poisson(n) draw per resample.

    The distribution of a count is tabulated within nine deviations, by the ratio of neighbouring terms;
    a draw is the first value whose cumulated probability exceeds the uniform number."""
    reach = 9.0 * F.sqrt(F.col("n").cast("double")) + 12.0
    ends = cells.select("n").distinct().select(
        "n", F.greatest(F.lit(0), F.floor(F.col("n") - reach)).cast("long").alias("lo"), F.ceil(F.col("n") + reach).cast("long").alias("hi"))
    table = ends.select("n", "lo", F.explode(F.sequence("lo", "hi")).alias("k"))
    upto = Window.partitionBy("n").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    ratio = F.when((F.col("k") == F.col("lo")) | (F.col("n") == 0), 0.0).otherwise(F.ln(F.col("n").cast("double") / F.col("k")))
    term = F.when((F.col("n") == 0) & (F.col("k") > 0), 0.0).otherwise(F.exp(F.sum(ratio).over(upto)))
    table = table.withColumn("term", term).withColumn("x", F.sum("term").over(upto) / F.sum("term").over(Window.partitionBy("n")))
    draws = cells.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(resamples - 1).cast("long"))))
    draws = draws.withColumn("x", uniform(F.concat_ws("|", F.lit(str(seed)), "cell", F.col("b").cast("string"))))
    both = table.select("n", "x", F.lit(0).alias("kind"), "k", "lo", F.lit(None).cast("string").alias("cell"), F.lit(None).cast("long").alias("b")).unionByName(
        draws.select("n", "x", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("k"), F.lit(None).cast("long").alias("lo"), "cell", "b"))
    line = Window.partitionBy("n").orderBy("x", "kind").rowsBetween(Window.unboundedPreceding, 0)
    least = F.min("lo").over(Window.partitionBy("n"))
    found = both.withColumn("w", F.coalesce(F.last("k", ignorenulls=True).over(line) + 1, least))
    return found.filter("kind = 1").select("cell", "b", "w")


# ---- intervals -----------------------------------------------------------------------------------


def interval(draws: DataFrame, keys: Sequence[str] = ("metric",), level: float = 0.95) -> DataFrame:
    """Percentile interval, mean and deviation of B draws per key (B is the number of resamples)."""
    a = (1.0 - level) / 2
    return draws.groupBy(*keys).agg(
        F.percentile("value", F.lit(a)).alias("ci_lower"), F.percentile("value", F.lit(1.0 - a)).alias("ci_upper"),
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("*").alias("resamples"),
    )


def _rates(tn: Column, fp: Column, fn: Column, tp: Column) -> dict[str, Column]:
    z = lambda a, b: F.coalesce(F.try_divide(a, F.nullif(b, F.lit(0.0))), F.lit(0.0))
    return {
        "accuracy": z(tp + tn, tn + fp + fn + tp), "precision": z(tp, tp + fp), "recall": z(tp, tp + fn),
        "f1": z(2 * tp, 2 * tp + fp + fn), "fpr": z(fp, fp + tn),
    }


def _long(per: DataFrame, values: dict[str, Column], keys: Sequence[str]) -> DataFrame:
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), v.alias("value")) for m, v in values.items()]))
    return per.select(*keys, rows.alias("m")).select(*keys, "m.*")


def _doubles(names: Sequence[str]) -> list[Column]:
    return [F.col(c).cast("double") for c in names]


def counts_ci(df: DataFrame, y: str = "y", pred: str = "pred", resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """Intervals of the threshold metrics from the confusion counts alone."""
    counts = confusion(df, y, pred)
    cells = counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("cell"), F.col(c).cast("long").alias("n")) for c in CELLS])).alias("c")).select("c.*")
    drawn = count_draws(cells, resamples, seed).groupBy("b").agg(*[F.sum(F.when(F.col("cell") == c, F.col("w")).otherwise(0)).cast("double").alias(c) for c in CELLS])
    return interval(_long(drawn, _rates(*_doubles(CELLS)), ["b"]))


def _cell_sums(df: DataFrame, y: str, pred: Column, row_id: str) -> DataFrame:
    hit = lambda yy, pp: F.count_if((F.col(y) == yy) & (pred == pp))
    return df.groupBy(bucket_of(row_id).alias("bucket")).agg(*[hit(yy, pp).alias(c) for c, (yy, pp) in zip(CELLS, ((0, 0), (0, 1), (1, 0), (1, 1)), strict=True)])


def metric_ci(df: DataFrame, y: str = "y", score: str = "score", threshold: float = 0.5, resamples: int = RESAMPLES, seed: int = SEED, row_id: str = "row_id") -> DataFrame:
    """Intervals of the threshold metrics, rows resampled by their ids."""
    sums = _cell_sums(df, y, (F.col(score) >= threshold).cast("int"), row_id)
    return interval(_long(resampled(sums, CELLS, resamples, seed), _rates(*_doubles(CELLS)), ["b"]))


# ---- ranking ---------------------------------------------------------------------------------------


def class_draws(counts: np.ndarray, sizes: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Draws (items, resamples) of ``sizes[b]`` rows with replacement from items of ``counts`` rows: every column adds up to its size."""
    left, rest = sizes.astype(np.int64).copy(), float(counts.sum())
    out = np.zeros((len(counts), len(sizes)), dtype=np.int64)
    for i, n in enumerate(counts.tolist()):
        if n and rest > 0:
            out[i] = rng.binomial(left, min(1.0, n / rest))
            left -= out[i]
            rest -= n
    return out


def auc_ci(df: DataFrame, y: str = "y", score: str = "score", resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """Interval of the exact AUC over resamples that keep the size of each class.

    Rows become counts per distinct score, and the scores ``RANGES`` ranges of about as many each. One small task
    first deals each class's rows out to the ranges, for all resamples; then each range deals its share out to
    its own scores, in its own task. Pairs across ranges follow from the first step, pairs inside a range from the second."""
    per = score_counts(df, y, score).filter("_score is not null")
    cuts = per.agg(F.percentile_approx("_score", [i / RANGES for i in range(1, RANGES)], 10_000)).first()[0] or []
    cuts = F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]).cast("array<double>")
    ranged = per.withColumn("range", F.size(F.filter(cuts, lambda c: c < F.col("_score"))))
    totals = ranged.groupBy("range").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))  # RANGES rows at most

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, rng = pdf.sort_values("range"), np.random.default_rng([seed, 0])
        pos, neg = (class_draws(pdf[c].to_numpy(), np.full(resamples, pdf[c].sum()), rng) for c in ("pos", "neg"))
        wins = (pos * (np.cumsum(neg, axis=0) - neg)).astype(float)
        return pd.DataFrame({"range": pdf["range"].to_numpy(), "pos": pos.tolist(), "neg": neg.tolist(), "wins": wins.tolist()})

    shares = totals.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(deal, "range int, pos array<long>, neg array<long>, wins array<double>")

    def inside(rows: pd.DataFrame, share: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(share):
            return pd.DataFrame({"b": np.zeros(0, np.int64), "wins": np.zeros(0)})
        rows, rng = rows.sort_values("_score"), np.random.default_rng([seed, 1, int(rows["range"].iloc[0])])
        pos, neg = (class_draws(rows[c].to_numpy(), np.asarray(share[c].iloc[0]), rng) for c in ("pos", "neg"))
        below = np.cumsum(neg, axis=0) - neg
        wins = (pos * (below + neg / 2.0)).sum(axis=0) + np.asarray(share["wins"].iloc[0])
        return pd.DataFrame({"b": np.arange(resamples), "wins": wins})

    parts = ranged.groupBy("range").cogroup(shares.groupBy("range")).applyInPandas(inside, "b long, wins double")
    pairs = totals.agg((F.sum("pos").cast("double") * F.sum("neg")).alias("pairs"))
    value = F.try_divide(F.col("wins"), F.nullif(F.col("pairs"), F.lit(0.0)))
    aucs = attach_row(parts.groupBy("b").agg(F.sum("wins").alias("wins")), pairs).select("b", value.alias("value")).filter("value is not null")
    return interval(aucs.withColumn("metric", F.lit("roc_auc")))


# ---- paired comparisons ---------------------------------------------------------------------------------


def paired_test(draws: DataFrame, keys: Sequence[str] = ("metric",)) -> DataFrame:
    """Interval of the differences, two-sided p-value and significance."""
    ci = draws.groupBy(*keys).agg(
        F.percentile("value", F.lit(0.025)).alias("ci_lower"), F.percentile("value", F.lit(0.975)).alias("ci_upper"),
        F.avg((F.col("value") <= 0).cast("double")).alias("_le"), F.avg((F.col("value") >= 0).cast("double")).alias("_ge"),
        F.count("*").alias("resamples"),
    )
    return ci.withColumns({
        "p_value": F.least(F.lit(1.0), 2.0 * F.least("_le", "_ge")),
        "significant": (F.col("ci_lower") > 0) | (F.col("ci_upper") < 0),
    }).drop("_le", "_ge")


def paired_comparison(df: DataFrame, y: str, score_a: str, score_b: str, threshold: float = 0.5, resamples: int = RESAMPLES, seed: int = SEED, row_id: str = "row_id") -> DataFrame:
    """Differences of the threshold metrics of two detectors, both judged on the same resamples."""
    p = lambda s: (F.col(s) >= threshold).cast("int")
    a, b = (_cell_sums(df, y, p(s), row_id).select("bucket", *[F.col(c).alias(f"{c}_{n}") for c in CELLS]) for s, n in ((score_a, "a"), (score_b, "b")))
    names = [f"{c}_{n}" for n in "ab" for c in CELLS]
    both = a.join(b, "bucket")
    ra, rb = (_rates(*_doubles([f"{c}_{n}" for c in CELLS])) for n in "ab")
    delta = {m: ra[m] - rb[m] for m in ra}
    point = _long(both.agg(*[F.sum(c).alias(c) for c in names]), delta, []).withColumnRenamed("value", "delta")
    return point.join(paired_test(_long(resampled(both, names, resamples, seed), delta, ["b"])), "metric")


def paired_differences(sums: DataFrame, pairs: dict[str, Column], count: str = "n", resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """(pair, delta, ci_lower, ci_upper, resamples, p_value, significant) of mean differences.

    ``sums`` has a row per bucket with the row count ``count`` and whatever columns the ``pairs`` are made of; a pair
    is the sum of differences over the bucket's rows. All pairs are resampled in one aggregate."""
    rows = sums.select("bucket", F.col(count).cast("double").alias("_n"), *[c.cast("double").alias(f"_d{i}") for i, c in enumerate(pairs.values())])
    names = ["_n", *[f"_d{i}" for i in range(len(pairs))]]
    values = {p: F.try_divide(F.col(f"_d{i}"), F.nullif(F.col("_n"), F.lit(0.0))) for i, p in enumerate(pairs)}
    point = _long(rows.agg(*[F.sum(c).alias(c) for c in names]), values, []).select(F.col("metric").alias("pair"), F.col("value").alias("delta"))
    draws = _long(resampled(rows, names, resamples, seed), values, ["b"]).withColumnRenamed("metric", "pair").filter("value is not null")
    return point.join(paired_test(draws, ["pair"]), "pair")


def paired_cost_comparison(log_a: DataFrame, log_b: DataFrame, cost: str = "total_cost", seq: str = "seq", resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """Resampled mean of the per-flow cost difference."""
    diff = log_a.select(seq, F.col(cost).alias("_a")).join(log_b.select(seq, F.col(cost).alias("_b")), seq)
    sums = diff.groupBy(bucket_of(seq).alias("bucket")).agg(F.count("*").alias("n"), F.sum(F.col("_a") - F.col("_b")).alias("_d"))
    return paired_differences(sums, {"mean_cost": F.col("_d")}, "n", resamples, seed).withColumnRenamed("pair", "metric")
