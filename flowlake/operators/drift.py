"""Distribution drift between two populations and parity of two feature pipelines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlake.functions.numeric import ratio
from flowlake.operators.ordered import exact_percentiles, running_totals


def _long(df: DataFrame, features: Sequence[str], population: str) -> DataFrame:
    return df.select(population, *[F.col(f).cast("double").alias(f) for f in features]).unpivot(
        [population], list(features), "feature", "value"
    ).filter(F.col("value").isNotNull() & ~F.isnan("value"))


def population_stats(df: DataFrame, features: Sequence[str], population: str) -> DataFrame:
    """Moments, range and exact quartiles per feature and population."""
    long = _long(df, features, population)
    keys = ["feature", population]
    base = long.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    q = exact_percentiles(long, keys, "value", {"q25": 0.25, "median": 0.5, "q75": 0.75})
    return base.join(q, keys)


def shifts(stats: DataFrame, population: str, source: str, target: str) -> DataFrame:
    """Mean, median and spread shift per feature (two rows per feature joined)."""
    side = lambda v, p: stats.filter(F.col(population) == v).select(
        "feature", *[F.col(c).alias(f"{p}_{c}") for c in ("mean", "median", "std")])
    return side(source, "s").join(side(target, "t"), "feature").select(
        "feature", (F.col("t_mean") - F.col("s_mean")).alias("mean_shift"),
        (F.col("t_median") - F.col("s_median")).alias("median_shift"),
        (F.col("t_std") / F.greatest("s_std", F.lit(1e-9))).alias("std_ratio"),
    )


def prevalence_shift(df: DataFrame, population: str, y: str, source: str, target: str) -> DataFrame:
    at = lambda v: F.avg(F.when(F.col(population) == v, F.col(y).cast("double")))
    return df.agg(at(source).alias("source_prevalence"), at(target).alias("target_prevalence")).withColumn(
        "prevalence_shift", F.col("target_prevalence") - F.col("source_prevalence"))


def ecdf_distance(df: DataFrame, features: Sequence[str], population: str, source: str, target: str) -> DataFrame:
    """Kolmogorov-Smirnov statistic with its asymptotic p-value, and Wasserstein distance, per feature,
    over all rows. Rows become counts per distinct value, then running sums over value ranges."""
    is_ = lambda v: F.col(population) == v
    long = _long(df.filter(F.col(population).isin(source, target)), features, population)
    per = long.groupBy("feature", "value").agg(F.count_if(is_(source)).alias("a"), F.count_if(is_(target)).alias("b"))
    run = running_totals(per, ["feature"], "value", ["a", "b"], next_value="_next")
    gap = F.abs(F.try_divide(F.col("cum_a").cast("double"), F.col("tot_a")) - F.try_divide(F.col("cum_b").cast("double"), F.col("tot_b")))
    got = run.groupBy("feature").agg(
        F.max(gap).alias("ks"), F.coalesce(F.sum(gap * (F.col("_next") - F.col("value"))), F.lit(0.0)).alias("wasserstein"),
        F.max("tot_a").alias("n_source"), F.max("tot_b").alias("n_target"),
    )
    en = F.sqrt(F.col("n_source").cast("double") * F.col("n_target") / (F.col("n_source") + F.col("n_target")))
    x = F.col("ks") * en
    series = sum((F.lit(2.0 * (-1) ** (k - 1)) * F.exp(-2.0 * k * k * x * x) for k in range(2, 12)), 2.0 * F.exp(-2.0 * x * x))
    p = F.when(x < 0.2, 1.0).otherwise(F.greatest(F.least(series, F.lit(1.0)), F.lit(0.0)))
    return got.withColumn("ks_pvalue", p)


def benign_ratio(df: DataFrame, features: Sequence[str], split: str, y: str) -> DataFrame:
    """Mean of the benign test rows over the mean of the benign train rows, per feature."""
    at = lambda f, s: F.avg(F.when((F.col(split) == s) & (F.col(y) == 0), F.col(f)))
    wide = df.agg(F.array(*[
        F.struct(F.lit(f).alias("feature"), at(f, "train").alias("train_mean"), at(f, "test").alias("test_mean"))
        for f in features
    ]).alias("p"))
    return wide.select(F.explode("p").alias("p")).select("p.*").withColumn("ratio", ratio(F.col("test_mean"), F.col("train_mean")))


def feature_parity(a: DataFrame, b: DataFrame, keys: Sequence[str], tolerances: dict[str, float]) -> DataFrame:
    """Largest and mean absolute error, largest relative error and pass flag per feature, plus the ids
    either side lacks."""
    feats = list(tolerances)
    left = a.select(*keys, *[F.col(f).alias(f"a_{f}") for f in feats], F.lit(1).alias("_a"))
    right = b.select(*keys, *[F.col(f).alias(f"b_{f}") for f in feats], F.lit(1).alias("_b"))
    both = left.join(right, list(keys), "full")
    rows = []
    for f, tol in tolerances.items():
        err = F.abs(F.col(f"a_{f}") - F.col(f"b_{f}"))
        rel = err / F.greatest(F.abs(F.col(f"a_{f}")), F.lit(1e-12))
        rows.append(F.struct(
            F.lit(f).alias("feature"), F.count(err).alias("compared"), F.max(err).alias("max_abs_error"),
            F.avg(err).alias("mean_abs_error"), F.max(rel).alias("max_rel_error"),
            F.coalesce(F.max(err) <= tol, F.lit(False)).alias("passed"),
            F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("unmatched"),
        ))
    return both.agg(F.array(*rows).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def perturb_scores(df: DataFrame, score: str, seed: int, sigma: float = 0.0, shift: float = 0.0, volume: float = 1.0, bps: str = "flow_bytes_per_s", row_id: str = "seq") -> DataFrame:
    """Gaussian jitter, shift and volume scaling. The noise is drawn from the row id, so a recomputed
    partition gives the same values."""
    part = lambda i: (F.conv(F.substring(F.md5(F.concat_ws("-", F.col(row_id).cast("string"), F.lit(f"{seed}-{i}"))), 1, 12), 16, 10).cast("double") + 0.5) / float(16**12)
    normal = F.sqrt(-2.0 * F.log(part(1))) * F.cos(F.lit(6.283185307179586) * part(2))
    return df.withColumns({
        score: F.greatest(F.least(F.col(score) + normal * sigma + shift, F.lit(1.0)), F.lit(0.0)),
        bps: F.col(bps) * volume,
    })

