"""Profiles of raw tables: counts, nulls, constants, durations, duplicates, schema variation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlake.functions.numeric import is_inf, is_missing


def label_counts(df: DataFrame, label: str, top: int = 50) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label).limit(top)


def null_inf_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing and infinite cells per column: one aggregate, then turned to rows."""
    wide = df.agg(F.array(*[
        F.struct(
            F.lit(c).alias("column"), F.count_if(is_missing(c)).alias("missing"), F.count_if(is_inf(c)).alias("infinite")
        )
        for c in columns
    ]).alias("p"))
    return wide.select(F.explode("p").alias("p")).select("p.*")


def value_shares(df: DataFrame, columns: Sequence[str], near: float = 0.999) -> DataFrame:
    """Distinct values and share of the most frequent one per column; constant and near-constant flags.

    Cells are unpivoted and counted per (column, value), which combines before the shuffle."""
    cells = df.select([F.col(c).cast("string").alias(c) for c in columns]).unpivot([], list(columns), "column", "value")
    per = cells.groupBy("column", "value").agg(F.count("*").alias("n"))
    return per.groupBy("column").agg(
        F.count("value").alias("distinct_values"),
        (F.max("n") / F.sum("n").cast("double")).alias("top_share"),
    ).withColumns({
        "is_constant": F.col("distinct_values") <= 1, "is_near_constant": F.col("top_share") >= near,
    })


def duration_profile(df: DataFrame, duration: str) -> DataFrame:
    d = F.col(duration)
    return df.agg(
        F.count_if(d < 0).alias("negative"), F.count_if(d == 0).alias("zero"), F.count_if(is_missing(d)).alias("missing"),
        F.min(d).alias("min"), F.max(d).alias("max"),
    )


def duplicate_count(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    per = df.groupBy(*columns).agg(F.count("*").alias("n"))
    return per.agg(
        F.sum("n").alias("total_rows"), F.count("*").alias("distinct_rows"),
        F.sum(F.col("n") - 1).alias("duplicate_rows"),
        (F.sum(F.col("n") - 1) / F.sum("n").cast("double")).alias("duplicate_fraction"),
    )


def schema_variation(files: DataFrame) -> DataFrame:
    """``files`` has one row per (dataset, source_file, column_name). Column sets per file are hashed
    from sorted names; a file has at most some hundred columns."""
    sets = files.groupBy("dataset", "source_file").agg(
        F.sha2(F.concat_ws("\n", F.sort_array(F.collect_set("column_name"))), 256).alias("column_set")
    )
    per = sets.groupBy("dataset", "column_set").agg(F.count("*").alias("files"))
    return per.groupBy("dataset").agg(
        F.sum("files").alias("files"), F.count("*").alias("column_sets"),
        (F.count("*") == 1).alias("identical"),
    )


def ordered_identity(names: Sequence[str]):
    """Identity of an ordered feature list."""
    return F.sha2(F.concat_ws("\n", *[F.lit(n) for n in names]), 256)


def quota_sample(df: DataFrame, keys: Sequence[str], order: Sequence[str], quota: int) -> DataFrame:
    """First ``quota`` rows per key. The rank filter is applied inside each map task before the shuffle
    (window group limit), so a hot key sends ``quota`` rows per task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= quota).drop("_rn")
