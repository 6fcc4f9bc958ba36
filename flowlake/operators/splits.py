"""Train / validation / test splits and leakage checks."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlake.operators.ordered import attach_row, numbered, ranked_globally, spread_lookup

SPLITS = ("train", "validation", "test")


def order_hash(row_id: Column, seed: int) -> Column:
    return F.md5(F.concat_ws("-", row_id.cast("string"), F.lit(str(seed))))


def hash_chunk(h: Column, digits: int = 3) -> Column:
    """Leading digits of the hash: an even, order-preserving cut."""
    return F.conv(F.substring(h, 1, digits), 16, 10).cast("long")


def hash_ranked(df: DataFrame, keys: Sequence[str], row_id: str, seed: int, out: str = "rn") -> DataFrame:
    """Seeded random rank per key; spread over hash ranges, so a class of any size is fine."""
    h = df.withColumn("_h", order_hash(F.col(row_id), seed))
    return numbered(h, keys, ["_h", row_id], hash_chunk(F.col("_h")), out).drop("_h")


def stratified_split(
    df: DataFrame, label: str, row_id: str, seed: int = 42, train: float = 0.6, validation: float = 0.2
) -> DataFrame:
    """Exact shares per class in seeded hash order. A slice of hashes that no cut falls into lies in one split, so
    rows are ranked only in the slices with a cut (two of 4096 per class); the others stay where they are."""
    h = order_hash(F.col(row_id), seed)
    rows = df.filter(F.col(label).isNotNull()).withColumn("_h", h).withColumn("_chunk", hash_chunk(F.col("_h")))
    slices = rows.groupBy(label, "_chunk").agg(F.count("*").alias("_c"))
    up_to = Window.partitionBy(label).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, 0)
    slices = slices.withColumns({"_end": F.sum("_c").over(up_to), "_n": F.sum("_c").over(Window.partitionBy(label))})
    cuts = {"_cut1": F.bround(F.col("_n") * train), "_cut2": F.bround(F.col("_n") * (train + validation))}
    beyond = lambda value, cut: F.coalesce(F.min(F.when(F.col("_end") > F.col(cut), value)), F.lit(2**62))
    found = slices.withColumns(cuts).groupBy(label, "_cut1", "_cut2").agg(
        beyond(F.col("_chunk"), "_cut1").alias("_at1"), beyond(F.col("_end") - F.col("_c"), "_cut1").alias("_before1"),
        beyond(F.col("_chunk"), "_cut2").alias("_at2"), beyond(F.col("_end") - F.col("_c"), "_cut2").alias("_before2"),
    )
    placed = rows.join(F.broadcast(found), label)  # one row per class
    at, split = F.col("_chunk"), lambda first, second: F.when(first, "train").when(second, "validation").otherwise("test")
    cut = (at == F.col("_at1")) | (at == F.col("_at2"))
    whole = placed.filter(~cut).withColumn("split", split(at < F.col("_at1"), at < F.col("_at2")))
    before = F.when(at == F.col("_at1"), F.col("_before1")).otherwise(F.col("_before2"))
    rank = before + F.row_number().over(Window.partitionBy(label, "_chunk").orderBy("_h", row_id))
    ranked = placed.filter(cut).withColumn("_rn", rank)
    ranked = ranked.withColumn("split", split(F.col("_rn") <= F.col("_cut1"), F.col("_rn") <= F.col("_cut2")))
    first = [label] + [c for c in df.columns if c != label]
    return whole.select(*first, "split").unionByName(ranked.select(*first, "split"))


def grouped_split(
    df: DataFrame, group: str, row_id: str, seed: int = 42, train: float = 0.6, validation: float = 0.2
) -> DataFrame:
    """Whole groups go to one split; the cuts are at group counts."""
    groups = df.groupBy(group).agg(F.count("*").alias("_w"))
    ranked = attach_row(
        hash_ranked(groups.withColumn("_all", F.lit(0)), ["_all"], group, seed), groups.agg(F.count("*").alias("_n"))
    )
    cut1 = F.bround(F.col("_n") * train)
    cut2 = F.bround(F.col("_n") * (train + validation))
    table = ranked.select(
        group, "_w",
        F.when(F.col("rn") <= cut1, "train").when(F.col("rn") <= cut2, "validation").otherwise("test").alias("split"),
    )
    return spread_lookup(df, table, [group], "_w", [row_id]).drop("_w")


def temporal_cuts(df: DataFrame, ts: str, train: float = 0.6, validation: float = 0.2) -> DataFrame:
    """The two cut ranks: the target rank moved to the hour boundary whose rank is nearest (the later one
    on a tie), each on its own; NULL where no boundary around the target lies strictly inside the open
    range. Ranks at hour boundaries follow from the rows per hour, a small table.

    One row: cut_train_ts, cut_val_ts, cut_train, cut_val (rows before each cut), rank_train, rank_val
    (the targets), n."""
    hour = F.date_trunc("hour", F.col(ts))
    on_hour = (F.col(ts) == hour).cast("long")
    per = df.groupBy(hour.alias("h")).agg(F.count("*").alias("c"), F.sum(on_hour).alias("at"))
    w = Window.orderBy("h")  # one row per hour of the data's span
    run = w.rowsBetween(Window.unboundedPreceding, -1)
    one = F.expr("INTERVAL 1 HOUR")
    cum = per.select(
        "h", "c", "at", F.coalesce(F.sum("c").over(run), F.lit(0)).alias("before"),
        F.sum("c").over(Window.partitionBy()).alias("n"),
        F.when(F.lag("h").over(w) == F.col("h") - one, F.lag("c").over(w)).otherwise(0).alias("prev_c"),
    )

    def nearest(target: Column, low: Column, high: Column, name: str) -> DataFrame:
        home = cum.filter((F.col("before") <= target) & (target < F.col("before") + F.col("c")))
        option = lambda t, i: F.struct(t.alias("boundary"), i.cast("long").alias("idx"))
        here, b, c = F.col("h"), F.col("before"), F.col("c")
        options = F.array(
            option(here, b), option(here + one, b + c),
            F.when(target < b + F.col("at"), option(here - one, b - F.col("prev_c"))),
        )
        at = home.select("n", target.alias("target"), low.alias("low"), high.alias("high"),
                         F.explode(F.array_compact(options)).alias("o")).select("*", "o.*")
        best = F.struct(F.abs(F.col("idx") - F.col("target")), -F.col("idx"))
        fits = (F.col("idx") > F.col("low")) & (F.col("idx") < F.col("high"))
        return at.agg(
            F.max("target").alias(f"rank_{name}"), F.max("n").alias("n"),
            F.min_by("idx", F.when(fits, best)).alias(f"cut_{name}"),
            F.min_by("boundary", F.when(fits, best)).alias(f"cut_{name}_ts"),
        )

    n = F.col("n")
    t1, t2 = F.bround(n * train).cast("long"), F.bround(n * (train + validation)).cast("long")
    first = nearest(t1, F.lit(1), n - 2, "train").drop("n")
    cum = attach_row(cum, first)
    taken = F.coalesce("cut_train", "rank_train")
    second = nearest(t2, taken + 1, n - 1, "val")
    return attach_row(second, first)


def temporal_split(df: DataFrame, ts: str, row_id: str, train: float = 0.6, validation: float = 0.2) -> DataFrame:
    """Contiguous splits in time. Each cut is at its hour boundary, or at its exact rank in (time, row id)
    order where no boundary fits. Rows without a time cannot be placed and are refused."""
    if not df.filter(F.col(ts).isNull()).isEmpty():
        raise ValueError(f"{ts} is missing in some rows; repair or drop them first")
    ranked = ranked_globally(df, [ts, row_id])
    ranked = attach_row(ranked, temporal_cuts(df, ts, train, validation))
    before = lambda name: F.col("rn") <= F.coalesce(f"cut_{name}", f"rank_{name}")
    split = F.when(before("train"), "train").when(before("val"), "validation").otherwise("test")
    return ranked.withColumn("split", split).select(*df.columns, "split")


def repair_timestamps(df: DataFrame, ts: str, file: str, row_id: Sequence[str], floor: str = "2000-01-01") -> DataFrame:
    """Missing times and times before ``floor`` become the latest valid time of their file; NULL where
    the file has none. ``repaired`` marks them. A file of any size is one row of the lookup."""
    ok = F.col(ts).isNotNull() & (F.col(ts) >= F.lit(floor).cast("timestamp"))
    last = df.groupBy(file).agg(F.max(F.when(ok, F.col(ts))).alias("_last"), F.count("*").alias("_w"))
    return (
        spread_lookup(df, last, [file], "_w", row_id)
        .withColumn("repaired", ~F.coalesce(ok, F.lit(False)))
        .withColumn(ts, F.when(F.col("repaired"), F.col("_last")).otherwise(F.col(ts)))
        .drop("_last", "_w")
    )


def parse_time(text: Column) -> Column:
    """Day-first text, ISO text, or NULL."""
    return F.coalesce(
        F.try_to_timestamp(text, F.lit("dd/MM/yyyy HH:mm:ss")), F.try_to_timestamp(text)
    )


def split_overlap(df: DataFrame, keys: Sequence[str], split: str = "split") -> DataFrame:
    """Distinct keys shared by each pair of splits, and the rows they cover. Keys are grouped once with
    one count per split; no pair of rows is ever formed."""
    counts = [F.count_if(F.col(split) == s).alias(f"_{s}") for s in SPLITS]
    per = df.groupBy(*keys).agg(*counts)
    pairs = list(combinations(SPLITS, 2))
    aggs = []
    for a, b in pairs:
        both = (F.col(f"_{a}") > 0) & (F.col(f"_{b}") > 0)
        rows = F.coalesce(F.sum(F.when(both, F.col(f"_{a}") + F.col(f"_{b}"))), F.lit(0))
        aggs.append(F.struct(
            F.lit(a).alias("split_a"), F.lit(b).alias("split_b"), F.count_if(both).alias("shared_keys"),
            rows.alias("shared_rows"),
        ))
    return per.agg(F.array(*aggs).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def leak_rows(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return split_overlap(df, features)


def leak_near(df: DataFrame, features: Sequence[str], digits: int = 6) -> DataFrame:
    """Shared rows after rounding, over all rows."""
    return split_overlap(df.select("split", *[F.round(F.col(f), digits).alias(f) for f in features]), features)


def leak_column(df: DataFrame, column: str) -> DataFrame | None:
    """Shared groups or addresses; ``None`` (not performed) where the column is absent."""
    return split_overlap(df, [column]) if column in df.columns else None


def leak_time(df: DataFrame, ts: str) -> DataFrame:
    """Pairwise overlap of the time ranges of the splits (three rows)."""
    aggs = [
        F.struct(F.min(F.when(F.col("split") == s, F.col(ts))).alias("lo"), F.max(F.when(F.col("split") == s, F.col(ts))).alias("hi")).alias(s)
        for s in SPLITS
    ]
    span = df.agg(*aggs)
    rows = [
        F.struct(
            F.lit(a).alias("split_a"), F.lit(b).alias("split_b"),
            ((F.col(a)["hi"] >= F.col(b)["lo"]) & (F.col(b)["hi"] >= F.col(a)["lo"])).alias("overlaps"),
        )
        for a, b in combinations(SPLITS, 2)
    ]
    return span.select(F.explode(F.array(*rows)).alias("p")).select("p.*")


def leak_sequences(windows: DataFrame) -> DataFrame:
    """Sequence windows that mix splits. ``windows`` carries the lowest and highest split of each."""
    return windows.agg(
        F.count("*").alias("windows"), F.count_if(F.col("split_lo") != F.col("split_hi")).alias("crossing")
    )


def leak_report(
    df: DataFrame, features: Sequence[str], group: str | None, ip: str | None, ts: str | None, windows: DataFrame | None = None
) -> DataFrame:
    """One row per check with what it found and its status, one with the number of failed checks and the
    overall status, and one with the size of each split. ``windows`` are sequence windows, see
    ``leak_sequences``."""
    def line(name: str, found: DataFrame | None) -> DataFrame:
        if found is None:
            return df.sparkSession.range(1).select(
                F.lit(name).alias("check"), F.lit(None).cast("long").alias("found"), F.lit("NOT_PERFORMED").alias("status"))
        n = F.sum("n").cast("long")
        return found.agg(n.alias("found")).select(
            F.lit(name).alias("check"), "found", F.when(F.col("found") > 0, "FAILED").otherwise("PASSED").alias("status"))

    shared = lambda d: d.select(F.col("shared_keys").alias("n"))
    column = lambda c: shared(leak_column(df, c)) if c and c in df.columns else None
    checks = [
        line("exact_rows", shared(leak_rows(df, features))),
        line("rounded_rows", shared(leak_near(df, features))),
        line("groups", column(group)), line("source_ips", column(ip)),
        line("time_order", leak_time(df, ts).select(F.col("overlaps").cast("long").alias("n")) if ts and ts in df.columns else None),
        line("sequences", None if windows is None else leak_sequences(windows).select(F.col("crossing").alias("n"))),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    failed = out.agg(F.count_if(F.col("status") == "FAILED").alias("found"))
    overall = failed.select(F.lit("overall").alias("check"), "found", F.when(F.col("found") > 0, "FAILED").otherwise("PASSED").alias("status"))
    sizes = df.groupBy(F.concat(F.lit("size_"), F.col("split")).alias("check")).agg(F.count("*").alias("found")).withColumn("status", F.lit("INFO"))
    return out.unionByName(overall).unionByName(sizes)


def stratified_subsample(df: DataFrame, label: str, row_id: str, n: int, seed: int = 42) -> DataFrame:
    """About n rows with the class mix kept, at least one per class."""
    sizes = df.groupBy(label).agg(F.count("*").alias("_c"))
    sizes = attach_row(sizes, sizes.agg(F.sum("_c").alias("_n")))
    take = F.greatest(F.bround(F.col("_c") * (F.lit(float(n)) / F.col("_n"))), F.lit(1.0))
    ranked = hash_ranked(df, [label], row_id, seed)
    return (
        ranked.join(sizes.select(label, take.alias("_take")), label)
        .filter(F.col("rn") <= F.col("_take")).select(*df.columns)
    )


def _first_by_hash(df: DataFrame, label: str, row_id: str, quota: int, seed: int) -> DataFrame:
    """The ``quota`` rows of least seeded hash per class, by exact rank over hash ranges."""
    return hash_ranked(df, [label], row_id, seed).filter(F.col("rn") <= quota).select(*df.columns)


def balanced_sample(df: DataFrame, y: str, row_id: str, size: int, seed: int = 42) -> DataFrame:
    """Half benign, half attack, the first of each in seeded order."""
    return _first_by_hash(df.filter(F.col(y).isin(0, 1)), y, row_id, size // 2, seed)


def family_sample(df: DataFrame, family: str, name: str, row_id: str, size: int, seed: int = 42) -> DataFrame:
    """The first rows of one family in seeded order."""
    return _first_by_hash(df.filter(F.col(family) == name), family, row_id, size, seed)


def policy_partition(df: DataFrame, label: str, row_id: str, seed: int = 42) -> DataFrame:
    """Validation rows into policy-train (60 %) and policy-validation (40 %)."""
    held = df.filter(F.col("split") == "validation").drop("split")
    return stratified_split(held, label, row_id, seed, 0.6, 0.4).withColumn(
        "split", F.when(F.col("split") == "train", "policy_train").otherwise("policy_validation")
    )


def partition_manifest(parts: DataFrame, row_id: str, label: str) -> DataFrame:
    """Rows and attack rows per part, with a content hash: the order-free sum of row hashes, so no part
    is gathered in one place."""
    key = F.conv(F.substring(F.md5(F.concat_ws("|", row_id, "split")), 1, 12), 16, 10).cast("decimal(20,0)")
    return parts.groupBy("split").agg(
        F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("attack"),
        F.sum(key).cast("decimal(38,0)").alias("_sum"),
    ).select(
        "split", "n", "attack",
        F.sha2(F.concat_ws(":", "split", F.col("n").cast("string"), F.col("_sum").cast("string")), 256).alias("manifest_hash"),
    )


def weighted_sample(df: DataFrame, priority: str, row_id: str, n: int, seed: int = 42, alpha: float = 0.6, beta: float = 0.4) -> DataFrame:
    """n rows with probability proportional to priority^alpha (exponential race), with importance
    weights (N P)^-beta scaled to at most 1."""
    p = F.pow(F.col(priority), alpha)
    u = (F.conv(F.substring(order_hash(F.col(row_id), seed), 1, 12), 16, 10).cast("double") + 1) / float(16**12 + 1)
    total = df.agg(F.sum(p).alias("_total"), F.count("*").alias("_n"))
    picked = df.orderBy(-F.log(u) / p, row_id).limit(n)
    weight = F.pow(F.col("_n") * p / F.col("_total"), -beta)
    w = attach_row(picked, total).withColumn("_w", weight).drop("_total", "_n")
    return attach_row(w, w.agg(F.max("_w").alias("_max"))).withColumn("weight", F.col("_w") / F.col("_max")).drop("_w", "_max")
