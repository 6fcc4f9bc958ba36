"""Security events: filters, pages, breakdowns, timelines and explorer views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlake.operators.metrics import outcome
from flowlake.operators.splits import hash_ranked


def event_filter(df: DataFrame, *, source_ip: str | None = None, severity: str | None = None, verdict: str | None = None, mode: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Conjunction of the given conditions; None, blanks and ``ALL`` mean no condition. Severity and
    verdict are wanted in any case. Plain comparisons on plain columns, so they reach the Parquet scan."""
    clean = lambda v, upper: None if v is None else (v.strip().upper() if upper else v.strip())
    wanted = {
        "source_ip": clean(source_ip, False), "severity": clean(severity, True),
        "hybrid_verdict": clean(verdict, True), "source_mode": clean(mode, False),
    }
    for column, value in wanted.items():
        if value and value.upper() != "ALL":
            df = df.filter(F.col(column) == value)
    if start is not None:
        df = df.filter(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end is not None:
        df = df.filter(F.col("ts") <= F.lit(end).cast("timestamp"))
    return df


#: Ranges of about as many rows that a table is cut into for paging.
RANGES = 256


def _position(df: DataFrame, name: str) -> Column:
    """A column that orders as ``name`` does: microseconds of times, numbers as they are."""
    kind = df.schema[name].dataType.typeName()
    return F.unix_micros(F.col(name)) if kind.startswith("timestamp") else F.col(name).cast("double")


def page(df: DataFrame, order: Sequence[str], number: int, size: int) -> tuple[DataFrame, DataFrame]:
    """Page ``number`` (clamped to the last page) of ``size`` rows in ascending order, and a row with totals.

    Rows are counted per range of the first column, a time or a number; only the ranges that the page touches
    are sorted, however deep it lies. At most ``RANGES`` counts reach the driver."""
    size = max(1, int(size))
    x = _position(df, order[0])
    cuts = sorted(set(df.agg(F.percentile_approx(x, [i / RANGES for i in range(1, RANGES)], 10_000)).first()[0] or []))
    at_range = F.when(x.isNull(), -1).otherwise(F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < x)) if cuts else F.lit(0))
    counts = dict(df.groupBy(at_range.alias("r")).count().collect())
    total = sum(counts.values())
    pages = max(1, -(-total // size))
    at = min(max(int(number), 1), pages)
    totals = df.sparkSession.createDataFrame([(total, pages, at)], "total_rows long, total_pages long, page long")
    first, before, touched = size * (at - 1), 0, []
    skipped = 0
    for r in sorted(counts):
        if before + counts[r] > first and before < first + size:
            touched.append(r)
        elif before + counts[r] <= first:
            skipped += counts[r]
        before += counts[r]
    low = [r for r in touched if r >= 0]
    inside = F.lit(False)
    if low:
        inside = F.lit(True) if cuts else x.isNotNull()
        if cuts and low[0] > 0:
            inside = inside & (x > F.lit(cuts[low[0] - 1]))
        if cuts and low[-1] < len(cuts):
            inside = inside & (x <= F.lit(cuts[low[-1]]))
    inside = (inside & x.isNotNull()) | x.isNull() if -1 in touched else inside & x.isNotNull()
    return df.filter(inside).orderBy(*order).offset(first - skipped).limit(size), totals


def list_events(df: DataFrame, n: int, offset: int = 0) -> DataFrame:
    """A listing of stored events, newest first; it shows 1 to 1000 of them."""
    return df.orderBy(F.desc("ts"), F.desc("event_id")).offset(max(0, int(offset))).limit(max(1, min(int(n), 1000)))


def recent_events(df: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` events, newest first, event id as tie-break."""
    return df.orderBy(F.desc("ts"), F.desc("event_id")).limit(max(0, int(n)))


def event_breakdown(df: DataFrame) -> DataFrame:
    """Totals overall, per severity and per verdict in one pass."""
    slim = df.select(
        F.col("severity"), F.col("hybrid_verdict"), (F.col("hybrid_verdict") == "ATTACK").alias("_threat"),
        F.size("rule_matches").alias("_rules"), F.col("source_escalated").alias("_esc"),
    )
    return slim.groupingSets([[], [F.col("severity")], [F.col("hybrid_verdict")]], "severity", "hybrid_verdict").agg(
        F.grouping_id().cast("int").alias("level"), F.count("*").alias("events"), F.count_if("_threat").alias("threats"),
        F.sum("_rules").cast("long").alias("rule_matches"), F.count_if("_esc").alias("escalations"),
    )


def explorer_filter(df: DataFrame, view: str, truth: str = "ALL", y: str = "y", pred: str = "pred") -> DataFrame:
    """correct / errors / fp / fn crossed with benign / attack."""
    tagged = df.withColumn("outcome", outcome(F.col(y), F.col(pred)))
    o = F.col("outcome")
    views = {
        "ALL": None, "correct": o == "CORRECT", "errors": o.isin("FALSE_POSITIVE", "FALSE_NEGATIVE"),
        "fp": o == "FALSE_POSITIVE", "fn": o == "FALSE_NEGATIVE",
    }
    if views[view] is not None:
        tagged = tagged.filter(views[view])
    if truth != "ALL":
        tagged = tagged.filter(F.col(y) == (1 if truth == "attack" else 0))
    return tagged


def timeline(df: DataFrame, ts: str = "ts", order: str = "seq") -> DataFrame:
    """One row per step of a flow: evaluation, recommendation (if the action is not ALLOW), block (if it
    was enforced as ISOLATE)."""
    step = lambda n, kind, cond: F.when(cond, F.struct(F.lit(n).alias("step"), F.lit(kind).alias("kind")))
    steps = F.array_compact(F.array(
        step(0, "EVALUATION", F.lit(True)), step(1, "RECOMMENDATION", F.col("proposed") > 0),
        step(2, "BLOCK", F.col("enforced") == 3),
    ))
    return df.select(order, ts, "host_id", F.explode(steps).alias("s")).select(order, ts, "host_id", "s.*").orderBy(ts, order, "step")


def interleave(df: DataFrame, kind: str, row_id: str, pattern: Sequence[str], seed: int = 42) -> DataFrame:
    """Mix classes in a repeating pattern such as (a, a, b, a, c). The n-th row of a class takes the slot
    of its n-th occurrence in the pattern."""
    slots: dict[str, list[int]] = {}
    for i, k in enumerate(pattern):
        slots.setdefault(k, []).append(i)
    ranked = hash_ranked(df.filter(F.col(kind).isin(list(slots))), [kind], row_id, seed)
    position = None
    for k, at in slots.items():
        zero = F.col("rn") - 1
        turn = F.floor(zero / len(at)) * len(pattern)
        value = turn + F.element_at(F.array(*[F.lit(a) for a in at]), (F.pmod(zero, F.lit(len(at))) + 1).cast("int"))
        cond = F.col(kind) == k
        position = F.when(cond, value) if position is None else position.when(cond, value)
    return ranked.withColumn("position", position.cast("long")).drop("rn").orderBy("position")


def attribution_rollup(phi: DataFrame) -> DataFrame:
    """Global rank of features by mean absolute attribution."""
    per = phi.groupBy("feature").agg(F.avg(F.abs("phi")).alias("mean_abs"), F.avg("phi").alias("mean"))
    return per.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean_abs"), "feature")))


def attribution_by_class(phi: DataFrame, family: str, top: int = 5) -> DataFrame:
    """Strongest features per family (features per family are few)."""
    per = phi.groupBy(family, "feature").agg(F.avg(F.abs("phi")).alias("mean_abs"))
    w = Window.partitionBy(family).orderBy(F.desc("mean_abs"), "feature")
    return per.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def attribution_per_row(phi: DataFrame, row_id: str, top: int = 3) -> DataFrame:
    """Strongest positive and negative features of each row (a row has one entry per feature)."""
    signed = phi.filter(F.col("phi") != 0).withColumn("sign", F.when(F.col("phi") > 0, "positive").otherwise("negative"))
    w = Window.partitionBy(row_id, "sign").orderBy(F.desc(F.abs("phi")), "feature")
    return signed.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
