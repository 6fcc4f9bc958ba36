"""Order-sensitive building blocks that keep hot keys spread over many tasks.

A window partitioned by a key alone sends every row of that key to one task. When one host or one
flow key holds a third of a large table that task never ends. The helpers below cut each key into
chunks along its order (a time slice, a value range, a block of row numbers), work inside
``(key, chunk)`` groups, and carry a small summary from chunk to chunk. The chunk is always a pure
function of the row, so a lost executor recomputes the same groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlake.session import durable

DAY = 86_400.0


def micros(seconds: float) -> int:
    return int(round(seconds * 1_000_000))


def time_chunk(ts: str, seconds: float) -> Column:
    """Index of the time slice of ``ts``; exact integer arithmetic, also before 1970."""
    width = micros(seconds)
    x = F.unix_micros(F.col(ts))
    return ((x - F.pmod(x, F.lit(width))) / F.lit(width)).cast("long")


def with_halo(df: DataFrame, ts: str, width_s: float, reach_s: float) -> DataFrame:
    """Place each row in its time slice, and copy the rows of the last ``reach_s`` seconds of a
    slice into the next one, where they only serve as context (``_own`` is false there)."""
    width, reach = micros(width_s), micros(reach_s)
    if reach > width:
        raise ValueError("the slice must be at least as wide as the context it needs")
    x = F.unix_micros(F.col(ts))
    into = F.pmod(x, F.lit(width))
    own = ((x - into) / F.lit(width)).cast("long")
    slots = F.when(F.lit(width) - into <= reach, F.array(own, own + 1)).otherwise(F.array(own))
    return df.withColumn("_chunk", F.explode(slots)).withColumn("_own", F.col("_chunk") == own)


def carry_sum(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Per ``(keys, _chunk)`` the sum of ``value`` over all earlier chunks of the same keys."""
    w = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*keys, "_chunk").agg(F.sum(value).alias("_s"))
    return sums.select(*keys, "_chunk", F.coalesce(F.sum("_s").over(w), F.lit(0)).alias(out))


def _join_chunk(df: DataFrame, carried: DataFrame, keys: Sequence[str]) -> DataFrame:
    right = carried
    cond = None
    for c in [*keys, "_chunk"]:
        right = right.withColumnRenamed(c, f"_r_{c}")
        part = F.col(c).eqNullSafe(F.col(f"_r_{c}"))
        cond = part if cond is None else cond & part
    return df.join(right, cond, "inner").drop(*[f"_r_{c}" for c in [*keys, "_chunk"]])


def gap_sessions(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    order: Sequence[str],
    gap_s: float,
    *,
    break_after: str | None = None,
    break_before: str | None = None,
    chunk_s: float = DAY,
    out: str = "session_seq",
) -> DataFrame:
    """Number the sessions of each key from 1.

    A session starts when the previous row of the key is more than ``gap_s`` away, or carried
    ``break_after``, or when the row itself carries ``break_before``. A row further away than the
    gap starts a session whatever came before it, so ``gap_s`` seconds of context are enough.
    """
    placed = with_halo(df, ts, max(chunk_s, gap_s), gap_s)
    w = Window.partitionBy(*keys, "_chunk").orderBy(ts, *order)
    x = F.unix_micros(F.col(ts))
    prev = F.lag(x).over(w)
    new = prev.isNull() | (x - prev > micros(gap_s))
    if break_after is not None:
        new = new | F.coalesce(F.lag(F.col(break_after)).over(w), F.lit(False))
    if break_before is not None:
        new = new | F.coalesce(F.col(break_before), F.lit(False))
    marked = placed.withColumn("_new", new.cast("long")).filter("_own")
    carried = carry_sum(marked, keys, "_new", "_before")
    running = F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return (
        _join_chunk(marked.withColumn("_local", running), carried, keys)
        .withColumn(out, F.col("_before") + F.col("_local"))
        .drop("_chunk", "_own", "_new", "_local", "_before")
    )


def numbered(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], chunk: Column, out: str = "rn"
) -> DataFrame:
    """Exact ``row_number`` per key. ``chunk`` must not decrease along ``order``."""
    placed = df.withColumn("_chunk", chunk).withColumn("_one", F.lit(1).cast("long"))
    carried = carry_sum(placed, keys, "_one", "_before")
    w = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    return (
        _join_chunk(placed.withColumn("_local", F.row_number().over(w)), carried, keys)
        .withColumn(out, F.col("_before") + F.col("_local"))
        .drop("_chunk", "_one", "_local", "_before")
    )


def ranked_globally(df: DataFrame, order: Sequence[str], out: str = "rn", chunk: str = "_chunk") -> DataFrame:
    """Exact row number over the whole table along ``order``, which must tell all rows apart, and the slice a row lies in.

    Slices are ranges of ``order`` with about as many rows each, whatever the times: their edges come from a sample
    that Spark's range partitioning takes, so a day or an instant with a third of the rows lies in many. The slices
    are written once (``durable``); a slice is numbered by itself and starts where those before it end."""
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = durable(df.repartitionByRange(ranges, *order).withColumn(chunk, F.spark_partition_id().cast("long")))
    counts = placed.groupBy(F.col(chunk).alias("_r")).agg(F.count("*").alias("_n"))  # one row per slice
    earlier = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_r", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(chunk).orderBy(*order)
    numbered_in = placed.withColumn("_row", F.row_number().over(inside))
    return numbered_in.join(starts, F.col(chunk) == F.col("_r")).withColumn(out, (F.col("_start") + F.col("_row")).cast("long")).drop("_r", "_start", "_row")


def blocks_with_context(df: DataFrame, rn: str, reach: int, block_rows: int) -> DataFrame:
    """Cut numbered rows into blocks of ``block_rows`` and copy the last ``reach`` rows of each block
    into the next, so a ROWS frame of that reach can run inside ``(key, _block)``."""
    if reach >= block_rows:
        raise ValueError("a block must be larger than the frame")
    zero = F.col(rn) - 1
    own = F.floor(zero / block_rows).cast("long")
    tail = F.pmod(zero, F.lit(block_rows)) >= block_rows - reach
    slots = F.when(tail, F.array(own, own + 1)).otherwise(F.array(own))
    return df.withColumn("_block", F.explode(slots)).withColumn("_own", F.col("_block") == own)


#: Value ranges per doubling of the value.
RANGES = 1024


def value_chunk(column: Column | str) -> Column:
    """A range number that never decreases with the value: logarithmic ranges on both sides of zero.

    It is a function of the value alone, so no pass over the data chooses cuts, and values spread over
    ``RANGES`` ranges per doubling. NaN comes after everything else."""
    x = (F.col(column) if isinstance(column, str) else column).cast("double")
    size = F.least(F.log2(1.0 + F.abs(x) * float(2**20)), F.lit(1100.0))
    return F.when(F.isnan(x), F.lit(1200 * RANGES)).otherwise(F.floor(F.signum(x) * size * RANGES)).cast("long")


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    sums: Sequence[str],
    *,
    next_value: str | None = None,
) -> DataFrame:
    """Running (``cum_x``) and overall (``tot_x``) sums along ``order`` inside each key.

    ``df`` holds one row per ``(keys, order)``. The order column may have as many distinct values as
    the table has rows: the running sum is taken inside value ranges and shifted by the sums of the
    lower ranges. ``next_value`` adds the next larger order value of the key.
    """
    keys = list(keys)
    placed = df.withColumn("_chunk", value_chunk(order))
    per = placed.groupBy(*keys, "_chunk").agg(
        *[F.sum(s).alias(f"_s_{s}") for s in sums], F.min(order).alias("_lo")
    )
    w = Window.partitionBy(*keys).orderBy("_chunk")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    carried = per.select(
        *keys,
        "_chunk",
        *[F.coalesce(F.sum(f"_s_{s}").over(before), F.lit(0)).alias(f"_b_{s}") for s in sums],
        *[F.sum(f"_s_{s}").over(whole).alias(f"tot_{s}") for s in sums],
        F.lead("_lo").over(w).alias("_next_lo"),
    )
    lw = Window.partitionBy(*keys, "_chunk").orderBy(order)
    frame = lw.rowsBetween(Window.unboundedPreceding, 0)
    local = placed
    for s in sums:
        local = local.withColumn(f"_l_{s}", F.sum(s).over(frame))
    if next_value is not None:
        local = local.withColumn("_next_local", F.lead(order).over(lw))
    out = _join_chunk(local, carried, keys)
    for s in sums:
        out = out.withColumn(f"cum_{s}", F.col(f"_b_{s}") + F.col(f"_l_{s}"))
    if next_value is not None:
        out = out.withColumn(next_value, F.coalesce("_next_local", "_next_lo")).drop("_next_local")
    return out.drop("_chunk", "_next_lo", *[f"_l_{s}" for s in sums], *[f"_b_{s}" for s in sums])


def exact_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]
) -> DataFrame:
    """Exact linearly interpolated percentiles per key, without a per-group value map.

    Works on per-value counts and the running count, so a group of any size is spread.
    """
    keys = list(keys)
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_v"))
        .agg(F.count("*").alias("_n"))
    )
    run = running_totals(counts, keys, "_v", ["_n"])
    lo_edge, hi_edge = F.col("cum__n") - F.col("_n"), F.col("cum__n")
    aggs = []
    for name, p in probs.items():
        pos = F.lit(p) * (F.col("tot__n") - 1)
        for side, k in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            hit = (lo_edge <= k) & (k < hi_edge)
            aggs.append(F.max(F.when(hit, F.col("_v"))).alias(f"_{side}_{name}"))
        aggs.append(F.max(pos - F.floor(pos)).alias(f"_f_{name}"))
    got = run.groupBy(*keys).agg(*aggs) if keys else run.agg(*aggs)
    cols = [
        (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_f_{n}")).alias(n)
        for n in probs
    ]
    return got.select(*keys, *cols)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the first row of each key by ``order``; a combinable aggregate, so a group of copies that
    holds a third of the table shrinks before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    )
    return picked.select(*keys, "_row.*").select(*df.columns)


#: A key is hot when it has more than one in this many of all rows, so hot keys are fewer than this.
HOT_ONE_IN = 1000


def spread_lookup(
    rows: DataFrame, table: DataFrame, keys: Sequence[str], weight: str, spread: Sequence[str], *, salts: int = 1024,
    absent: Column | None = None,
) -> DataFrame:
    """Left join ``rows`` with a per-key ``table`` whose ``weight`` is the number of rows of the key.

    Hot keys, fewer than ``HOT_ONE_IN`` at any size, are broadcast; their rows then travel through the
    shuffle join under a salt taken from ``spread`` and never meet in one task. So do the rows for which
    ``absent`` holds, whose key is known not to be in the table."""
    values = [c for c in table.columns if c not in keys]
    marked = attach_row(table, table.agg(F.sum(F.col(weight)).alias("_total")))
    marked = marked.withColumn("_is_hot", F.col(weight) * HOT_ONE_IN > F.col("_total"))
    hot = marked.filter("_is_hot").select(
        *[F.col(k).alias(f"_h_{k}") for k in keys],
        *[F.col(v).alias(f"_hv_{v}") for v in values],
    )
    cond = None
    for k in keys:
        part = F.col(k).eqNullSafe(F.col(f"_h_{k}"))
        cond = part if cond is None else cond & part
    step = rows.join(F.broadcast(hot), cond, "left").drop(*[f"_h_{k}" for k in keys])
    apart = F.col(f"_hv_{weight}").isNotNull()
    salt = F.when(
        apart if absent is None else apart | absent, -1 - F.pmod(F.xxhash64(*spread), F.lit(salts))
    ).otherwise(F.lit(0)).cast("long")
    step = step.withColumn("_salt", salt)
    cold = marked.filter(~F.col("_is_hot")).select(
        *[F.col(k).alias(f"_c_{k}") for k in keys],
        F.col("_is_hot").cast("long").alias("_c_salt"),  # 0; a literal would be folded and not be a key of the join
        *[F.col(v).alias(f"_cv_{v}") for v in values],
    )
    cond = F.col("_salt") == F.col("_c_salt")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_c_{k}"))
    joined = step.join(cold, cond, "left")
    return joined.select(
        *rows.columns, *[F.coalesce(f"_hv_{v}", f"_cv_{v}").alias(v) for v in values]
    )


def attach_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row aggregate to every row, as a scalar subquery."""
    row = one_row.select(F.struct(*one_row.columns).alias("_row")).scalar()
    return df.withColumn("_row", row).select(*df.columns, "_row.*")


def previous(df: DataFrame, value: str, host: str, ts: str, order: str, out: str, chunk_s: float = DAY, default=None) -> DataFrame:
    """Value of the row before, across slices."""
    placed = df.withColumn("_chunk", time_chunk(ts, chunk_s))
    w = Window.partitionBy(host, "_chunk").orderBy(ts, order)
    at = F.struct(ts, order)
    ends = placed.groupBy(host, "_chunk").agg(F.max_by(F.struct(F.col(value).alias("v")), at).alias("_end"))
    carried = ends.select(host, "_chunk", F.lag("_end").over(Window.partitionBy(host).orderBy("_chunk")).alias("_carry"))
    local = placed.withColumn("_prev", F.lag(F.struct(F.col(value).alias("v"))).over(w))
    got = F.coalesce(F.col("_prev"), F.col("_carry"))["v"]
    if default is not None:
        got = F.coalesce(got, F.lit(default))
    return _join_chunk(local, carried, [host]).withColumn(out, got).drop("_chunk", "_prev", "_carry")


def following(df: DataFrame, value: Column, host: str, ts: str, order: str, out: str, chunk_s: float = DAY) -> DataFrame:
    """Value of the row after, across slices."""
    placed = df.withColumn("_chunk", time_chunk(ts, chunk_s)).withColumn("_v", value)
    w = Window.partitionBy(host, "_chunk").orderBy(ts, order)
    heads = placed.groupBy(host, "_chunk").agg(F.min_by(F.struct("_v"), F.struct(ts, order)).alias("_head"))
    carried = heads.select(host, "_chunk", F.lead("_head").over(Window.partitionBy(host).orderBy("_chunk")).alias("_carry"))
    local = placed.withColumn("_nx", F.lead(F.struct("_v")).over(w))
    return _join_chunk(local, carried, [host]).withColumn(
        out, F.coalesce(F.col("_nx"), F.col("_carry"))["_v"]
    ).drop("_chunk", "_v", "_nx", "_carry")
