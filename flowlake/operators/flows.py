"""Packets to bidirectional flows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlake.operators.chains import leading_rows
from flowlake.operators.ordered import (
    DAY, _join_chunk, attach_row, carry_sum, following, gap_sessions, micros, spread_lookup, time_chunk, with_halo,
)

FLAGS = ("syn", "ack", "rst", "fin", "psh", "urg")


def with_flow_key(packets: DataFrame) -> DataFrame:
    """Bidirectional key. Ports count only for TCP and UDP; endpoints compare as (ip text, port)."""
    has_ports = F.col("protocol").isin(6, 17)
    sp = F.when(has_ports, F.col("src_port")).otherwise(0)
    dp = F.when(has_ports, F.col("dst_port")).otherwise(0)
    forward = F.struct(F.col("src_ip").alias("ip"), sp.alias("port")) <= F.struct(
        F.col("dst_ip").alias("ip"), dp.alias("port")
    )
    a = lambda s, d: F.when(forward, s).otherwise(d)
    flow_id = F.concat(
        a(F.col("src_ip"), F.col("dst_ip")), F.lit(":"), a(sp, dp).cast("string"), F.lit("<->"),
        a(F.col("dst_ip"), F.col("src_ip")), F.lit(":"), a(dp, sp).cast("string"), F.lit("/"),
        F.col("protocol").cast("string"),
    )
    return packets.withColumns({"flow_key": flow_id, "is_forward": forward})


def flow_split(
    packets: DataFrame, idle_s: float = 120.0, max_life_s: float | None = 1800.0, chunk_s: float = DAY
) -> DataFrame:
    """Number the flows of each key. A packet starts a new flow when the key was silent for more than
    ``idle_s``, when the packet before carried FIN or RST, or when the flow is older than
    ``max_life_s``."""
    tcp_end = F.col("is_tcp") & (F.col("fin") | F.col("rst"))
    keyed = with_flow_key(packets).withColumn("_end", tcp_end)
    seq = gap_sessions(
        keyed, ["flow_key"], "ts", ["pkt_id"], idle_s, break_after="_end", chunk_s=chunk_s,
        out="_island",
    )
    if max_life_s is None:
        return seq.withColumnRenamed("_island", "flow_seq").drop("_end")
    # the lifetime can only cut an island that lasts longer; only the rows of those are walked
    key = ["flow_key", "_island"]
    span = F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))
    long_islands = seq.groupBy(*key).agg(span.alias("_span")).filter(F.col("_span") > micros(max_life_s)).select(*key)
    rows = seq.select(*key, "ts", "pkt_id").join(long_islands, key, "left_semi")
    led = leading_rows(rows, key, "ts", ["pkt_id"], max_life_s, strict=True, chunk_s=chunk_s, out="_start").filter("_start")
    head = led.groupBy(*key).agg(F.min(F.struct("ts", "pkt_id")).alias("_head"))
    cuts = led.join(head, key).filter(F.struct("ts", "pkt_id") != F.col("_head")).select("flow_key", "pkt_id", F.lit(True).alias("_cut"))
    marked = seq.join(cuts, ["flow_key", "pkt_id"], "left").withColumn("_cut", F.coalesce("_cut", F.lit(False)))
    return (
        numbered_starts(marked, ["flow_key"], "_cut", chunk_s)
        .withColumn("flow_seq", F.col("_island") + F.col("_run"))
        .drop("_end", "_island", "_cut", "_run")
    )


def numbered_starts(df: DataFrame, keys: list[str], flag: str, chunk_s: float) -> DataFrame:
    """Running count of flagged rows per key in (ts, pkt_id) order."""
    placed = df.withColumn("_chunk", time_chunk("ts", chunk_s)).withColumn("_f", F.col(flag).cast("long"))
    w = (
        Window.partitionBy(*keys, "_chunk").orderBy("ts", "pkt_id")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    carried = carry_sum(placed, keys, "_f", "_before")
    out = _join_chunk(placed.withColumn("_local", F.sum("_f").over(w)), carried, keys)
    return out.withColumn("_run", F.col("_before") + F.col("_local")).drop(
        "_chunk", "_f", "_local", "_before"
    )


def flow_aggregate(split: DataFrame) -> DataFrame:
    """One row per flow. All aggregates combine before the shuffle."""
    tcp = F.col("is_tcp")
    n = lambda cond: F.count_if(F.coalesce(tcp & cond, F.lit(False)))
    hit = lambda cond: F.coalesce(F.bool_or(tcp & cond), F.lit(False))
    syn_fin = F.col("syn") & F.col("fin")
    syn_rst = F.col("syn") & F.col("rst")
    xmas = F.col("fin") & F.col("psh") & F.col("urg")
    null = ~(F.col("syn") | F.col("ack") | F.col("rst") | F.col("fin") | F.col("psh") | F.col("urg"))
    null = null & (F.coalesce(F.col("raw_flags"), F.lit(0)) == 0)
    odd = sum((c.cast("int") for c in (syn_rst, xmas, null)), syn_fin.cast("int"))
    at = F.struct("ts", "pkt_id")
    first = F.min_by(F.struct("src_ip", "src_port", "dst_ip", "dst_port", "protocol"), at)
    last = F.max_by(F.struct("fin", "rst", "is_tcp"), at)
    length = F.col("packet_length")
    fwd = F.col("is_forward")
    grouped = split.groupBy("flow_key", "flow_seq").agg(
        first.alias("_first"), last.alias("_last"),
        F.min("ts").alias("start_ts"), F.max("ts").alias("last_ts"),
        F.count("*").alias("packet_count"),
        F.sum(length.cast("long")).alias("total_bytes"),
        F.avg(length).alias("length_mean"), F.stddev_pop(length).alias("length_std"),
        F.count_if(fwd).alias("fwd_packets"), F.count_if(~fwd).alias("bwd_packets"),
        F.sum(F.when(fwd, length).otherwise(0).cast("long")).alias("fwd_bytes"),
        F.sum(F.when(~fwd, length).otherwise(0).cast("long")).alias("bwd_bytes"),
        F.avg(F.when(fwd, length)).alias("fwd_packet_length_mean"),
        F.avg(F.when(~fwd, length)).alias("bwd_packet_length_mean"),
        *[n(F.col(f)).alias(f"{f}_count") for f in FLAGS],
        F.sum(F.when(tcp, odd).otherwise(0)).cast("long").alias("invalid_flags_count"),
        hit(syn_fin).alias("has_syn_fin"), hit(syn_rst).alias("has_syn_rst"),
        hit(null).alias("has_null_flags"), hit(xmas).alias("has_xmas_flags"),
    )
    end = F.col("_last")
    reason = (
        F.when(end["is_tcp"] & end["fin"], "FIN").when(end["is_tcp"] & end["rst"], "RST")
        .otherwise("TIMEOUT")
    )
    return grouped.select(
        "flow_key", "flow_seq", "_first.*", "start_ts", "last_ts",
        ((F.unix_micros("last_ts") - F.unix_micros("start_ts")) / 1e6).alias("duration_s"),
        *[c for c in grouped.columns[6:]],
        reason.alias("closed_reason"),
    )


def with_close_reasons(flows: DataFrame, idle_s: float, chunk_s: float = DAY) -> DataFrame:
    """Why each flow ended: FIN, RST, MAX_DURATION (the key went on within the idle limit), FLUSH (still
    open when the input ends) or TIMEOUT."""
    nxt = following(flows, F.col("start_ts"), "flow_key", "start_ts", "flow_seq", "_next_ts", chunk_s)
    known = attach_row(nxt, flows.agg(F.max("last_ts").alias("_end_ts")))
    within = lambda later: F.unix_micros(later) - F.unix_micros("last_ts") <= int(round(idle_s * 1_000_000))
    flagged = F.col("closed_reason").isin("FIN", "RST")
    reason = (
        F.when(flagged, F.col("closed_reason"))
        .when(F.col("_next_ts").isNotNull() & within(F.col("_next_ts")), "MAX_DURATION")
        .when(F.col("_next_ts").isNull() & within(F.col("_end_ts")), "FLUSH").otherwise("TIMEOUT")
    )
    return known.withColumn("closed_reason", reason).select(*flows.columns)


def traffic_types(packets: DataFrame) -> DataFrame:
    """Packets and bytes per protocol."""
    name = F.when(F.col("protocol") == 6, "TCP").when(F.col("protocol") == 17, "UDP").when(F.col("protocol") == 1, "ICMP").otherwise("OTHER")
    return packets.groupBy(name.alias("traffic_type")).agg(
        F.count("*").alias("packets"), F.sum(F.col("packet_length").cast("long")).alias("bytes")
    )


def flow_iat(split: DataFrame, idle_s: float, chunk_s: float = DAY) -> DataFrame:
    """Mean and population deviation of packet gaps per flow, in milliseconds. Gaps inside a flow are
    at most ``idle_s`` long, so that much context per slice is enough."""
    placed = with_halo(split, "ts", max(chunk_s, idle_s), idle_s)
    w = Window.partitionBy("flow_key", "flow_seq", "_chunk").orderBy("ts", "pkt_id")
    x = F.unix_micros("ts")
    gap = (x - F.lag(x).over(w)) / 1000.0
    return (
        placed.withColumn("_gap", gap).filter("_own").groupBy("flow_key", "flow_seq")
        .agg(
            F.coalesce(F.avg("_gap"), F.lit(0.0)).alias("flow_iat_mean_ms"),
            F.coalesce(F.stddev_pop("_gap"), F.lit(0.0)).alias("flow_iat_std_ms"),
        )
    )


def assemble_flows(
    packets: DataFrame, idle_s: float = 120.0, max_life_s: float | None = 1800.0, chunk_s: float = DAY
) -> DataFrame:
    """Packets to flows: split, then aggregate."""
    return flow_aggregate(flow_split(packets, idle_s, max_life_s, chunk_s))


def inter_flow_delta(flows: DataFrame, chunk_s: float = DAY) -> DataFrame:
    """Seconds since the previous flow of the same source, clamped to [0, 300]; 0 for the first.

    Any earlier flow more than 300 s back gives 300, so the context needed is 300 s plus the knowledge
    whether an earlier flow exists, which the first start per source tells."""
    placed = with_halo(flows, "start_ts", max(chunk_s, 300.0), 300.0)
    w = Window.partitionBy("src_ip", "_chunk").orderBy("start_ts", "flow_key", "flow_seq")
    x = F.unix_micros("start_ts")
    marked = placed.withColumn("_prev", F.lag(x).over(w)).filter("_own")
    marked = marked.withColumn("_head", F.struct("start_ts", "flow_key", "flow_seq"))
    firsts = flows.groupBy("src_ip").agg(
        F.min(F.struct("start_ts", "flow_key", "flow_seq")).alias("_first"),
        F.count("*").alias("_n"),
    )
    joined = spread_lookup(marked, firsts, ["src_ip"], "_n", ["flow_key", "flow_seq"])
    gap = (x - F.col("_prev")) / 1e6
    delta = (
        F.when(F.col("_head") == F.col("_first"), 0.0)
        .otherwise(F.least(F.coalesce(gap, F.lit(300.0)), F.lit(300.0)))
    )
    return joined.withColumn("inter_flow_delta_s", F.greatest(delta, F.lit(0.0))).select(
        *flows.columns, "inter_flow_delta_s"
    )


def close_reasons(flows: DataFrame) -> DataFrame:
    """Completed flows, packets, bytes per close reason."""
    return flows.groupBy("closed_reason").agg(
        F.count("*").alias("flows"),
        F.sum("packet_count").alias("packets"),
        F.sum("total_bytes").alias("bytes"),
    )


def concurrency(flows: DataFrame, chunk_s: float = DAY) -> DataFrame:
    """Peak number of flows open at the same time (+1 at the start, -1 after the end).

    Steps are summed per instant first; the running sum is taken per time slice and shifted."""
    steps = flows.select(
        F.explode(
            F.array(
                F.struct(F.col("start_ts").alias("ts"), F.lit(1).cast("long").alias("d")),
                F.struct(
                    F.timestamp_micros(F.unix_micros("last_ts") + 1).alias("ts"),
                    F.lit(-1).cast("long").alias("d"),
                ),
            )
        ).alias("s")
    ).select("s.*")
    per = steps.groupBy("ts").agg(F.sum("d").alias("d")).withColumn("_chunk", time_chunk("ts", chunk_s))
    sums = per.groupBy("_chunk").agg(F.sum("d").alias("_s"))
    before = sums.select(
        "_chunk",
        F.coalesce(
            F.sum("_s").over(Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("_b"),
    )
    w = Window.partitionBy("_chunk").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    level = per.withColumn("_l", F.sum("d").over(w)).join(before, "_chunk")
    return level.agg(F.max(F.col("_l") + F.col("_b")).alias("peak_active_flows"))


def traffic_rates(packets: DataFrame, flows: DataFrame) -> DataFrame:
    """Packets, bytes and flows per second over the elapsed span."""
    p = packets.agg(
        F.count("*").alias("packets"),
        F.sum(F.col("packet_length").cast("long")).alias("bytes"),
        ((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1e6).alias("elapsed_s"),
    )
    f = flows.agg(F.count("*").alias("flows"))
    span = F.nullif(F.col("elapsed_s"), F.lit(0.0))
    return attach_row(p, f).select(
        "packets", "bytes", "flows", "elapsed_s",
        F.try_divide(F.col("packets").cast("double"), span).alias("packets_per_s"),
        F.try_divide(F.col("flows").cast("double"), span).alias("flows_per_s"),
        F.try_divide(F.col("bytes").cast("double"), span).alias("bytes_per_s"),
    )
