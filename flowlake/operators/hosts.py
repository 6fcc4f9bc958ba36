"""Per-source correlation: sliding counts, escalation, port scans, alert throttling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlake.operators.chains import leading_rows
from flowlake.operators.ordered import (
    DAY, _join_chunk, carry_sum, first_per_key, gap_sessions, micros, numbered, time_chunk,
)


def suspicious_count(
    df: DataFrame, key: str, ts: str, order: str, suspicious: str, window_s: float = 60.0,
    chunk_s: float = DAY, out: str = "suspicious_count",
) -> DataFrame:
    """Suspicious rows of the source in the last ``window_s`` seconds, both edges inclusive, arrival
    order breaking timestamp ties: rows of the same instant that arrive later are not counted yet.

    A suspicious row adds one where it stands and takes it away right after the last instant that still
    sees it, so the count is a running sum and a row costs the same whatever the window holds."""
    width = F.lit(micros(chunk_s))
    step = lambda us, leaves, add: F.struct(us.alias("_us"), F.lit(leaves).alias("_leaves"), F.lit(add).cast("long").alias("_add"))
    us = F.unix_micros(F.col(ts))
    steps = F.when(F.col(suspicious), F.array(step(us, False, 1), step(us + micros(window_s), True, -1)))
    placed = df.filter(F.col(ts).isNotNull()).withColumn("_step", F.explode(F.coalesce(steps, F.array(step(us, False, 0)))))
    placed = placed.select(*df.columns, "_step.*")
    placed = placed.withColumn("_chunk", ((F.col("_us") - F.pmod(F.col("_us"), width)) / width).cast("long"))
    carried = carry_sum(placed, [key], "_add", "_before")
    running = Window.partitionBy(key, "_chunk").orderBy("_us", "_leaves", order).rowsBetween(Window.unboundedPreceding, 0)
    counted = placed.withColumn("_local", F.sum("_add").over(running)).filter(~F.col("_leaves"))
    return (
        _join_chunk(counted, carried, [key]).withColumn(out, F.col("_before") + F.col("_local"))
        .drop("_us", "_leaves", "_add", "_chunk", "_local", "_before")
    )


def source_escalation(
    df: DataFrame, key: str, ts: str, order: str, suspicious: str, *, threshold: int = 5,
    window_s: float = 60.0, cooldown_s: float = 30.0, chunk_s: float = DAY,
) -> DataFrame:
    """BELOW_THRESHOLD, THRESHOLD_MET or COOLDOWN_ACTIVE per row. Among the rows at or above the
    threshold the escalations are the leaders of a throttle with the cooldown as gap."""
    counted = suspicious_count(df, key, ts, order, suspicious, window_s, chunk_s)
    above = F.col("suspicious_count") >= threshold
    met = leading_rows(
        counted.filter(above), [key], ts, [order], cooldown_s, chunk_s=chunk_s, out="escalate"
    ).withColumn("reason", F.when(F.col("escalate"), "THRESHOLD_MET").otherwise("COOLDOWN_ACTIVE"))
    below = counted.filter(~above).withColumns({
        "escalate": F.lit(False), "reason": F.lit("BELOW_THRESHOLD")
    })
    return met.unionByName(below)


def source_summary(escalated: DataFrame, key: str, ts: str, suspicious: str) -> DataFrame:
    """Running totals at the end of the stream per source."""
    return escalated.groupBy(key).agg(
        F.count("*").alias("total_flows"),
        F.count_if(F.col(suspicious)).alias("total_suspicious"),
        F.count_if("escalate").alias("escalation_count"),
        F.max(F.when(F.col("escalate"), F.col(ts))).alias("last_escalation_ts"),
        F.max(ts).alias("last_seen_ts"),
    )


def _probes(flows: DataFrame, ts: str, order: str) -> DataFrame:
    named = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) != ""
    return flows.filter(F.col("dst_port").between(1, 65535) & named("src_ip") & named("dst_ip")).select(
        F.trim("src_ip").alias("src_ip"), F.trim("dst_ip").alias("dst_ip"),
        F.col("dst_port").cast("long").alias("dst_port"), F.col(ts).alias("ts"),
        F.col(order).cast("long").alias("probe_id"),
    )


def vertical_scans(
    flows: DataFrame, ts: str = "ts", order: str = "probe_id", *, window_s: float = 60.0,
    min_ports: int = 5, min_probes: int = 5, chunk_s: float = DAY,
) -> DataFrame:
    """First row per (source, destination) activity session at which enough distinct ports and probes
    were seen. Only the first probe of each port matters, so at most 65 535 rows per session remain
    after the pre-aggregation."""
    dst = ["src_ip", "dst_ip"]
    probes = gap_sessions(
        _probes(flows, ts, order), dst, "ts", ["probe_id"], window_s, chunk_s=chunk_s, out="session_seq"
    )
    at = F.struct("ts", "probe_id")
    firsts = probes.groupBy(*dst, "session_seq", "dst_port").agg(F.min(at).alias("at"))
    w = Window.partitionBy(*dst, "session_seq").orderBy("at")
    kth = firsts.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") == min_ports)
    hits = kth.select(*dst, "session_seq", "at")
    if min_probes > min_ports:
        keys = [*dst, "session_seq"]
        nth = numbered(probes, keys, ["ts", "probe_id"], time_chunk("ts", chunk_s))
        nth = nth.filter(F.col("rn") == min_probes).select(*keys, at.alias("nth"))
        hits = hits.join(nth, keys).withColumn("at", F.greatest("at", "nth")).drop("nth")
    counted = firsts.select(*dst, "session_seq", F.col("at").alias("port_at"))
    return (
        hits.join(counted, [*dst, "session_seq"]).filter(F.col("port_at") <= F.col("at"))
        .groupBy(*dst, "session_seq", "at").agg(F.count("*").alias("unique_ports"))
        .select(*dst, "session_seq", "at.ts", "at.probe_id", "unique_ports")
    )


def live_items(
    probes: DataFrame, item: str, window_s: float, chunk_s: float, out: str
) -> DataFrame:
    """Per probe, the distinct values of ``item`` (the port, or the destination) of its source over the
    destinations still live at that moment.

    An item of a (source, destination, session) is live from its first probe until the session end plus the
    window. The intervals of an item are merged inside a time slice, and a sweep of +1 / -1 steps counts
    the items, so no set is held for a source."""
    reach = micros(window_s)
    width = micros(max(chunk_s, window_s))
    dst = ["src_ip", "dst_ip", "session_seq"]
    ends = probes.groupBy(*dst).agg((F.unix_micros(F.max("ts")) + reach).alias("until"))
    spans = (
        probes.withColumn("_item", F.col(item)).groupBy(*dst, "_item").agg(F.min(F.struct("ts", "probe_id")).alias("at"))
        .join(ends, dst)
        .select(
            "src_ip", "_item", F.unix_micros("at.ts").alias("from_us"),
            F.col("at.probe_id").alias("from_id"), "until",
        )
    )
    slot = lambda c: ((F.col(c) - F.pmod(F.col(c), F.lit(width))) / F.lit(width)).cast("long")
    cut = spans.withColumn("_chunk", F.explode(F.sequence(slot("from_us"), slot("until")))).withColumns({
        "_start": F.when(
            F.col("_chunk") == slot("from_us"), F.struct(F.col("from_us").alias("us"), F.col("from_id").alias("id"))
        ).otherwise(F.struct((F.col("_chunk") * width).alias("us"), F.lit(-1).cast("long").alias("id"))),
    })
    w = Window.partitionBy("src_ip", "_item", "_chunk").orderBy("_start", "until")
    so_far = F.max("until").over(w.rowsBetween(Window.unboundedPreceding, -1))
    grouped = (
        cut.withColumn("_new", (so_far.isNull() | (F.col("_start.us") > so_far)).cast("long"))
        .withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("src_ip", "_item", "_chunk", "_g")
        .agg(F.min("_start").alias("_start"), F.max("until").alias("until"))
    )
    step = lambda us, i, d: F.struct(us.alias("us"), i.alias("id"), F.lit(d).cast("long").alias("d"))
    steps = grouped.select(
        "src_ip", "_chunk",
        F.explode(F.array(
            step(F.col("_start.us"), F.col("_start.id"), 1),
            step(F.col("until") + 1, F.lit(-2).cast("long"), -1),
        )).alias("s"),
    ).select("src_ip", "_chunk", "s.*", F.lit(0).alias("is_row"))
    rows = probes.select(
        "src_ip", time_chunk("ts", max(chunk_s, window_s)).alias("_chunk"),
        F.unix_micros("ts").alias("us"), F.col("probe_id").alias("id"),
        F.lit(0).cast("long").alias("d"), F.lit(1).alias("is_row"),
    )
    sweep = Window.partitionBy("src_ip", "_chunk").orderBy("us", "id", "is_row")
    return (
        steps.unionByName(rows)
        .withColumn(out, F.sum("d").over(sweep.rowsBetween(Window.unboundedPreceding, 0)))
        .filter(F.col("is_row") == 1)
        .select("src_ip", F.timestamp_micros("us").alias("ts"), F.col("id").alias("probe_id"), out)
    )


def distributed_scans(
    flows: DataFrame, ts: str = "ts", order: str = "probe_id", *, window_s: float = 60.0,
    min_ports: int = 5, min_probes: int = 5, chunk_s: float = DAY,
) -> DataFrame:
    """One alert per activity session of a source: the first probe at which the distinct ports over all
    live destinations reach the threshold and that is not itself a vertical alert; with the number of
    those destinations."""
    base = _probes(flows, ts, order)
    by_dst = gap_sessions(
        base, ["src_ip", "dst_ip"], "ts", ["probe_id"], window_s, chunk_s=chunk_s, out="session_seq"
    )
    counted = live_items(by_dst, "dst_port", window_s, chunk_s, "live_ports")
    sessions = gap_sessions(
        base, ["src_ip"], "ts", ["probe_id"], window_s, chunk_s=chunk_s, out="source_session"
    )
    if min_probes > min_ports:
        sessions = numbered(
            sessions, ["src_ip", "source_session"], ["ts", "probe_id"], time_chunk("ts", chunk_s), "nth"
        ).filter(F.col("nth") >= min_probes)
    vertical = vertical_scans(
        flows, ts, order, window_s=window_s, min_ports=min_ports, min_probes=min_probes, chunk_s=chunk_s
    ).select("src_ip", "ts", "probe_id")
    key = ["src_ip", "ts", "probe_id"]
    candidates = (
        counted.filter(F.col("live_ports") >= min_ports)
        .join(vertical, key, "left_anti")
        .join(sessions.select(*key, "source_session"), key)
    )
    firsts = first_per_key(candidates, ["src_ip", "source_session"], ["ts", "probe_id"])
    return firsts.join(live_items(by_dst, "dst_ip", window_s, chunk_s, "targets"), key).select(
        "src_ip", "source_session", "ts", "probe_id", F.col("live_ports").alias("unique_ports"), "targets"
    )


def scan_columns(flows: DataFrame, order: str, ts: str, **limits) -> DataFrame:
    """Flows with ``scan_type``, ``scan_ports`` and ``scan_target`` for the multi-flow rule."""
    tcp = flows.filter(F.col("protocol") == 6)
    v = vertical_scans(tcp, ts, order, **limits).select(
        F.col("probe_id").alias("_id"), F.lit("VERTICAL").alias("scan_type"),
        F.col("unique_ports").alias("scan_ports"), F.col("dst_ip").alias("scan_target"),
    )
    d = distributed_scans(tcp, ts, order, **limits).select(
        F.col("probe_id").alias("_id"), F.lit("DISTRIBUTED").alias("scan_type"),
        F.col("unique_ports").alias("scan_ports"), 
        F.concat(F.col("targets").cast("string"), F.lit(" targets (subnet scan)")).alias("scan_target"),
    )
    hits = v.unionByName(d)
    return flows.join(hits, flows[order].cast("long") == hits["_id"], "left").drop("_id")


def alert_dedup(
    alerts: DataFrame, keys: Sequence[str], ts: str, order: str, window_s: float = 5.0,
    chunk_s: float = DAY,
) -> DataFrame:
    """Mark alerts within ``window_s`` of the last alert of the key that was not itself a duplicate."""
    return leading_rows(
        alerts, keys, ts, [order], window_s, chunk_s=chunk_s, out="_lead"
    ).withColumn("deduplicated", ~F.col("_lead")).drop("_lead")


def tumbling_counts(df: DataFrame, key: str, ts: str, size: str, slide: str | None = None) -> DataFrame:
    """Events per key and window."""
    win = F.window(ts, size, slide) if slide else F.window(ts, size)
    return df.groupBy(key, win.alias("w")).agg(F.count("*").alias("n")).select(
        key, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n"
    )


def session_counts(df: DataFrame, key: str, ts: str, order: str, gap_s: float, chunk_s: float = DAY) -> DataFrame:
    """Events per key and inactivity session."""
    got = gap_sessions(df, [key], ts, [order], gap_s, chunk_s=chunk_s)
    return got.groupBy(key, "session_seq").agg(
        F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("n")
    )


def device_inventory(frames: DataFrame) -> DataFrame:
    """Per device: first and last sighting, frames, bytes, latest address, evidence kinds."""
    at = F.struct("ts", "frame_id")
    return frames.groupBy("mac").agg(
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
        F.count("*").alias("frames"), F.sum("bytes").alias("bytes"),
        F.max_by("ip", at).alias("latest_ip"),
        F.max_by("hostname", at).alias("latest_hostname"),
        F.sort_array(F.collect_set("evidence")).alias("evidence"),
    )


def oui_vendor(devices: DataFrame, vendors: DataFrame) -> DataFrame:
    """Vendor by address prefix; locally administered (random) addresses have none. The vendor list is
    a published registry of bounded size."""
    second = F.conv(F.substr("mac", F.lit(1), F.lit(2)), 16, 10).cast("int")
    local = second.bitwiseAND(2) != 0
    prefix = F.when(~local, F.upper(F.substr("mac", F.lit(1), F.lit(8))))
    return (
        devices.withColumns({"is_random_mac": local, "_p": prefix})
        .join(F.broadcast(vendors.select(F.upper("prefix").alias("_p"), "vendor")), "_p", "left")
        .drop("_p")
    )
