"""Packets to bidirectional flows as a stream: one value state per flow key and event-time timers.

A flow ends with a FIN or RST, when its key has been silent for the idle limit, or when its lifetime is
over, whichever comes first; the two limits are timers, so a flow is emitted although its key never
sends again. A packet exactly at a limit still belongs to the flow.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlake.operators.flows import FLAGS, with_flow_key
from flowlake.operators.ordered import micros
from flowlake.streaming.in_order import US, InOrder, walked

HEAD = ("src_ip", "src_port", "dst_ip", "dst_port", "protocol")
PORTS, NONE = ("src_port", "dst_port", "protocol"), -1  # whole numbers that may be missing, and what stands for that in the state
ODD = ("syn_fin", "syn_rst", "null_flags", "xmas_flags")
SUMS = ("packet_count", "total_bytes", "squares", "fwd_packets", "fwd_bytes", *[f"{f}_count" for f in FLAGS], *ODD)
REASONS = {1: "FIN", 2: "RST"}
_HEAD = "src_ip string, src_port int, dst_ip string, dst_port int, protocol int"
_SUMS = ", ".join(f"{s} long" for s in SUMS)
ROW = f"{US} long, pkt_id long, ended int, {_HEAD}, {_SUMS}"
FLOW = f"flow_key string, first_pkt_id long, start_us long, last_us long, deadline_us long, closed_reason string, {_HEAD}, {_SUMS}"
STATE = f"first_pkt_id long, start_us long, last_us long, ended int, {_HEAD}, {_SUMS}"


def packet_rows(packets: DataFrame) -> DataFrame:
    """flow_key, ts and the columns of ``ROW``: everything a flow sums up, as whole numbers per packet."""
    tcp, length = F.coalesce(F.col("is_tcp"), F.lit(False)), F.coalesce(F.col("packet_length").cast("long"), F.lit(0).cast("long"))
    one = lambda cond: F.coalesce(tcp & cond, F.lit(False)).cast("long")
    none = ~(F.col("syn") | F.col("ack") | F.col("rst") | F.col("fin") | F.col("psh") | F.col("urg")) & (F.coalesce(F.col("raw_flags"), F.lit(0)) == 0)
    kind = F.when(tcp & F.col("fin"), 1).when(tcp & F.col("rst"), 2).otherwise(0)
    fwd = F.col("is_forward")
    sums = {
        "packet_count": F.lit(1).cast("long"), "total_bytes": length, "squares": length * length, "fwd_packets": fwd.cast("long"),
        "fwd_bytes": F.when(fwd, length).otherwise(F.lit(0).cast("long")), **{f"{f}_count": one(F.col(f)) for f in FLAGS},
        "syn_fin": one(F.col("syn") & F.col("fin")), "syn_rst": one(F.col("syn") & F.col("rst")), "null_flags": one(none),
        "xmas_flags": one(F.col("fin") & F.col("psh") & F.col("urg")),
    }
    whole = lambda c, kind: F.coalesce(F.col(c).cast(kind), F.lit(NONE).cast(kind)).alias(c)
    head = [whole(c, "int") if c in PORTS else F.col(c).cast("string").alias(c) for c in HEAD]
    return with_flow_key(packets).select(
        "flow_key", "ts", F.unix_micros("ts").alias(US), whole("pkt_id", "long"), kind.alias("ended"), *head,
        *[c.alias(n) for n, c in sums.items()],
    )


class Flows(InOrder):
    def __init__(self, idle_s: float, max_life_s: float | None):
        super().__init__(ROW, FLOW)
        self.idle, self.life = micros(idle_s), None if max_life_s is None else micros(max_life_s)

    def open(self, handle) -> None:
        self.flow = handle.getValueState("flow", STATE)

    def deadline(self, flow: tuple) -> tuple[int, str]:
        silent = flow[2] + self.idle
        if self.life is not None and flow[1] + self.life < silent:
            return flow[1] + self.life, "MAX_DURATION"
        return silent, "TIMEOUT"

    def closed(self, key: tuple, flow: tuple) -> tuple:
        at, reason = self.deadline(flow)
        return (key[0], *flow[:3], at, REASONS.get(flow[3], reason), *flow[4:])

    def walk(self, key: tuple, rows: Sequence[tuple], now: int) -> tuple[list[tuple], int | None]:
        flow = self.flow.get() if self.flow.exists() else None
        head, found = 3 + len(HEAD), []
        for row in rows:
            us, pkt_id, ended = row[:3]
            if flow is not None and us > self.deadline(flow)[0]:
                found.append(self.closed(key, flow))
                flow = None
            if flow is None:
                flow = (pkt_id, us, us, ended, *row[3:])
            else:
                total = (a + b for a, b in zip(flow[head + 1:], row[head:], strict=True))
                flow = (*flow[:2], us, ended, *flow[4:head + 1], *total)
            if ended:
                found.append(self.closed(key, flow))
                flow = None
        if flow is not None and now >= self.deadline(flow)[0]:
            found.append(self.closed(key, flow))
            flow = None
        if flow is None:
            self.flow.clear()
            return found, None
        if rows:
            self.flow.update(flow)
        return found, self.deadline(flow)[0]


def flow_stream(packets: DataFrame, idle_s: float = 120.0, max_life_s: float | None = 1800.0, delay: str = "1 minute") -> DataFrame:
    """Flows of a stream of packets as they end. ``deadline_ts`` is when silence or age would have ended the flow."""
    flows = walked(packet_rows(packets), ["flow_key"], "ts", delay, Flows(idle_s, max_life_s))
    n, total = F.col("packet_count"), F.col("total_bytes")
    mean = lambda part, count: F.when(count > 0, part / count)
    bwd_n, bwd = n - F.col("fwd_packets"), total - F.col("fwd_bytes")
    spread = F.sqrt((n * F.col("squares") - total * total).cast("double")) / n
    at = lambda c: F.timestamp_micros(c)
    return flows.select(
        "flow_key", "first_pkt_id", *[F.nullif(F.col(c), F.lit(NONE)).alias(c) if c in PORTS else c for c in HEAD], at("start_us").alias("start_ts"), at("last_us").alias("last_ts"), at("deadline_us").alias("deadline_ts"),
        ((F.col("last_us") - F.col("start_us")) / 1e6).alias("duration_s"), "packet_count", "total_bytes", (total / n).alias("length_mean"),
        spread.alias("length_std"), "fwd_packets", bwd_n.alias("bwd_packets"), "fwd_bytes", bwd.alias("bwd_bytes"),
        mean(F.col("fwd_bytes"), F.col("fwd_packets")).alias("fwd_packet_length_mean"), mean(bwd, bwd_n).alias("bwd_packet_length_mean"),
        *[f"{f}_count" for f in FLAGS], sum((F.col(c) for c in ODD[1:]), F.col(ODD[0])).alias("invalid_flags_count"),
        *[(F.col(c) > 0).alias(f"has_{c}") for c in ODD], "closed_reason",
    )


def flushed(flows: DataFrame, end: Column) -> DataFrame:
    """Flows that neither limit had ended when the capture ended, at ``end``, are FLUSH."""
    still = ~F.col("closed_reason").isin("FIN", "RST") & (F.col("deadline_ts") >= end)
    return flows.withColumn("closed_reason", F.when(still, "FLUSH").otherwise(F.col("closed_reason")))
