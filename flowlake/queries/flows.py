"""Packets to flows to rules: W1 to W5, A1, A26, F1 to F17, P2, P4, R1 to R12, X1, X2, X11."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake.functions import features as feats
from flowlake.operators import flows, ordered, rules, sequences
from flowlake.queries.book import Book, big, rnd, rounded
from flowlake.sources.views import cte, view

BOOK = Book()
IDLE_S, LIFE_S = 21_600.0, 86_400.0
WIDE_S = 2_592_000.0  # 30 days: long flows, for the rules and the lifetime cut


def packets(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "packets")


def split_sql(idle_s: float) -> str:
    """Gaps and islands per key: a silence longer than the limit, or FIN or RST just before, starts a flow."""
    return f"""{cte('packets')},
ports as (select *, case when protocol in (6, 17) then src_port else 0 end as sp, case when protocol in (6, 17) then dst_port else 0 end as dp from packets),
dirs as (select *, src_ip < dst_ip or (src_ip = dst_ip and sp <= dp) as is_forward from ports),
keyed as (select *, case when is_forward then concat(src_ip, ':', sp, '<->', dst_ip, ':', dp, '/', protocol) else concat(dst_ip, ':', dp, '<->', src_ip, ':', sp, '/', protocol) end as flow_key from dirs),
marked as (select *, case when lag(ts) over w is null or epoch_us(ts) - epoch_us(lag(ts) over w) > {int(idle_s * 1_000_000)}
  or coalesce(lag(is_tcp and (fin or rst)) over w, false) then 1 else 0 end as new from keyed window w as (partition by flow_key order by ts, pkt_id)),
split as (select *, sum(new) over (partition by flow_key order by ts, pkt_id rows between unbounded preceding and current row) as flow_seq from marked)"""


def flows_sql(idle_s: float) -> str:
    none = "not (syn or ack or rst or fin or psh or urg) and coalesce(raw_flags, 0) = 0"
    return f"""{split_sql(idle_s)},
flows as (select flow_key, {big('flow_seq')} as flow_seq, first(src_ip order by ts, pkt_id) as src_ip, first(dst_ip order by ts, pkt_id) as dst_ip,
  first(dst_port order by ts, pkt_id) as dst_port, max(protocol) as protocol, min(ts) as start_ts, max(ts) as last_ts,
  (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0 as duration_s, count(*) as packet_count, {big('sum(packet_length)')} as total_bytes,
  avg(packet_length) as length_mean, stddev_pop(packet_length) as length_std,
  count(*) filter (where is_forward) as fwd_packets, count(*) filter (where not is_forward) as bwd_packets,
  {big('sum(case when is_forward then packet_length else 0 end)')} as fwd_bytes, {big('sum(case when is_forward then 0 else packet_length end)')} as bwd_bytes,
  avg(packet_length) filter (where is_forward) as fwd_packet_length_mean, avg(packet_length) filter (where not is_forward) as bwd_packet_length_mean,
  count(*) filter (where is_tcp and syn) as syn_count, count(*) filter (where is_tcp and ack) as ack_count, count(*) filter (where is_tcp and rst) as rst_count,
  count(*) filter (where is_tcp and fin) as fin_count, count(*) filter (where is_tcp and psh) as psh_count, count(*) filter (where is_tcp and urg) as urg_count,
  {big(f'sum(case when is_tcp then (syn and fin)::int + (syn and rst)::int + (fin and psh and urg)::int + ({none})::int else 0 end)')} as invalid_flags_count,
  bool_or(is_tcp and syn and fin) as has_syn_fin, bool_or(is_tcp and syn and rst) as has_syn_rst, bool_or(is_tcp and {none}) as has_null_flags,
  bool_or(is_tcp and fin and psh and urg) as has_xmas_flags,
  case when last(is_tcp and fin order by ts, pkt_id) then 'FIN' when last(is_tcp and rst order by ts, pkt_id) then 'RST' else 'TIMEOUT' end as closed_reason
  from split group by flow_key, flow_seq)"""


FLOW_COUNTS = (
    "packet_count", "total_bytes", "fwd_packets", "bwd_packets", "fwd_bytes", "bwd_bytes", "syn_count", "ack_count", "rst_count", "fin_count",
    "psh_count", "urg_count", "invalid_flags_count",
)
FLOW_MEANS = ("duration_s", "length_mean", "length_std", "fwd_packet_length_mean", "bwd_packet_length_mean")
FLOW_FLAGS = ("has_syn_fin", "has_syn_rst", "has_null_flags", "has_xmas_flags")


@BOOK.query("w1_flow_split", f"{split_sql(IDLE_S)} select pkt_id, flow_key, is_forward, {big('flow_seq')} as flow_seq from split")
def _(spark, d):
    return flows.flow_split(packets(spark, d), IDLE_S, None).select("pkt_id", "flow_key", "is_forward", "flow_seq")


@BOOK.query("a1_flow_aggregate", f"""{flows_sql(IDLE_S)} select flow_key, flow_seq, src_ip, dst_ip, {big('dst_port')} as dst_port, {big('protocol')} as protocol, epoch_us(start_ts) as start_us, epoch_us(last_ts) as last_us,
 {', '.join(FLOW_COUNTS)}, {', '.join(f'{rnd(c)} as {c}' for c in FLOW_MEANS)}, {', '.join(FLOW_FLAGS)}, closed_reason from flows""")
def _(spark, d):
    got = flows.assemble_flows(packets(spark, d), IDLE_S, None)
    return rounded(got.select(
        "flow_key", "flow_seq", "src_ip", "dst_ip", "dst_port", "protocol", F.unix_micros("start_ts").alias("start_us"), F.unix_micros("last_ts").alias("last_us"),
        *FLOW_COUNTS, *FLOW_MEANS, *FLOW_FLAGS, "closed_reason",
    ))


@BOOK.query("x2_flow_stream_max_life", f"""{cte('packets').replace('with ', 'with recursive ', 1)},
ports as (select *, case when protocol in (6, 17) then src_port else 0 end as sp, case when protocol in (6, 17) then dst_port else 0 end as dp from packets),
dirs as (select *, src_ip < dst_ip or (src_ip = dst_ip and sp <= dp) as fwd from ports),
keyed as (select pkt_id, epoch_us(ts) as us, is_tcp and (fin or rst) as ends, case when fwd then concat(src_ip, ':', sp, '<->', dst_ip, ':', dp, '/', protocol) else concat(dst_ip, ':', dp, '<->', src_ip, ':', sp, '/', protocol) end as flow_key from dirs),
ranked as (select *, row_number() over (partition by flow_key order by us, pkt_id) as rn from keyed),
walk as (select flow_key, rn, pkt_id, us, ends, us as start, 1 as flow_seq from ranked where rn = 1
 union all select r.flow_key, r.rn, r.pkt_id, r.us, r.ends,
  case when w.ends or r.us - w.us > {int(WIDE_S * 1_000_000)} or r.us - w.start > {int(LIFE_S * 5 * 1_000_000)} then r.us else w.start end,
  w.flow_seq + case when w.ends or r.us - w.us > {int(WIDE_S * 1_000_000)} or r.us - w.start > {int(LIFE_S * 5 * 1_000_000)} then 1 else 0 end
 from walk w join ranked r on r.flow_key = w.flow_key and r.rn = w.rn + 1)
select pkt_id, flow_key, {big('flow_seq')} as flow_seq from walk""")
def _(spark, d):
    return flows.flow_split(packets(spark, d), WIDE_S, LIFE_S * 5).select("pkt_id", "flow_key", "flow_seq")


@BOOK.query("x11_close_reasons", f"""{flows_sql(IDLE_S)}, nx as (select *, lead(start_ts) over (partition by flow_key order by flow_seq) as next_ts, max(last_ts) over () as end_ts from flows),
r as (select *, case when closed_reason <> 'TIMEOUT' then closed_reason when next_ts is not null and epoch_us(next_ts) - epoch_us(last_ts) <= {int(IDLE_S * 1e6)} then 'MAX_DURATION'
 when next_ts is null and epoch_us(end_ts) - epoch_us(last_ts) <= {int(IDLE_S * 1e6)} then 'FLUSH' else 'TIMEOUT' end as reason from nx)
select reason as closed_reason, count(*) as flows, {big('sum(packet_count)')} as packets, {big('sum(total_bytes)')} as bytes from r group by reason""")
def _(spark, d):
    got = flows.assemble_flows(packets(spark, d), IDLE_S, None)
    return flows.close_reasons(flows.with_close_reasons(got, IDLE_S))


@BOOK.query("x11_peak_active_flows", f"""{flows_sql(IDLE_S)}, s as (select epoch_us(start_ts) as us, 1 as step from flows union all select epoch_us(last_ts) + 1, -1 from flows),
p as (select us, sum(step) as step from s group by us), c as (select sum(step) over (order by us) as level from p) select {big('max(level)')} as peak_active_flows from c""")
def _(spark, d):
    return flows.concurrency(flows.assemble_flows(packets(spark, d), IDLE_S, None))


@BOOK.query("a26_traffic_rates", f"""{flows_sql(IDLE_S)}, p as (select count(*) as packets, {big('sum(packet_length)')} as bytes, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0 as elapsed_s from packets), f as (select count(*) as flows from flows)
select packets, bytes, flows, {rnd('elapsed_s')} as elapsed_s, {rnd('packets / elapsed_s')} as packets_per_s, {rnd('flows / elapsed_s')} as flows_per_s, {rnd('bytes / elapsed_s')} as bytes_per_s from p, f""")
def _(spark, d):
    p = packets(spark, d)
    return rounded(flows.traffic_rates(p, flows.assemble_flows(p, IDLE_S, None)))


@BOOK.query("a26_traffic_types", f"""{cte('packets')} select case protocol when 6 then 'TCP' when 17 then 'UDP' when 1 then 'ICMP' else 'OTHER' end as traffic_type, count(*) as packets, {big('sum(packet_length)')} as bytes from packets group by 1""")
def _(spark, d):
    return flows.traffic_types(packets(spark, d))


@BOOK.query("w2_inter_flow_delta", f"""{flows_sql(IDLE_S)}, g as (select *, (epoch_us(start_ts) - epoch_us(lag(start_ts) over (partition by src_ip order by start_ts, flow_key, flow_seq))) / 1000000.0 as gap from flows)
select flow_key, flow_seq, {rnd('greatest(least(coalesce(gap, 0), 300), 0)')} as inter_flow_delta_s from g""")
def _(spark, d):
    got = flows.inter_flow_delta(flows.assemble_flows(packets(spark, d), IDLE_S, None))
    return rounded(got.select("flow_key", "flow_seq", "inter_flow_delta_s"))


@BOOK.query("f11_flow_iat", f"""{split_sql(IDLE_S)}, g as (select flow_key, flow_seq, (epoch_us(ts) - epoch_us(lag(ts) over (partition by flow_key, flow_seq order by ts, pkt_id))) / 1000.0 as gap from split)
select flow_key, {big('flow_seq')} as flow_seq, {rnd('coalesce(avg(gap), 0)', 3)} as flow_iat_mean_ms, {rnd('coalesce(stddev_pop(gap), 0)', 3)} as flow_iat_std_ms from g group by all""")
def _(spark, d):
    return rounded(flows.flow_iat(flows.flow_split(packets(spark, d), IDLE_S, None), IDLE_S), 3)


TEN = ("flow_duration_ms", "flow_packets_per_s", "flow_bytes_per_s", "packet_length_mean", "packet_length_std", "syn_ack_ratio")


@BOOK.query("f1_f10_flow_contract", f"""{flows_sql(IDLE_S)} select flow_key, flow_seq, {rnd('duration_s * 1000', 3)} as flow_duration_ms, {rnd('packet_count / greatest(duration_s, 0.000001)', 3)} as flow_packets_per_s,
 {rnd('total_bytes / greatest(duration_s, 0.000001)', 3)} as flow_bytes_per_s, {rnd('length_mean', 3)} as packet_length_mean, {rnd('length_std', 3)} as packet_length_std,
 {rnd('syn_count / greatest(ack_count, 1)', 3)} as syn_ack_ratio, syn_count, ack_count, rst_count, fin_count from flows""")
def _(spark, d):
    got = feats.flow_contract(flows.assemble_flows(packets(spark, d), IDLE_S, None))
    return rounded(got.select("flow_key", "flow_seq", *TEN, "syn_count", "ack_count", "rst_count", "fin_count"), 3)


@BOOK.query("f17_flowseq_contract", f"""{flows_sql(IDLE_S)}, g as (select *, (epoch_us(start_ts) - epoch_us(lag(start_ts) over (partition by src_ip order by start_ts, flow_key, flow_seq))) / 1000000.0 as gap from flows)
select flow_key, flow_seq, {rnd('duration_s * 1000', 3)} as flow_duration_ms, {rnd('packet_count / greatest(duration_s, 0.000001)', 3)} as flow_packets_per_s, {rnd('least(syn_count, 1)', 3)} as syn_count, {rnd('least(ack_count, 1)', 3)} as ack_count,
 {rnd('least(rst_count, 1)', 3)} as rst_count, {rnd('least(fin_count, 1)', 3)} as fin_count, {rnd('least(syn_count, 1) / greatest(least(ack_count, 1), 1)', 3)} as syn_ack_ratio, {rnd('greatest(least(coalesce(gap, 0), 300), 0)', 3)} as inter_flow_delta_s from g""")
def _(spark, d):
    got = flows.inter_flow_delta(flows.assemble_flows(packets(spark, d), IDLE_S, None))
    out = feats.sequence_contract(feats.flow_contract(got))
    keep = ("flow_duration_ms", "flow_packets_per_s", "syn_count", "ack_count", "rst_count", "fin_count", "syn_ack_ratio", "inter_flow_delta_s")
    return rounded(out.select("flow_key", "flow_seq", *keep), 3)


# ---- features of file flows ----------------------------------------------------------------------

SEMANTIC = f"""{cte('raw_flows')}, sem as (select row_id, duration_us * 0.000001 as dur, fwd_packets::double as fp, bwd_packets::double as bp, fwd_bytes as fb, bwd_bytes as bb from raw_flows),
tot as (select *, fp + bp as tp, fb + bb as tb from sem)"""
MAPPING = {
    "duration_seconds": ("duration_us", 0.000001), "total_fwd_packets": ("fwd_packets", 1.0), "total_bwd_packets": ("bwd_packets", 1.0),
    "fwd_bytes": ("fwd_bytes", 1.0), "bwd_bytes": ("bwd_bytes", 1.0),
}
FILE_RATIOS = {"pkt_len_mean": (("fwd_bytes", "bwd_bytes"), ("fwd_packets", "bwd_packets"))}


def semantic(spark: SparkSession, d: str) -> DataFrame:
    return feats.derived_totals(feats.semantic_project(view(spark, d, "raw_flows"), MAPPING, FILE_RATIOS, keep=["row_id"]))


def safe(c: str) -> str:
    """Not-a-number and infinity as text-free markers, so that both engines hash the same value."""
    return f"case when isnan({c}) then -1 when isinf({c}) then -2 else {c} end"


def marked(*names: str):
    out = []
    for n in names:
        c = F.col(n)
        out.append(F.when(F.isnan(c), F.lit(-1.0)).when(F.abs(c) == float("inf"), F.lit(-2.0)).otherwise(c).alias(n))
    return out


@BOOK.query("p2_p4_semantic_project", f"""{SEMANTIC} select row_id, {rnd('dur')} as duration_seconds, {rnd('fp')} as total_fwd_packets, {rnd('bp')} as total_bwd_packets, {rnd(safe('fb'))} as fwd_bytes, {rnd('bb')} as bwd_bytes,
 {rnd('tp')} as total_packets, {rnd(safe('tb'))} as total_bytes, {rnd(safe('tb / nullif(tp, 0)'))} as pkt_len_mean from tot""")
def _(spark, d):
    names = ("duration_seconds", "total_fwd_packets", "total_bwd_packets", "fwd_bytes", "bwd_bytes", "total_packets", "total_bytes", "pkt_len_mean")
    return rounded(semantic(spark, d).select("row_id", *marked(*names)))


@BOOK.query("f1_f15_file_features", f"""{SEMANTIC}, f as (select row_id, dur * 1000 as flow_duration_ms, case when dur > 0 then tp / dur when tp = 0 then 0 end as flow_packets_per_s,
 case when dur > 0 then tb / dur when tb = 0 then 0 end as flow_bytes_per_s, tb / nullif(tp, 0) as packet_length_mean, bp / greatest(fp, 1) as down_up_ratio, tb / greatest(tp, 1) as flow_bytes_per_packet from tot)
select row_id, {', '.join(f'{rnd(safe(c))} as {c}' for c in ('flow_duration_ms', 'flow_packets_per_s', 'flow_bytes_per_s', 'packet_length_mean', 'down_up_ratio', 'flow_bytes_per_packet'))} from f""")
def _(spark, d):
    names = ["flow_duration_ms", "flow_packets_per_s", "flow_bytes_per_s", "packet_length_mean", "down_up_ratio", "flow_bytes_per_packet"]
    got = feats.compute_features(semantic(spark, d), names, keep=["row_id"])
    return rounded(got.select("row_id", *marked(*names)))


PASSED = {
    "pkt_len_mean": "l_quantity", "pkt_len_std": "l_tax", "syn_flags": "l_linenumber", "ack_flags": "l_linenumber", "rst_flags": "l_linenumber",
    "fin_flags": "l_linenumber", "fwd_pkt_len_mean": "l_quantity", "bwd_pkt_len_mean": "l_discount", "active_mean_s": "l_tax", "idle_mean_s": "l_discount",
    "subflow_fwd_bytes": "l_quantity", "subflow_bwd_bytes": "l_tax", "flow_iat_mean_s": "l_discount", "flow_iat_std_s": "l_tax",
}
PASS_NAMES = [
    "packet_length_mean", "packet_length_std", "syn_count", "ack_count", "rst_count", "fin_count", "syn_ack_ratio", "flow_iat_mean_ms", "flow_iat_std_ms",
    "fwd_packet_length_mean", "bwd_packet_length_mean", "active_mean_ms", "idle_mean_ms", "subflow_fwd_bytes", "subflow_bwd_bytes",
]


@BOOK.query("f4_f16_passed_features", f"""{cte('scored')} select row_id, {rnd('l_quantity')} as packet_length_mean, {rnd('l_tax')} as packet_length_std, {rnd('l_linenumber')} as syn_count, {rnd('l_linenumber')} as ack_count,
 {rnd('l_linenumber')} as rst_count, {rnd('l_linenumber')} as fin_count, {rnd('l_linenumber / greatest(l_linenumber, 1)')} as syn_ack_ratio, {rnd('l_discount * 1000')} as flow_iat_mean_ms, {rnd('l_tax * 1000')} as flow_iat_std_ms,
 {rnd('l_quantity')} as fwd_packet_length_mean, {rnd('l_discount')} as bwd_packet_length_mean, {rnd('l_tax * 1000')} as active_mean_ms, {rnd('l_discount * 1000')} as idle_mean_ms, {rnd('l_quantity')} as subflow_fwd_bytes, {rnd('l_tax')} as subflow_bwd_bytes from scored""")
def _(spark, d):
    df = feats.semantic_project(view(spark, d, "scored"), {k: (v, 1.0) for k, v in PASSED.items()}, keep=["row_id"])
    return rounded(feats.compute_features(df, PASS_NAMES, keep=["row_id"]))


# ---- rules ---------------------------------------------------------------------------------------

R = cte("flow_rows")
HIT = "rule_id, name, severity, matched_value"
SQL_RULES = {
    "r1_invalid_flags": """select row_id, 'RULE-TCP-INVALID-FLAGS' as rule_id,
 case when has_syn_fin then 'TCP Invalid Flags (SYN+FIN)' when has_syn_rst then 'TCP Invalid Flags (SYN+RST)' when has_xmas_flags then 'TCP Xmas Scan Flags' when has_null_flags then 'TCP NULL Scan Flags' else 'TCP Invalid Flag Anomaly' end as name, 'HIGH' as severity,
 case when has_syn_fin then 'SYN+FIN' when has_syn_rst then 'SYN+RST' when has_xmas_flags then 'FIN+PSH+URG' when has_null_flags then 'NULL (flags=0)' else concat('invalid_flags_count=', invalid_flags_count) end as matched_value
 from flow_rows where protocol = 6 and (has_syn_fin or has_syn_rst or has_xmas_flags or has_null_flags or invalid_flags_count > 0)""",
    "r2_syn_flood": """select row_id, 'RULE-SYN-FLOOD' as rule_id, case when syn_count >= 20 and ack_count = 0 then 'TCP SYN Flood (Zero ACK)' else 'TCP SYN Flood (High SYN/ACK Ratio)' end as name, 'HIGH' as severity,
 concat('syn_count=', syn_count, ', ack_count=', ack_count, case when syn_count >= 20 and ack_count = 0 then '' else concat(', ratio=', format('{:.2f}', syn_count / greatest(ack_count, 1))) end) as matched_value
 from flow_rows where protocol = 6 and ((syn_count >= 20 and ack_count = 0) or (syn_count >= 10 and syn_count / greatest(ack_count, 1) >= 10))""",
    "r3_port_probe": """select row_id, 'RULE-PORT-SCAN' as rule_id, case when syn_count >= 5 and total_bytes <= 250 then 'TCP Single-Flow Port Probe' else 'TCP Unanswered Port Probe' end as name, 'MEDIUM' as severity,
 case when syn_count >= 5 and total_bytes <= 250 then concat('syn_count=', syn_count, ', total_bytes=', total_bytes) else concat('syn_count=', syn_count, ', ack_count=0, total_bytes=', total_bytes) end as matched_value
 from flow_rows where protocol = 6 and ((syn_count >= 5 and total_bytes <= 250) or (syn_count >= 3 and ack_count = 0 and total_bytes <= 180))""",
    "r4_high_rate": """select row_id, 'RULE-HIGH-RATE-BURST' as rule_id, case when packet_count / greatest(duration_s, 0.000001) >= 50000 then 'High Volumetric Packet Rate Burst' else 'High Volumetric Byte Rate Burst' end as name, 'HIGH' as severity,
 cast(null as varchar) as matched_value from flow_rows where packet_count >= 10 and (packet_count / greatest(duration_s, 0.000001) >= 50000 or total_bytes / greatest(duration_s, 0.000001) >= 50000000)""",
    "r5_spoofed_source": """select row_id, 'RULE-IP-SPOOF-RESERVED' as rule_id, case when trim(src_ip) in ('0.0.0.0', '255.255.255.255') then 'Reserved/Broadcast Source IP on TCP' else 'Cross-Interface Loopback Spoofing' end as name, 'HIGH' as severity,
 case when trim(src_ip) in ('0.0.0.0', '255.255.255.255') then concat('src_ip=', trim(src_ip)) else concat('src_ip=', trim(src_ip), ', dst_ip=', trim(dst_ip)) end as matched_value
 from flow_rows where (protocol = 6 and trim(src_ip) in ('0.0.0.0', '255.255.255.255')) or (trim(src_ip) like '127.%' and trim(dst_ip) not like '127.%')""",
    "r6_icmp_flood": """select row_id, 'RULE-ICMP-FLOOD' as rule_id, case when packet_count >= 20 then 'ICMP Burst / Flood' else 'ICMP High-Rate Echo Burst' end as name, 'MEDIUM' as severity,
 case when packet_count >= 20 then concat('packet_count=', packet_count, ', protocol=ICMP') end as matched_value
 from flow_rows where protocol = 1 and (packet_count >= 20 or (packet_count >= 10 and packet_count / greatest(duration_s, 0.000001) >= 20))""",
}
#: Values that hold a rate are compared without their text, whose rounding is the engine's own.
RATE_TEXT = {"r4_high_rate": ("High Volumetric Packet Rate Burst", "High Volumetric Byte Rate Burst"), "r6_icmp_flood": ("ICMP High-Rate Echo Burst",)}
RULES = {
    "r1_invalid_flags": rules.invalid_flags, "r2_syn_flood": rules.syn_flood, "r3_port_probe": rules.port_probe, "r4_high_rate": rules.high_rate,
    "r5_spoofed_source": rules.spoofed_source, "r6_icmp_flood": rules.icmp_flood,
}


def _rule(name: str):
    def run(spark, d):
        hits = view(spark, d, "flow_rows").select("row_id", RULES[name]().alias("m")).filter("m is not null").select("row_id", "m.*")
        silent = RATE_TEXT.get(name, ())
        return hits.withColumn("matched_value", F.when(~F.col("name").isin(*silent), F.col("matched_value")) if silent else F.col("matched_value"))

    return run


for _name, _sql in SQL_RULES.items():
    BOOK.query(_name, f"{R} {_sql}")(_rule(_name))

ORDERED = ("r1_invalid_flags", "r2_syn_flood", "r3_port_probe", "r4_high_rate", "r5_spoofed_source", "r6_icmp_flood")
ALL_HITS = f"{R}, hits as (" + " union all ".join(f"select row_id, rule_id, severity, {i} as pos from ({SQL_RULES[n]})" for i, n in enumerate(ORDERED)) + "), per as (select row_id, string_agg(rule_id, ',' order by pos) as ids, bool_or(severity = 'HIGH') as high, bool_or(severity = 'MEDIUM') as medium from hits group by row_id)"


def matched(spark, d):
    return rules.collect_matches(view(spark, d, "flow_rows"))


@BOOK.query("r9_collect_matches", f"{ALL_HITS} select f.row_id, coalesce(ids, '') as rule_ids from flow_rows f left join per on per.row_id = f.row_id")
def _(spark, d):
    return matched(spark, d).select("row_id", F.array_join(F.transform("rule_matches", lambda m: m["rule_id"]), ",").alias("rule_ids"))


VERDICT = f"""{ALL_HITS}, v as (select f.row_id, greatest(least(score, 1.0), 0.0) as p, score as raw, ids is not null as rule, coalesce(high, false) as high, coalesce(medium, false) as medium from flow_rows f left join per on per.row_id = f.row_id)"""


@BOOK.query("r11_hybrid_verdict", f"""{VERDICT} select row_id, case when p >= 0.5 or rule then 'ATTACK' else 'BENIGN' end as verdict,
 case when p >= 0.5 and rule then 'HYBRID' when rule then 'RULE' when p >= 0.5 then 'RF' else 'NONE' end as detection_source,
 {rnd('greatest(p, case when high then 0.85 when medium then 0.65 else 0 end)')} as threat_score,
 case when high or p >= 0.85 then 'HIGH' when medium or p >= 0.65 then 'MEDIUM' when p >= 0.5 or rule then 'LOW' else 'INFORMATIONAL' end as severity from v""")
def _(spark, d):
    return rounded(rules.hybrid_verdict(matched(spark, d)).select("row_id", "verdict", "detection_source", "threat_score", "severity"))


@BOOK.query("r10_alert_rows", f"""{VERDICT} select row_id, {rnd('greatest(raw, case when high then 0.85 when rule then 0.65 else 0 end)')} as threat_score,
 case when raw >= 0.85 or high then 'HIGH' when raw >= 0.65 or medium then 'MEDIUM' else 'LOW' end as level, case when raw >= 0.65 and rule then 'HYBRID' when rule then 'RULE' else 'MODEL' end as alert_source
 from v where raw >= 0.65 or rule""")
def _(spark, d):
    return rounded(rules.alert_rows(matched(spark, d)).select("row_id", "threat_score", "level", "alert_source"))


@BOOK.query("r8_rules_from_features", f"""{R}, x as (select row_id, case when (syn_count >= 20 and ack_count = 0) or (syn_count >= 10 and (syn_count / greatest(ack_count, 1) >= 10)) then 'RULE-SYN-FLOOD' end as a,
 case when syn_count >= 5 and l <= 60 and ack_count = 0 then 'RULE-PORT-SCAN' end as b, case when has_syn_fin or has_syn_rst then 'RULE-TCP-INVALID-FLAGS' end as c, case when protocol = 1 and packet_count >= 20 then 'RULE-ICMP-FLOOD' end as e, protocol
 from (select *, total_bytes / packet_count as l from flow_rows))
select row_id, concat_ws(',', a, b, c, e) as rule_ids, case when protocol <> 1 then 'RULE-HIGH-RATE-BURST,RULE-ICMP-FLOOD,RULE-IP-SPOOF-RESERVED,RULE-PORT-SCAN-MULTI-FLOW' else 'RULE-HIGH-RATE-BURST,RULE-IP-SPOOF-RESERVED,RULE-PORT-SCAN-MULTI-FLOW' end as unavailable_rules,
 'dst_port,flow_bytes_per_s,flow_packets_per_s,src_ip/dst_ip' as unavailable_features from x""")
def _(spark, d):
    df = view(spark, d, "flow_rows").withColumn("packet_length_mean", F.col("total_bytes") / F.col("packet_count"))
    df = df.select("row_id", "protocol", "syn_count", "ack_count", "packet_length_mean", "packet_count", "has_syn_fin", "has_syn_rst")
    got = rules.rules_from_features(df)
    ids = F.array_join(F.transform("rule_matches", lambda m: m["rule_id"]), ",")
    return got.select("row_id", ids.alias("rule_ids"), F.array_join("unavailable_rules", ",").alias("unavailable_rules"), F.array_join("unavailable_features", ",").alias("unavailable_features"))


@BOOK.query("r12_drop_unavailable", f"""{ALL_HITS}, left_over as (select row_id, string_agg(rule_id, ',' order by pos) as ids from hits where rule_id in ('RULE-SYN-FLOOD', 'RULE-IP-SPOOF-RESERVED', 'RULE-TCP-INVALID-FLAGS', 'RULE-ICMP-FLOOD') group by row_id)
select f.row_id, coalesce(ids, '') as rule_ids from flow_rows f left join left_over h on h.row_id = f.row_id""")
def _(spark, d):
    got = rules.drop_unavailable(matched(spark, d))
    return got.select("row_id", F.array_join(F.transform("rule_matches", lambda m: m["rule_id"]), ",").alias("rule_ids"))


@BOOK.query("r12_user_rules", f"""{R} select row_id, concat_ws(',', case when syn_count > 40 then 'U1' end, case when src_ip = '10.0.0.7' and total_bytes > 900 then 'U2' end) as rule_ids from flow_rows""")
def _(spark, d):
    table = [("U1", "many SYN", "LOW", "syn_count > 40"), ("U2", "large", "HIGH", "src_ip = '10.0.0.7' and total_bytes > 900")]
    got = rules.apply_rule_table(view(spark, d, "flow_rows"), table)
    return got.select("row_id", F.array_join(F.transform("rule_matches", lambda m: m["rule_id"]), ",").alias("rule_ids"))


@BOOK.query("flagship_hits_per_source", f"""{flows_sql(WIDE_S)}, hits as (select src_ip, (case when protocol = 6 and (has_syn_fin or has_syn_rst or has_xmas_flags or has_null_flags or invalid_flags_count > 0) then 1 else 0 end)
 + (case when protocol = 6 and ((syn_count >= 20 and ack_count = 0) or (syn_count >= 10 and syn_count / greatest(ack_count, 1) >= 10)) then 1 else 0 end)
 + (case when protocol = 6 and ((syn_count >= 5 and total_bytes <= 250) or (syn_count >= 3 and ack_count = 0 and total_bytes <= 180)) then 1 else 0 end)
 + (case when packet_count >= 10 and (packet_count / greatest(duration_s, 0.000001) >= 50000 or total_bytes / greatest(duration_s, 0.000001) >= 50000000) then 1 else 0 end)
 + (case when protocol = 1 and (packet_count >= 20 or (packet_count >= 10 and packet_count / greatest(duration_s, 0.000001) >= 20)) then 1 else 0 end) as n from flows)
select src_ip, count(*) as flows, count(*) filter (where n > 0) as flagged, {big('sum(n)')} as rule_hits from hits group by src_ip""")
def flagship(spark, d):
    """Packets to flows to rules to hits per source."""
    got = rules.collect_matches(flows.assemble_flows(packets(spark, d), WIDE_S, None))
    n = F.size("rule_matches")
    return got.groupBy("src_ip").agg(F.count("*").alias("flows"), F.count_if(n > 0).alias("flagged"), F.sum(n).cast("long").alias("rule_hits"))


# ---- sequences -----------------------------------------------------------------------------------


def session_sql(gap_s: int, reset: str) -> str:
    return f"""{cte('scored_events')}, m as (select *, case when lag(ts) over w is null or epoch_us(ts) - epoch_us(lag(ts) over w) > {gap_s * 1_000_000} or {reset} then 1 else 0 end as new from scored_events window w as (partition by host_id order by ts, seq)),
s as (select *, sum(new) over (partition by host_id order by ts, seq rows between unbounded preceding and current row) as session_seq from m),
r as (select *, row_number() over (partition by host_id, session_seq order by ts, seq) as rn, list(score) over (partition by host_id, session_seq order by ts, seq rows between 4 preceding and current row) as l,
 max(y) over (partition by host_id, session_seq order by ts, seq rows between 4 preceding and current row) as any_y, avg(y) over (partition by host_id, session_seq order by ts, seq rows between 4 preceding and current row) as mean_y from s)"""


GAP = 172_800


@BOOK.query("w3_sequence_windows", f"""{session_sql(10**9, 'false')} select host_id, seq, rn, {big('y')} as label, {rnd('list_sum(l)')} as total from r where rn >= 5 and (rn - 5) % 2 = 0""")
def _(spark, d):
    df = view(spark, d, "scored_events")
    got = sequences.sequence_windows(df, ["host_id"], ["ts", "seq"], ordered.time_chunk("ts", ordered.DAY), ["score"], stride=2)
    total = F.aggregate("sequence", F.lit(0.0), lambda a, x: a + x["score"])
    return rounded(got.select("host_id", "seq", "rn", "label", total.alias("total")))


@BOOK.query("w4_host_session_sequences", f"""{session_sql(GAP, 'k % 25 = 0')} select host_id, {big('session_seq')} as session_seq, seq, rn, {big('any_y')} as label, {rnd('list_sum(l)')} as total from r where rn >= 5""")
def _(spark, d):
    df = view(spark, d, "scored_events").withColumn("reset", F.col("k") % 25 == 0)
    got = sequences.host_session_sequences(df, "host_id", "ts", "seq", ["score"], gap_s=float(GAP), reset="reset", label_rule="any")
    total = F.aggregate("sequence", F.lit(0.0), lambda a, x: a + x["score"])
    return rounded(got.select("host_id", "session_seq", "seq", "rn", "label", total.alias("total")))


@BOOK.query("w5_seq_status", f"""{session_sql(GAP, 'false')} select host_id, {big('session_seq')} as session_seq, count(*) filter (where rn < 5) as warm_up, count(*) filter (where rn >= 5) as aligned from r group by all""")
def _(spark, d):
    df = sequences.host_sessions(view(spark, d, "scored_events"), "host_id", "ts", "seq", float(GAP))
    keys = ["host_id", "session_seq"]
    return sequences.status_counts(sequences.sequence_status(df, keys, ["ts", "seq"], ordered.time_chunk("ts", ordered.DAY)), keys)
