"""Per-source correlation on events and packets: W10, W11, X3, X4, X5, X10, R7, A29, J11."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake.operators import hosts, rules
from flowlake.queries.book import Book, big
from flowlake.sources.views import cte, table, view

BOOK = Book()
WINDOW_S, COOLDOWN_S, DEDUP_S = 172_800.0, 86_400.0, 43_200.0
SCAN = {"window_s": 259_200.0, "min_ports": 5, "min_probes": 6}
E = cte("scored_events")


def scored(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "scored_events").withColumn("suspicious", F.col("score") >= 0.3)


COUNTED = f"""e as (select *, epoch_us(ts) as us, score >= 0.3 as suspicious from scored_events),
counted as (select a.host_id, a.seq, a.us, count(*) filter (where b.suspicious) as n from e a join e b on a.host_id = b.host_id and b.us >= a.us - {int(WINDOW_S * 1e6)}
 and (b.us < a.us or (b.us = a.us and b.seq <= a.seq)) group by a.host_id, a.seq, a.us)"""


@BOOK.query("w10_suspicious_count", f"{E}, {COUNTED} select seq, n as suspicious_count from counted")
def _(spark, d):
    return hosts.suspicious_count(scored(spark, d), "host_id", "ts", "seq", "suspicious", WINDOW_S).select("seq", "suspicious_count")


def leaders(source: str, keys: str, gap_us: int) -> str:
    """Walk the rows of a key in order; a row leads when the last leader is at least the gap away."""
    on = " and ".join(f"r.{k.strip()} = w.{k.strip()}" for k in keys.split(","))
    cols = ", ".join(f"r.{k.strip()}" for k in keys.split(","))
    return f"""ranked as (select *, row_number() over (partition by {keys} order by us, seq) as rn from {source}),
walk as (select {keys}, seq, us, rn, us as last_us, true as leads from ranked where rn = 1
 union all select {cols}, r.seq, r.us, r.rn, case when r.us - w.last_us >= {gap_us} then r.us else w.last_us end, r.us - w.last_us >= {gap_us} from walk w join ranked r on {on} and r.rn = w.rn + 1)"""


RECURSIVE = E.replace("with ", "with recursive ", 1)
ESCALATED = f"""{RECURSIVE}, {COUNTED}, met as (select * from counted where n >= 4), {leaders('met', 'host_id', int(COOLDOWN_S * 1e6))},
esc as (select c.host_id, c.seq, c.us, coalesce(w.leads, false) as escalate, case when w.seq is null then 'BELOW_THRESHOLD' when w.leads then 'THRESHOLD_MET' else 'COOLDOWN_ACTIVE' end as reason from counted c left join walk w on w.seq = c.seq)"""


def escalated(spark, d):
    return hosts.source_escalation(scored(spark, d), "host_id", "ts", "seq", "suspicious", threshold=4, window_s=WINDOW_S, cooldown_s=COOLDOWN_S)


@BOOK.query("x3_source_escalation", f"{ESCALATED} select seq, escalate, reason from esc")
def _(spark, d):
    return escalated(spark, d).select("seq", "escalate", "reason")


@BOOK.query("x3_source_summary", f"""{ESCALATED} select esc.host_id, count(*) as total_flows, count(*) filter (where e.suspicious) as total_suspicious, count(*) filter (where escalate) as escalation_count,
 max(esc.us) filter (where escalate) as last_escalation_us, max(esc.us) as last_seen_us from esc join e on e.seq = esc.seq group by esc.host_id""")
def _(spark, d):
    got = hosts.source_summary(escalated(spark, d), "host_id", "ts", "suspicious")
    return got.select(
        "host_id", "total_flows", "total_suspicious", "escalation_count", F.unix_micros("last_escalation_ts").alias("last_escalation_us"),
        F.unix_micros("last_seen_ts").alias("last_seen_us"),
    )


PROBES = f"""{cte('packets')}, p as (select src_ip, dst_ip, dst_port, epoch_us(ts) as us, pkt_id from packets where protocol = 6 and dst_port between 1 and 65535),
m as (select *, case when lag(us) over w is null or us - lag(us) over w > {int(SCAN['window_s'] * 1e6)} then 1 else 0 end as new from p window w as (partition by src_ip, dst_ip order by us, pkt_id)),
s as (select *, sum(new) over (partition by src_ip, dst_ip order by us, pkt_id rows between unbounded preceding and current row) as session_seq from m),
n as (select *, row_number() over (partition by src_ip, dst_ip, session_seq order by us, pkt_id) as probes, row_number() over (partition by src_ip, dst_ip, session_seq, dst_port order by us, pkt_id) = 1 as fresh from s),
c as (select *, sum(case when fresh then 1 else 0 end) over (partition by src_ip, dst_ip, session_seq order by us, pkt_id rows between unbounded preceding and current row) as ports from n),
h as (select *, row_number() over (partition by src_ip, dst_ip, session_seq order by us, pkt_id) as k from c where ports >= {SCAN['min_ports']} and probes >= {SCAN['min_probes']})"""


def tcp(spark, d):
    return view(spark, d, "packets").filter(F.col("protocol") == 6)


@BOOK.query("w11_vertical_port_scan", f"{PROBES} select src_ip, dst_ip, {big('session_seq')} as session_seq, us, pkt_id as probe_id, {big('ports')} as unique_ports from h where k = 1")
def _(spark, d):
    got = hosts.vertical_scans(tcp(spark, d), "ts", "pkt_id", **SCAN)
    return got.select("src_ip", "dst_ip", "session_seq", F.unix_micros("ts").alias("us"), "probe_id", "unique_ports")


#: The correlator as a recursive walk over the probes of a source, its destinations as a list of records.
_W, _PORTS, _PROBES = int(SCAN["window_s"] * 1e6), SCAN["min_ports"], SCAN["min_probes"]
SCAN_SQL = f"""{cte('packets').replace('with ', 'with recursive ', 1)},
probes as (select src_ip, dst_ip, dst_port, epoch_us(ts) as us, pkt_id, row_number() over (partition by src_ip order by ts, pkt_id) as rn from packets where protocol = 6 and dst_port between 1 and 65535),
walk as (
 select src_ip, 0::bigint as rn, 0::bigint as us, 0::bigint as pkt_id, ''::varchar as dst_ip, []::struct(dst varchar, last bigint, n bigint, done boolean, ports integer[])[] as targets, 0::bigint as total, false as alerted,
  null::varchar as scan_type, 0::bigint as unique_ports, 0::bigint as live from probes where rn = 1
 union all
 select src_ip, rn, us, pkt_id, dst_ip, list_append(others, {{'dst': dst_ip, 'last': us, 'n': n, 'done': done or vertical, 'ports': ports}}), total, alerted or spread,
  case when vertical then 'VERTICAL' when spread then 'DISTRIBUTED' end, case when vertical then len(ports) else len(every) end, len(others) + 1
 from (select *, not vertical and not alerted and len(every) >= {_PORTS} and total >= {_PROBES} as spread
  from (select *, not done and len(ports) >= {_PORTS} and n >= {_PROBES} as vertical, list_distinct(list_concat(flatten(list_transform(others, lambda t: t.ports)), ports)) as every
   from (select *, list_filter(kept, lambda t: t.dst <> dst_ip) as others, coalesce(mine.n, 0) + 1 as n, coalesce(mine.done, false) as done, list_distinct(list_append(coalesce(mine.ports, []::integer[]), dst_port)) as ports
    from (select *, list_filter(kept, lambda t: t.dst = dst_ip)[1] as mine, case when len(kept) = 0 then 0 else held end + 1 as total, case when len(kept) = 0 then false else was end as alerted
     from (select r.src_ip, r.rn, r.us, r.pkt_id, r.dst_ip, r.dst_port, w.total as held, w.alerted as was, list_filter(w.targets, lambda t: t.last >= r.us - {_W}) as kept
      from walk w join probes r on r.src_ip = w.src_ip and r.rn = w.rn + 1))))))"""


@BOOK.query("x4_distributed_port_scan", f"{SCAN_SQL} select src_ip, us, pkt_id as probe_id, unique_ports, live as targets from walk where scan_type = 'DISTRIBUTED'")
def _(spark, d):
    got = hosts.distributed_scans(tcp(spark, d), "ts", "pkt_id", **SCAN)
    return got.select("src_ip", F.unix_micros("ts").alias("us"), "probe_id", "unique_ports", "targets")


@BOOK.query("r7_multi_flow_scan", f"""{SCAN_SQL} select pkt_id, scan_type, 'RULE-PORT-SCAN-MULTI-FLOW' as rule_id, 'HIGH' as severity,
 'unique_ports=' || unique_ports || ', target=' || case when scan_type = 'VERTICAL' then dst_ip else live || ' targets (subnet scan)' end as matched_value from walk where scan_type is not null""")
def _(spark, d):
    got = hosts.scan_columns(view(spark, d, "packets"), "pkt_id", "ts", **SCAN)
    return got.withColumn("m", rules.multi_flow()).filter("m is not null").select("pkt_id", "scan_type", "m.rule_id", "m.severity", "m.matched_value")


PAIRS = f"{RECURSIVE}, a as (select host_id, k % 3 as target, seq, epoch_us(ts) as us from scored_events where score >= 0.3), {leaders('a', 'host_id, target', int(DEDUP_S * 1e6))}"


@BOOK.query("x10_alert_dedup", f"{PAIRS} select seq, not leads as deduplicated from walk")
def _(spark, d):
    alerts = scored(spark, d).filter("suspicious").withColumn("target", F.col("k") % 3)
    return hosts.alert_dedup(alerts, ["host_id", "target"], "ts", "seq", DEDUP_S).select("seq", "deduplicated")


DAY_US = 86_400_000_000


@BOOK.query("x5_tumbling_counts", f"{E} select host_id, epoch_us(ts) // {DAY_US} * {DAY_US} as window_start_us, count(*) as n from scored_events group by all")
def _(spark, d):
    got = hosts.tumbling_counts(view(spark, d, "scored_events"), "host_id", "ts", "1 day")
    return got.select("host_id", F.unix_micros("window_start").alias("window_start_us"), "n")


@BOOK.query("x5_sliding_counts", f"{E} select host_id, (epoch_us(ts) // {DAY_US} - back) * {DAY_US} as window_start_us, count(*) as n from scored_events, range(2) t(back) group by all")
def _(spark, d):
    got = hosts.tumbling_counts(view(spark, d, "scored_events"), "host_id", "ts", "2 days", "1 day")
    return got.select("host_id", F.unix_micros("window_start").alias("window_start_us"), "n")


@BOOK.query("x5_session_counts", f"""{E}, m as (select host_id, epoch_us(ts) as us, seq, case when epoch_us(ts) - epoch_us(lag(ts) over (partition by host_id order by ts, seq)) > {DAY_US} then 1 else 0 end as new from scored_events),
s as (select *, 1 + sum(new) over (partition by host_id order by us, seq rows between unbounded preceding and current row) as session_seq from m)
select host_id, {big('session_seq')} as session_seq, min(us) as first_us, max(us) as last_us, count(*) as n from s group by all""")
def _(spark, d):
    got = hosts.session_counts(view(spark, d, "scored_events"), "host_id", "ts", "seq", 86_400.0)
    return got.select("host_id", "session_seq", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"), "n")


# frames of devices, from events: two hex digits of the user make the address
FRAMES = """frames as (select event_id as frame_id, epoch_us(ts) as us, lower(concat(lpad(to_hex(user_id % 16 * 2), 2, '0'), ':5e:00:', lpad(to_hex(user_id % 7), 2, '0'), ':00:01')) as mac,
 cast(value as bigint) as bytes, concat('10.9.0.', user_id % 11) as ip, case when event_type = 'error' then concat('host', user_id % 5) end as hostname, event_type as evidence from events)"""


def frames(spark, d):
    two = lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")
    ev = table(spark, d, "events")
    return ev.select(
        F.col("event_id").alias("frame_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.concat(two(F.col("user_id") % 16 * 2), F.lit(":5e:00:"), two(F.col("user_id") % 7), F.lit(":00:01")).alias("mac"),
        F.round("value").cast("long").alias("bytes"), F.concat(F.lit("10.9.0."), (F.col("user_id") % 11).cast("string")).alias("ip"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("host"), (F.col("user_id") % 5).cast("string"))).alias("hostname"), F.col("event_type").alias("evidence"),
    )


INVENTORY = f"""with {FRAMES.replace('cast(value as bigint)', 'cast(round(value) as bigint)')}, dev as (select mac, min(us) as first_us, max(us) as last_us, count(*) as frames, {big('sum(bytes)')} as bytes, arg_max(ip, us * 1000000 + frame_id % 1000000) as latest_ip,
 string_agg(distinct evidence, ',' order by evidence) as evidence from frames group by mac)"""


@BOOK.query("a29_device_inventory", f"{INVENTORY.replace('us * 1000000 + frame_id % 1000000', 'us * 1000 + frame_id % 1000')} select mac, first_us, last_us, frames, bytes, latest_ip, evidence from dev")
def _(spark, d):
    got = hosts.device_inventory(frames(spark, d))
    return got.select(
        "mac", F.unix_micros("first_seen").alias("first_us"), F.unix_micros("last_seen").alias("last_us"), "frames", "bytes", "latest_ip", F.array_join("evidence", ",").alias("evidence"),
    )


@BOOK.query("j11_oui_vendor_join", f"""with {FRAMES}, dev as (select distinct mac from frames), v as (select upper(concat(lpad(to_hex(n_nationkey % 32), 2, '0'), ':5e:00')) as prefix, min(n_name) as vendor from nation group by 1)
select mac, (('0x' || substr(mac, 1, 2))::int & 2) <> 0 as is_random_mac, case when (('0x' || substr(mac, 1, 2))::int & 2) = 0 then vendor end as vendor from dev left join v on upper(substr(mac, 1, 8)) = prefix""")
def _(spark, d):
    nation = table(spark, d, "nation")
    prefix = F.concat(F.lpad(F.hex((F.col("n_nationkey") % 32).cast("long")), 2, "0"), F.lit(":5e:00"))
    vendors = nation.groupBy(prefix.alias("prefix")).agg(F.min("n_name").alias("vendor"))
    return hosts.oui_vendor(frames(spark, d).select("mac").distinct(), vendors).select("mac", "is_random_mac", "vendor")
