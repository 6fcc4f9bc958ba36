"""Streams over the given tables, against the SQL of their batch twins: X1, X3, X4, W11, X5, X6, X8, X9, X10, X11.

A table arrives in slices that overlap in time; the query is stopped and resumed between them. The last
slice ends with a marker far ahead, which moves the watermark past every open deadline.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake.queries.book import Book, big, rnd, rounded
from flowlake.queries.correlation import COOLDOWN_S, ESCALATED, PAIRS, SCAN, SCAN_SQL, WINDOW_S, scored, tcp
from flowlake.queries.events import SEVERITY, scratch, security_events
from flowlake.queries.flows import FLOW_COUNTS, FLOW_FLAGS, FLOW_MEANS, flows_sql, packets
from flowlake.queries.policy import COOL_S, GATE, proposed, with_critical
from flowlake.sources.views import cte, table, view
from flowlake.streaming import flow_stream, jobs, measures, replay, sources

BOOK = Book()
E = cte("scored_events")
SLICES, JITTER_S, DELAY = 2, 3_600.0, "2 hours"
FAR_S = 90 * 86_400.0  # behind every deadline of the queries below
IDLE_S, LIFE_S = 172_800.0, 432_000.0


def slices(rows: DataFrame, order: str, **marker) -> list[DataFrame]:
    cut = replay.shuffled_slices(rows, "ts", order, SLICES, JITTER_S)
    return [*cut[:-1], cut[-1].unionByName(replay.end_marker(rows, "ts", FAR_S, **marker))]


# ---- flows ---------------------------------------------------------------------------------------


def flows_run(spark: SparkSession, d: str, name: str) -> replay.Run:
    rows = slices(packets(spark, d), "pkt_id", src_ip="", dst_ip="", protocol=0, packet_length=0, pkt_id=-1)
    counts = measures.count_by("closed_reason", ["FIN", "RST", "TIMEOUT", "MAX_DURATION"])
    total = {"packets": F.sum("packet_count"), "bytes": F.sum("total_bytes")}
    job = lambda s: measures.observed(flow_stream.flow_stream(s, IDLE_S, LIFE_S, DELAY), "flows", **counts, **total)
    return replay.replay(spark, rows, scratch(spark, name), job)


_AGGREGATED = flows_sql(0)[flows_sql(0).index("flows as ("):].replace("flow_seq,", "flow_seq, first(pkt_id order by ts, pkt_id) as first_pkt_id,", 1)
_WIDE, _LIFE = int(IDLE_S * 1e6), int(LIFE_S * 1e6)
FLOWS_SQL = f"""{cte('packets').replace('with ', 'with recursive ', 1)},
ports as (select *, case when protocol in (6, 17) then src_port else 0 end as sp, case when protocol in (6, 17) then dst_port else 0 end as dp from packets),
dirs as (select *, src_ip < dst_ip or (src_ip = dst_ip and sp <= dp) as is_forward from ports),
keyed as (select *, case when is_forward then concat(src_ip, ':', sp, '<->', dst_ip, ':', dp, '/', protocol) else concat(dst_ip, ':', dp, '<->', src_ip, ':', sp, '/', protocol) end as flow_key from dirs),
ranked as (select flow_key, pkt_id, epoch_us(ts) as us, is_tcp and (fin or rst) as ends, row_number() over (partition by flow_key order by ts, pkt_id) as rn from keyed),
walk as (select flow_key, rn, pkt_id, us, ends, us as start, 1 as flow_seq from ranked where rn = 1
 union all select r.flow_key, r.rn, r.pkt_id, r.us, r.ends, case when w.ends or r.us > least(w.us + {_WIDE}, w.start + {_LIFE}) then r.us else w.start end,
  w.flow_seq + case when w.ends or r.us > least(w.us + {_WIDE}, w.start + {_LIFE}) then 1 else 0 end from walk w join ranked r on r.flow_key = w.flow_key and r.rn = w.rn + 1),
split as (select k.*, w.flow_seq from keyed k join walk w using (flow_key, pkt_id)),
{_AGGREGATED},
ended as (select *, least(epoch_us(last_ts) + {_WIDE}, epoch_us(start_ts) + {_LIFE}) as deadline_us, (select max(epoch_us(ts)) from packets) as end_us from flows),
timed as (select * exclude (closed_reason), case when closed_reason <> 'TIMEOUT' then closed_reason
 when epoch_us(start_ts) + {_LIFE} < epoch_us(last_ts) + {_WIDE} then 'MAX_DURATION' else 'TIMEOUT' end as closed_reason from ended)"""


@BOOK.query("x1_flow_stream", f"""{FLOWS_SQL} select flow_key, first_pkt_id, src_ip, dst_ip, {big('dst_port')} as dst_port, {big('protocol')} as protocol, epoch_us(start_ts) as start_us, epoch_us(last_ts) as last_us,
 {', '.join(FLOW_COUNTS)}, {', '.join(f'{rnd(c)} as {c}' for c in FLOW_MEANS)}, {', '.join(FLOW_FLAGS)}, case when closed_reason not in ('FIN', 'RST') and deadline_us >= end_us then 'FLUSH' else closed_reason end as closed_reason from timed""")
def _(spark, d):
    end = packets(spark, d).agg(F.max("ts").alias("_end"))
    got = flows_run(spark, d, "x1").out.crossJoin(F.broadcast(end))
    got = flow_stream.flushed(got, F.col("_end"))
    return rounded(got.select(
        "flow_key", "first_pkt_id", "src_ip", "dst_ip", "dst_port", "protocol", F.unix_micros("start_ts").alias("start_us"), F.unix_micros("last_ts").alias("last_us"),
        *FLOW_COUNTS, *FLOW_MEANS, *FLOW_FLAGS, "closed_reason",
    ))


@BOOK.query("x11_flow_stream_measures", f"""{FLOWS_SQL}, m as (select 'flows.' || closed_reason as measure, count(*) as value from timed group by all
 union all select 'flows.packets', sum(packet_count) from timed union all select 'flows.bytes', sum(total_bytes) from timed union all select 'input_rows', 1 + (select count(*) from packets) union all select 'late_rows', 0)
select measure, {rnd('value')} as value from m""")
def _(spark, d):
    log = measures.MeasureLog()
    for p in flows_run(spark, d, "x11").progress:
        log.add(p)
    got = measures.totals(measures.as_table(spark, log)).filter("measure <> 'state_rows' and value + case when measure = 'late_rows' then 1 else 0 end > 0")
    return rounded(got.select("measure", "value"))


# ---- sources -------------------------------------------------------------------------------------

STALE_S = 259_200.0


@BOOK.query("x3_escalation_stream", f"""{ESCALATED}, h as (select e.host_id, e.seq, epoch_us(e.ts) as us, e.k, e.y from scored_events e),
b as (select *, case when us - lag(us) over (partition by host_id order by us, seq) > {int(STALE_S * 1e6)} then 1 else 0 end as gone from h),
i as (select *, sum(gone) over (partition by host_id order by us, seq rows between unbounded preceding and current row) as island from b),
v as (select *, row_number() over w as n, list(k || '/' || y) over (w rows between 4 preceding and current row) as five from i window w as (partition by host_id, island order by us, seq))
select esc.seq, esc.escalate, esc.reason, c.n as suspicious_count, {big('least(v.n, 10)')} as sequence_length, case when esc.escalate and v.n >= 5 then array_to_string(five, ',') end as sequence
from esc join v using (seq) join counted c using (seq)""")
def _(spark, d):
    rows = slices(scored(spark, d).select("host_id", "ts", "seq", "suspicious", "k", "y"), "seq", host_id="end", seq=-1, k=0, y=0)
    vector = F.array(F.col("k").cast("double"), F.col("y").cast("double"))
    job = lambda s: sources.escalation_stream(
        s, "host_id", "ts", "seq", F.col("suspicious"), vector, threshold=4, window_s=WINDOW_S, cooldown_s=COOLDOWN_S, stale_s=STALE_S, delay=DELAY)
    got = replay.replay(spark, rows, scratch(spark, "x3"), job).out.filter("source <> 'end'")
    text = F.array_join(F.transform("sequence", lambda v: F.concat(v[0].cast("long").cast("string"), F.lit("/"), v[1].cast("long").cast("string"))), ",")
    return rounded(got.select(F.col("row_id").alias("seq"), "escalate", "reason", "suspicious_count", "sequence_length", text.alias("sequence")))


@BOOK.query("x4_scan_stream", f"{SCAN_SQL} select src_ip, scan_type, case when scan_type = 'VERTICAL' then dst_ip else live || ' targets (subnet scan)' end as target, us, pkt_id as probe_id, unique_ports from walk where scan_type is not null")
def _(spark, d):
    rows = slices(tcp(spark, d), "pkt_id", src_ip="end", dst_ip="end", dst_port=1, pkt_id=-1)
    job = lambda s: sources.scan_stream(s, "ts", "pkt_id", delay=DELAY, **SCAN)
    got = replay.replay(spark, rows, scratch(spark, "x4"), job).out
    return got.select("src_ip", "scan_type", "target", F.unix_micros("ts").alias("us"), "probe_id", "unique_ports")


@BOOK.query("x8_gate_stream", f"{GATE} select seq, {big('enforced')} as enforced, override_reason, {rnd('cooldown_remaining_s', 3)} as cooldown_remaining_s from gate")
def _(spark, d):
    df = proposed(with_critical(spark, d))
    listed = df.filter("is_critical").select(F.col("host_id").alias("host")).distinct()
    rows = slices(df.select("host_id", "ts", "seq", "proposed"), "seq", host_id="end", seq=-1, proposed=0)
    job = lambda s: sources.gate_stream(s, "host_id", "ts", "seq", "proposed", protected=listed, cooldown_s=COOL_S, delay=DELAY)
    got = replay.replay(spark, rows, scratch(spark, "x8"), job).out.filter("host <> 'end'")
    return rounded(got.select(F.col("row_id").alias("seq"), "enforced", "override_reason", "cooldown_remaining_s"), 3)


@BOOK.query("x10_stream_alert_dedup", f"{PAIRS} select seq, not leads as deduplicated from walk")
def _(spark, d):
    rows = scored(spark, d).filter("suspicious").select("host_id", (F.col("k") % 3).alias("target"), "ts", "seq")
    job = lambda s: sources.throttle_stream(s, ["host_id", "target"], "ts", "seq", 43_200.0, DELAY)
    got = replay.replay(spark, slices(rows, "seq", host_id="end", target=0, seq=-1), scratch(spark, "x10"), job).out
    return got.filter("host_id <> 'end'").select(F.col("row_id").alias("seq"), "deduplicated")


# ---- counts, dedup and sink ----------------------------------------------------------------------------


@BOOK.query("x5_stream_tumbling_counts", f"{E} select host_id, epoch_us(ts) // 86400000000 * 86400000000 as window_start_us, count(*) as n from scored_events group by all")
def _(spark, d):
    rows = view(spark, d, "scored_events").select("host_id", "ts", "seq")
    got = replay.replay(spark, slices(rows, "seq", host_id="end"), scratch(spark, "x5"), lambda s: jobs.windowed_counts(s, "host_id", "ts", "1 day", DELAY)).out
    return got.filter("host_id <> 'end'").select("host_id", F.unix_micros("window_start").alias("window_start_us"), "n")


@BOOK.query("x5_stream_session_counts", f"""{E}, m as (select host_id, epoch_us(ts) as us, seq, case when epoch_us(ts) - epoch_us(lag(ts) over (partition by host_id order by ts, seq)) >= 86400000000 then 1 else 0 end as new from scored_events),
s as (select *, sum(new) over (partition by host_id order by us, seq rows between unbounded preceding and current row) as session_seq from m)
select host_id, min(us) as first_us, max(us) + 86400000000 as closes_us, count(*) as n from s group by host_id, session_seq""")
def _(spark, d):
    rows = view(spark, d, "scored_events").select("host_id", "ts", "seq")
    got = replay.replay(spark, slices(rows, "seq", host_id="end"), scratch(spark, "x5s"), lambda s: jobs.session_counts(s, "host_id", "ts", "1 day", DELAY)).out
    return got.filter("host_id <> 'end'").select("host_id", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("closes_ts").alias("closes_us"), "n")


@BOOK.query("x6_stream_dedup", "select event_id, user_id, event_type from events")
def _(spark, d):
    """Every event is delivered twice, the copies up to the jitter apart, so that some arrive in another slice."""
    rows = table(spark, d, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), F.explode(F.array(F.lit(0), F.lit(1))).alias("copy"))
    rows = rows.withColumn("delivery", F.col("event_id") * 2 + F.col("copy")).drop("copy")
    got = replay.replay(spark, slices(rows, "delivery", event_id=-1), scratch(spark, "x6"), lambda s: jobs.dedup(s, ["event_id"], "ts", DELAY)).out
    return got.filter("event_id >= 0").select("event_id", "user_id", "event_type")


@BOOK.query("x9_event_stream_sink", f"{E} select cast(seq as varchar) as event_id, {SEVERITY} as severity from scored_events")
def _(spark, d):
    return jobs.sink_once(spark, security_events(spark, d), scratch(spark, "x9")).select("event_id", "severity")
