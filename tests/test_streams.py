"""Streams in several micro-batches, with shuffled and late rows, against plain folds over the sorted rows."""

from __future__ import annotations

import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from flowlake.streaming import flow_stream, measures, replay, sources

T0 = 1_700_000_000_000_000
DELAY_S = 100
SECOND = 1_000_000


def table(spark, rows, schema):
    """Rows whose first value is the time in microseconds, as column ``ts``."""
    df = spark.createDataFrame(rows, f"us long, {schema}")
    return df.withColumn("ts", F.timestamp_micros("us")).drop("us")


def run(spark, tmp_path, rows, schema, marker, job, late=()):
    """Feed the rows in three slices that overlap by less than the delay, then the late ones, then the marker."""
    rnd = random.Random(5)
    ordered = sorted(rows, key=lambda r: r[0] + rnd.randrange(DELAY_S * SECOND))
    third = len(ordered) // 3 + 1
    slices = [table(spark, ordered[i:i + third], schema) for i in range(0, len(ordered), third)]
    if late:
        slices.append(table(spark, list(late), schema))
    end = max(r[0] for r in rows) + 10_000 * SECOND
    slices.append(table(spark, [(end, *marker)], schema))
    return replay.replay(spark, slices, str(tmp_path / "stream"), job)


# ---- flows ---------------------------------------------------------------------------------------

PACKET = "src_ip string, dst_ip string, src_port int, dst_port int, protocol int, packet_length int, is_tcp boolean, syn boolean, ack boolean, rst boolean, fin boolean, psh boolean, urg boolean, raw_flags int, pkt_id long"


def packets(n: int = 240) -> list[tuple]:
    rnd, rows, t = random.Random(3), [], T0
    for i in range(n):
        t += rnd.choice((0, 1, 5, 20, 30)) * SECOND // 4
        a, b = rnd.sample(("a", "b", "c"), 2)
        protocol = rnd.choice((6, 6, 6, 17, 1))
        flag = lambda p: protocol == 6 and rnd.random() < p  # noqa: B023, E731
        rows.append((t, a, b, 1, 2, protocol, rnd.randrange(40, 1500), protocol == 6, flag(0.3), flag(0.5), flag(0.03), flag(0.04), flag(0.1), flag(0.05), None, i))
    return rows


def fold_flows(rows, idle_s, life_s):
    """The engine, one key at a time; a limit acts as if a packet of another key arrived right after it."""
    open_, done = {}, []
    for r in sorted(rows, key=lambda r: (r[0], r[15])):
        us, ports = r[0], (r[3], r[4]) if r[5] in (6, 17) else (0, 0)
        ends = (r[1], ports[0]), (r[2], ports[1])
        key = f"{min(ends)[0]}:{min(ends)[1]}<->{max(ends)[0]}:{max(ends)[1]}/{r[5]}"
        flow = open_.get(key)
        if flow and us > min(flow["last"] + idle_s * SECOND, flow["start"] + life_s * SECOND):
            done.append((key, flow, "MAX_DURATION" if flow["start"] + life_s * SECOND < flow["last"] + idle_s * SECOND else "TIMEOUT"))
            flow = None
        flow = flow or {"start": us, "n": 0, "bytes": 0, "id": r[15]}
        flow = {**flow, "last": us, "n": flow["n"] + 1, "bytes": flow["bytes"] + r[6]}
        open_[key] = flow
        if r[7] and (r[11] or r[10]):
            done.append((key, open_.pop(key), "FIN" if r[11] else "RST"))
    for key, flow in open_.items():
        done.append((key, flow, "MAX_DURATION" if flow["start"] + life_s * SECOND < flow["last"] + idle_s * SECOND else "TIMEOUT"))
    return sorted((k, f["id"], f["start"], f["last"], f["n"], f["bytes"], reason) for k, f, reason in done)


MARKER = ("", "", 1, 1, 0, 0, False, False, False, False, False, False, False, None, -1)


def test_flows_by_timers_equal_the_fold_and_state_ends(spark, tmp_path):
    rows = packets()
    late = [(T0, "late", "row", 1, 2, 6, 40, True, False, False, False, False, False, False, None, 900 + i) for i in range(3)]
    counts = measures.count_by("closed_reason", ["FIN", "RST", "TIMEOUT", "MAX_DURATION"])
    log = measures.MeasureLog()
    spark.streams.addListener(log)
    got = run(spark, tmp_path, rows, PACKET, MARKER, lambda s: measures.observed(flow_stream.flow_stream(s, 20, 60, f"{DELAY_S} seconds"), "flows", **counts), late)
    found = [(r["flow_key"], r["first_pkt_id"], r["s"], r["l"], r["packet_count"], r["total_bytes"], r["closed_reason"])
             for r in got.out.select("*", F.unix_micros("start_ts").alias("s"), F.unix_micros("last_ts").alias("l")).collect()]
    want = fold_flows(rows, 20, 60)
    assert sorted(found) == want and {w[-1] for w in want} == {"FIN", "RST", "TIMEOUT", "MAX_DURATION"}
    assert got.late == len(late)
    states = [p["stateOperators"][0]["numRowsTotal"] for p in got.progress]
    assert max(states) > 20 and states[-1] <= 5  # only the marker's own flow is left
    again = measures.MeasureLog()
    for p in got.progress:
        again.add(p)
    spark.streams.removeListener(log)
    totals = {r["measure"]: r["value"] for r in measures.totals(measures.as_table(spark, again).withColumn("query", F.lit("q"))).collect()}
    assert totals["late_rows"] == 3 and totals["input_rows"] == len(rows) + 4
    assert all(totals[f"flows.{c}"] == sum(w[-1] == c for w in want) for c in counts)
    assert {m for _, _, m, _ in log.rows} >= {"input_rows", "late_rows", "state_rows"}


def test_flows_still_open_at_the_end_are_flushed(spark):
    rows = [("RST", T0 + 90), ("TIMEOUT", T0 + 50), ("TIMEOUT", T0 + 100), ("MAX_DURATION", T0 + 101)]
    df = spark.createDataFrame(rows, "closed_reason string, us long").withColumn("deadline_ts", F.timestamp_micros("us"))
    got = flow_stream.flushed(df, F.timestamp_micros(F.lit(T0 + 100))).orderBy("us").collect()
    assert [r["closed_reason"] for r in got] == ["TIMEOUT", "RST", "FLUSH", "FLUSH"]


# ---- sources -------------------------------------------------------------------------------------


def fold_escalation(rows, threshold, window_s, cooldown_s, stale_s, needed):
    state, found = {}, []
    for us, source, row_id, suspicious, x in sorted(rows, key=lambda r: (r[0], r[2])):
        s = state.get(source)
        if s is None or us - s["last"] > stale_s * SECOND:
            s = state[source] = {"hits": [], "vectors": [], "at": None, "n": 0}
        s["last"], s["vectors"] = us, [*s["vectors"], [x, 2 * x]][-10:]
        s["hits"] = [h for h in s["hits"] if h >= us - window_s * SECOND] + [us] * suspicious
        above, cooling = len(s["hits"]) >= threshold, s["at"] is not None and us - s["at"] < cooldown_s * SECOND
        if above and not cooling:
            s["at"], s["n"] = us, s["n"] + 1
        sequence = s["vectors"][-needed:] if above and not cooling and len(s["vectors"]) >= needed else None
        found.append((row_id, len(s["hits"]), above and not cooling, s["n"], len(s["vectors"]), sequence))
    return sorted(found, key=lambda r: r[0])


def test_escalation_keeps_ten_vectors_and_forgets_silent_sources(spark, tmp_path):
    rnd, t, rows = random.Random(7), T0, []
    for i in range(200):
        t += rnd.choice((1, 2, 3, 300 if rnd.random() < 0.05 else 4)) * SECOND
        rows.append((t, rnd.choice("xyz"), i, rnd.random() < 0.6, float(i)))
    job = lambda s: sources.escalation_stream(
        s, "source", "ts", "row", F.col("suspicious"), F.array(F.col("x"), 2 * F.col("x")), threshold=4, window_s=30, cooldown_s=15, stale_s=60, needed=5, delay=f"{DELAY_S} seconds")
    got = run(spark, tmp_path, rows, "source string, row long, suspicious boolean, x double", ("end", -1, False, 0.0), job)
    found = [(r["row_id"], r["suspicious_count"], r["escalate"], r["escalation_count"], r["sequence_length"], r["sequence"]) for r in got.out.filter("row_id >= 0").collect()]
    want = fold_escalation(rows, 4, 30, 15, 60, 5)
    assert sorted(found, key=lambda r: r[0]) == want
    assert any(w[-1] for w in want) and max(w[4] for w in want) == 10 and [w[4] for w in want].count(1) > 3
    assert got.progress[-1]["stateOperators"][0]["numRowsTotal"] <= 4
    with pytest.raises(ValueError):
        sources.Escalation(4, 30, 15, 10, 5)


class Ticking(int):
    """A number that counts how often it is compared."""

    ticks = 0

    def _compared(name):  # noqa: N805
        def method(self, other):
            Ticking.ticks += 1
            return getattr(int, name)(self, other)
        return method

    __lt__, __le__, __gt__, __ge__ = _compared("__lt__"), _compared("__le__"), _compared("__gt__"), _compared("__ge__")


def test_a_row_looks_only_at_the_hits_that_leave_the_window(spark):
    machine = sources.Escalation(3, 1.0, 1.0, 5.0, 5)
    state = SimpleNamespace(exists=lambda: False, put=lambda rows: None, clear=lambda: None, update=lambda row: None)
    machine.hits = machine.vectors = machine.seen = state
    rows = [(Ticking(i * 1000), i, True, [0.0]) for i in range(3000)]
    found, _ = machine.walk(("a",), rows, 3000 * 1000)
    assert [f[3] for f in found] == [min(i, 1000) + 1 for i in range(3000)]
    assert Ticking.ticks < 20 * len(rows)


def fold_scans(rows, window_s, min_ports, min_probes):
    state, found = {}, []
    for us, src, dst, port, probe in sorted(rows, key=lambda r: (r[0], r[4])):
        s = state.setdefault(src, {"to": {}, "n": 0, "done": False})
        s["to"] = {k: v for k, v in s["to"].items() if v["last"] >= us - window_s * SECOND}
        if not s["to"]:
            s["n"], s["done"] = 0, False
        mine = s["to"].setdefault(dst, {"ports": set(), "n": 0, "done": False})
        mine["ports"].add(port)
        mine["n"], mine["last"], s["n"] = mine["n"] + 1, us, s["n"] + 1
        every = set().union(*(v["ports"] for v in s["to"].values()))
        if len(mine["ports"]) >= min_ports and mine["n"] >= min_probes and not mine["done"]:
            mine["done"] = True
            found.append((src, "VERTICAL", dst, probe, len(mine["ports"])))
        elif len(every) >= min_ports and s["n"] >= min_probes and not s["done"]:
            s["done"] = True
            found.append((src, "DISTRIBUTED", f"{len(s['to'])} targets (subnet scan)", probe, len(every)))
    return sorted(found)


def test_scans_with_map_state_equal_the_fold(spark, tmp_path):
    rnd, t, rows = random.Random(11), T0, []
    for i in range(260):
        t += rnd.choice((1, 2, 4, 200 if rnd.random() < 0.03 else 5)) * SECOND
        rows.append((t, rnd.choice("pq"), rnd.choice("uvw"), rnd.randrange(1, 12), i))
    job = lambda s: sources.scan_stream(s, "ts", "probe_id", window_s=40, min_ports=4, min_probes=5, delay=f"{DELAY_S} seconds")
    got = run(spark, tmp_path, rows, "src_ip string, dst_ip string, dst_port int, probe_id long", ("end", "end", 1, -1), job)
    found = sorted((r["src_ip"], r["scan_type"], r["target"], r["probe_id"], r["unique_ports"]) for r in got.out.collect())
    want = fold_scans(rows, 40, 4, 5)
    assert found == want and {w[1] for w in want} == {"VERTICAL", "DISTRIBUTED"}
    from flowlake.operators import hosts

    flows = table(spark, rows, "src_ip string, dst_ip string, dst_port int, probe_id long").withColumn("protocol", F.lit(6))
    batch = hosts.scan_columns(flows, "probe_id", "ts", window_s=40, min_ports=4, min_probes=5).filter("scan_type is not null")
    assert sorted((r["src_ip"], r["scan_type"], r["scan_target"], r["probe_id"], r["scan_ports"]) for r in batch.collect()) == want


def fold_gate(rows, listed, cooldown_s, three):
    state, found = {}, []
    for us, host, row, proposed, protect in sorted(rows, key=lambda r: (r[0], r[2])):
        s = state.setdefault(host, {"last": 0, "until": None, "protected": host in listed})
        if protect is not None:
            s["protected"] = protect
            continue
        action, reason = proposed, None
        if three and action == 3:
            action, reason = 2, "ACTION_MODE_3_ACTION_CLAMP"
        if action == 3 and s["protected"]:
            action, reason = 1, "CRITICAL_INFRASTRUCTURE_EXEMPTION"
        if s["until"] is not None and us < s["until"] and s["last"] >= 2 and action == 0:
            action, reason = (1 if s["last"] == 3 and s["protected"] else s["last"]), "MANDATORY_ACTION_COOLDOWN"
        elif action >= 2:
            s["until"] = us + cooldown_s * SECOND
        s["last"] = action
        found.append((row, action, reason))
    return sorted(found, key=lambda r: r[0])


@pytest.mark.parametrize("three", [False, True])
def test_gate_with_a_list_and_changes_to_it(spark, tmp_path, three):
    rnd, t, rows = random.Random(13), T0, []
    for i in range(220):
        t += rnd.choice((1, 2, 6)) * SECOND
        change = rnd.random() < 0.08
        rows.append((t, rnd.choice("ABC"), i, 0 if change else rnd.choice((0, 0, 0, 1, 2, 3)), rnd.random() < 0.5 if change else None))
    listed = spark.createDataFrame([("B",), (" B ",)], "host string")
    job = lambda s: sources.gate_stream(
        s.filter("protect is null"), "host", "ts", "row_id", "proposed", protected=listed, changes=s.filter("protect is not null"), three_action=three, cooldown_s=12,
        delay=f"{DELAY_S} seconds")
    got = run(spark, tmp_path, rows, "host string, row_id long, proposed int, protect boolean", ("end", -1, 0, None), job)
    found = sorted(((r["row_id"], r["enforced"], r["override_reason"]) for r in got.out.filter("row_id >= 0").collect()), key=lambda r: r[0])
    want = fold_gate(rows, {"B"}, 12, three)
    assert found == want and "MANDATORY_ACTION_COOLDOWN" in {w[2] for w in want}


def test_late_alerts_are_dropped_not_marked(spark, tmp_path):
    rows = [(T0 + s * SECOND, "h", i) for i, s in enumerate((100, 103, 104, 106, 300, 301, 900))]
    late = [(T0 + 10 * SECOND, "h", 50), (T0 + 50 * SECOND, "h", 51)]
    job = lambda s: sources.throttle_stream(s, ["host"], "ts", "seq", 5, f"{DELAY_S} seconds")
    got = run(spark, tmp_path, rows, "host string, seq long", ("end", -1), job, late)
    assert got.late == 2
    assert {r["row_id"]: r["deduplicated"] for r in got.out.filter("row_id >= 0").collect()} == {0: False, 1: True, 2: True, 3: False, 4: False, 5: True, 6: False}
