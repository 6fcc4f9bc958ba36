"""Per-source trackers as streams: escalation, port scans, the safety gate and alert throttling."""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlake.operators.ordered import micros
from flowlake.operators.policy import ALERT, ALLOW, ISOLATE, RATE_LIMIT
from flowlake.streaming.in_order import US, InOrder, walked


# ---- escalation ----------------------------------------------------------------------------------

HISTORY = 10


class Escalation(InOrder):
    """List state of the suspicious times inside the window and of the last vectors; a source silent for
    longer than ``stale_s`` is forgotten."""

    def __init__(self, threshold: int, window_s: float, cooldown_s: float, stale_s: float, needed: int):
        super().__init__(
            f"{US} long, row_id long, suspicious boolean, vector array<double>",
            f"source string, {US} long, row_id long, suspicious_count long, escalate boolean, reason string, escalation_count long, sequence_length int, sequence array<array<double>>",
        )
        self.threshold, self.needed = threshold, needed
        self.window, self.cooldown, self.stale = micros(window_s), micros(cooldown_s), micros(stale_s)
        if self.stale < max(self.window, self.cooldown):
            raise ValueError("a source must be remembered for as long as the window and the cooldown reach")

    def open(self, handle) -> None:
        self.hits = handle.getListState("hits", "us long")
        self.vectors = handle.getListState("vectors", "vector array<double>")
        self.seen = handle.getValueState("seen", "last_us long, escalated_us long, escalations long")

    def walk(self, key: tuple, rows: Sequence[tuple], now: int) -> tuple[list[tuple], int | None]:
        last, escalated, times = self.seen.get() if self.seen.exists() else (None, None, 0)
        if last is None and not rows:
            return [], None
        hits = deque(h[0] for h in self.hits.get()) if self.hits.exists() else deque()  # in order, as rows are
        vectors = [list(v[0]) for v in self.vectors.get()] if self.vectors.exists() else []
        found = []
        for us, row_id, suspicious, vector in rows:
            if last is not None and us - last > self.stale:
                hits, vectors, escalated, times = deque(), [], None, 0
            last = us
            vectors = [*vectors, [float(x) for x in vector]][-HISTORY:]
            while hits and hits[0] < us - self.window:
                hits.popleft()
            if suspicious:
                hits.append(us)
            above = len(hits) >= self.threshold
            cooling = escalated is not None and us - escalated < self.cooldown
            escalate = above and not cooling
            if escalate:
                escalated, times = us, times + 1
            reason = "THRESHOLD_MET" if escalate else "COOLDOWN_ACTIVE" if above else "BELOW_THRESHOLD"
            sequence = vectors[-self.needed:] if escalate and len(vectors) >= self.needed else None
            found.append((key[0], us, row_id, len(hits), escalate, reason, times, len(vectors), sequence))
        if now - last > self.stale:
            for state in (self.hits, self.vectors, self.seen):
                state.clear()
            return found, None
        if rows:
            self.hits.put([(h,) for h in hits]) if hits else self.hits.clear()
            self.vectors.put([(v,) for v in vectors])
            self.seen.update((last, escalated, times))
        return found, last + self.stale + 1


def escalation_stream(
    flows: DataFrame, source: str, ts: str, order: str, suspicious: Column, vector: Column, *, threshold: int = 5, window_s: float = 60.0,
    cooldown_s: float = 30.0, stale_s: float = 300.0, needed: int = 5, delay: str = "1 minute",
) -> DataFrame:
    """Count, verdict and reason per row; an escalation carries the last ``needed`` vectors of its source, oldest
    first, once there are as many."""
    rows = flows.select(
        F.coalesce(F.nullif(F.trim(F.col(source)), F.lit("")), F.lit("0.0.0.0")).alias("source"), F.col(ts).alias("ts"), F.unix_micros(ts).alias(US),
        F.col(order).cast("long").alias("row_id"), F.coalesce(suspicious, F.lit(False)).alias("suspicious"), vector.cast("array<double>").alias("vector"),
    )
    return walked(rows, ["source"], "ts", delay, Escalation(threshold, window_s, cooldown_s, stale_s, needed)).withColumn("ts", F.timestamp_micros(US)).drop(US)


# ---- port scans ----------------------------------------------------------------------------------


class Scans(InOrder):
    """Map state of a source: destination to first and last time, probes, alert flag and ports. Destinations
    leave when they have been silent for the window; with the last one the source's own counts start anew."""

    def __init__(self, window_s: float, min_ports: int, min_probes: int):
        super().__init__(
            f"{US} long, probe_id long, dst_ip string, dst_port int",
            f"src_ip string, scan_type string, target string, {US} long, probe_id long, unique_ports long, probes long, span_us long",
        )
        self.window, self.min_ports, self.min_probes = micros(window_s), min_ports, min_probes

    def open(self, handle) -> None:
        self.targets = handle.getMapState("targets", "dst_ip string", "first_us long, last_us long, probes long, alerted boolean, ports array<int>")
        self.whole = handle.getValueState("source", "first_us long, last_us long, probes long, alerted boolean")

    def walk(self, key: tuple, rows: Sequence[tuple], now: int) -> tuple[list[tuple], int | None]:
        live = {k[0]: [*v[:4], set(v[4])] for k, v in self.targets.iterator()} if self.targets.exists() else {}
        first, last, total, alerted = self.whole.get() if self.whole.exists() else (None, None, 0, False)
        stored, touched = set(live), set()
        ports = Counter(p for t in live.values() for p in t[4])
        found = []

        def purge(at: int) -> None:
            nonlocal total, alerted
            for name in [n for n, t in live.items() if t[1] < at - self.window]:
                ports.subtract(live.pop(name)[4])
            if not live:
                total, alerted = 0, False

        for us, probe_id, dst, port in rows:
            purge(us)
            first, last = (us if first is None else first), us
            target = live.setdefault(dst, [us, us, 0, False, set()])
            target[1], target[2], total = us, target[2] + 1, total + 1
            if port not in target[4]:
                target[4].add(port)
                ports[port] += 1
            touched.add(dst)
            distinct = sum(n > 0 for n in ports.values()) if not alerted else 0
            if len(target[4]) >= self.min_ports and target[2] >= self.min_probes and not target[3]:
                target[3] = True
                found.append((key[0], "VERTICAL", dst, us, probe_id, len(target[4]), target[2], us - target[0]))
            elif not alerted and distinct >= self.min_ports and total >= self.min_probes:
                alerted = True
                found.append((key[0], "DISTRIBUTED", f"{len(live)} targets (subnet scan)", us, probe_id, distinct, total, us - first))
        purge(now)
        for gone in stored - set(live):
            self.targets.removeKey((gone,))
        if not live:
            self.whole.clear()
            return found, None
        for name in touched & set(live):
            self.targets.updateValue((name,), (*live[name][:4], sorted(live[name][4])))
        if rows or stored != set(live):
            self.whole.update((first, last, total, alerted))
        return found, min(t[1] for t in live.values()) + self.window + 1


def scan_stream(
    flows: DataFrame, ts: str = "ts", order: str = "probe_id", *, window_s: float = 60.0, min_ports: int = 5, min_probes: int = 5, delay: str = "1 minute"
) -> DataFrame:
    """Vertical and distributed scans of each source as they pass the thresholds."""
    named = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) != ""
    probes = flows.filter(F.col("dst_port").between(1, 65535) & named("src_ip") & named("dst_ip")).select(
        F.trim("src_ip").alias("src_ip"), F.trim("dst_ip").alias("dst_ip"), F.col("dst_port").cast("int").alias("dst_port"),
        F.col(ts).alias("ts"), F.unix_micros(ts).alias(US), F.col(order).cast("long").alias("probe_id"),
    )
    return walked(probes, ["src_ip"], "ts", delay, Scans(window_s, min_ports, min_probes)).withColumn("ts", F.timestamp_micros(US)).drop(US)


# ---- safety gate ---------------------------------------------------------------------------------

FLOW, PROTECT, RELEASE = 0, 1, 2


class Gate(InOrder):
    """Value state of a host: last action, end of its cooldown, and whether it is protected."""

    def __init__(self, three_action: bool, cooldown_s: float):
        super().__init__(
            f"{US} long, row_id long, kind int, proposed int, listed boolean",
            f"host string, {US} long, row_id long, enforced int, override_reason string, cooldown_remaining_s double",
        )
        self.three, self.cooldown = three_action, micros(cooldown_s)

    def open(self, handle) -> None:
        self.memo = handle.getValueState("memo", "action int, until_us long, protected boolean")

    def walk(self, key: tuple, rows: Sequence[tuple], now: int) -> tuple[list[tuple], int | None]:
        last, until, protected = self.memo.get() if self.memo.exists() else (ALLOW, None, None)
        found = []
        for us, row_id, kind, proposed, listed in rows:
            if kind != FLOW:
                protected = kind == PROTECT
                continue
            critical = listed if protected is None else protected
            reason, action = None, proposed
            left = max(0.0, (until - us) / 1e6) if until is not None else 0.0
            if self.three and action == ISOLATE:
                action, reason = RATE_LIMIT, "ACTION_MODE_3_ACTION_CLAMP"
            if action == ISOLATE and critical:
                action, reason = ALERT, "CRITICAL_INFRASTRUCTURE_EXEMPTION"
            if action == ALLOW and last >= RATE_LIMIT and until is not None and us < until:
                action, reason = ALERT if last == ISOLATE and critical else last, "MANDATORY_ACTION_COOLDOWN"
            elif action >= RATE_LIMIT:
                until = us + self.cooldown
            last = action
            found.append((key[0], us, row_id, action, reason, left))
        over = until is None or now >= until
        if over and protected is None:
            self.memo.clear()
            return found, None
        if rows:
            self.memo.update((last, until, protected))
        return found, None if over else until


def gate_stream(
    flows: DataFrame, host: str, ts: str, order: str, proposed: str, *, protected: DataFrame | None = None, changes: DataFrame | None = None,
    three_action: bool = False, cooldown_s: float = 30.0, delay: str = "1 minute",
) -> DataFrame:
    """Clamp, exemption and cooldown hold per flow.

    ``protected`` (column ``host``) is a static list: it is joined to each micro-batch and read anew whenever the
    query starts. ``changes`` (host, ts, row_id, protect) is a stream of changes to it: a change holds
    from its own time on, whenever it arrives, and overrules the list. The isolated share over all hosts
    is no state of a host and stays with the batch operator.
    """
    name = lambda c: F.trim(F.col(c).cast("string"))
    rows = flows.select(
        name(host).alias("host"), F.col(ts).alias("ts"), F.unix_micros(ts).alias(US), F.col(order).cast("long").alias("row_id"),
        F.lit(FLOW).alias("kind"), F.col(proposed).cast("int").alias("proposed"),
    )
    if protected is None:
        rows = rows.withColumn("listed", F.lit(False))
    else:
        listed = protected.select(name("host").alias("host")).distinct().withColumn("_listed", F.lit(True))
        rows = rows.join(listed, "host", "left").withColumn("listed", F.coalesce("_listed", F.lit(False))).drop("_listed")
    if changes is not None:
        rows = rows.unionByName(changes.select(
            name("host").alias("host"), "ts", F.unix_micros("ts").alias(US), F.col("row_id").cast("long").alias("row_id"),
            F.when(F.col("protect"), PROTECT).otherwise(RELEASE).alias("kind"), F.lit(ALLOW).alias("proposed"), F.lit(False).alias("listed"),
        ))
    return walked(rows, ["host"], "ts", delay, Gate(three_action, cooldown_s)).withColumn("ts", F.timestamp_micros(US)).drop(US)


# ---- throttling ----------------------------------------------------------------------------------


class Throttle(InOrder):
    """Value state: the time of the last row that was not itself marked; forgotten when the gap is over."""

    def __init__(self, gap_s: float, keys: Sequence[str], kinds: Sequence[str]):
        named = ", ".join(f"`{k}` {t}" for k, t in zip(keys, kinds, strict=True))
        super().__init__(f"{US} long, row_id long", f"{named}, {US} long, row_id long, deduplicated boolean")
        self.gap = micros(gap_s)

    def open(self, handle) -> None:
        self.leader = handle.getValueState("leader", "us long")

    def walk(self, key: tuple, rows: Sequence[tuple], now: int) -> tuple[list[tuple], int | None]:
        leader = self.leader.get()[0] if self.leader.exists() else None
        found = []
        for us, row_id in rows:
            leads = leader is None or us - leader >= self.gap
            leader = us if leads else leader
            found.append((*key, us, row_id, not leads))
        if leader is None or now - leader >= self.gap:
            self.leader.clear()
            return found, None
        if rows:
            self.leader.update((leader,))
        return found, leader + self.gap


def throttle_stream(alerts: DataFrame, keys: Sequence[str], ts: str, order: str, gap_s: float = 5.0, delay: str = "1 minute") -> DataFrame:
    """Mark alerts within ``gap_s`` of the last alert of the key that was not itself a duplicate."""
    rows = alerts.select(*keys, F.col(ts).alias("ts"), F.unix_micros(ts).alias(US), F.col(order).cast("long").alias("row_id"))
    kinds = [rows.schema[k].dataType.simpleString() for k in keys]
    return walked(rows, list(keys), "ts", delay, Throttle(gap_s, keys, kinds)).withColumn("ts", F.timestamp_micros(US)).drop(US)
