"""Graded response policies on scored flows: states, actions, safety, costs and run metrics.

Everything is partitioned by host; order-dependent rules use row or time context around slices, so a
host that holds a third of the rows is spread (see ``ordered``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlake.functions.numeric import clip, ratio
from flowlake.operators import bootstrap
from flowlake.operators.chains import block_machine
from flowlake.operators.ordered import (
    DAY, _join_chunk, attach_row, blocks_with_context, carry_sum, first_per_key, following, micros, numbered,
    previous, ranked_globally, time_chunk, with_halo,
)
from flowlake.session import durable

# Action codes.
ALLOW, ALERT, RATE_LIMIT, ISOLATE = 0, 1, 2, 3
ACTIONS = ("ALLOW", "ALERT", "RATE_LIMIT", "ISOLATE")

# Loss of (regime, label, action), action order ALLOW, ALERT, RATE_LIMIT, ISOLATE.
COSTS = {
    "standard_enterprise": {0: [0.0, 1.0, 15.0, 60.0], 1: [100.0, 12.0, 6.0, 2.0]},
    "high_availability": {0: [0.0, 1.0, 30.0, 120.0], 1: [50.0, 12.0, 6.0, 2.0]},
    "high_security_enclave": {0: [0.0, 1.0, 5.0, 25.0], 1: [500.0, 20.0, 10.0, 2.0]},
}
# Severity weight of an attack family.
SEVERITY = {
    "Infiltration": 1.00, "Bot": 0.95, "DDoS": 0.85, "DoS": 0.80, "Web": 0.70, "BruteForce": 0.65,
    "PortScan": 0.40, "BENIGN": 0.05, "NORMAL": 0.05, "Exploits": 0.90, "Fuzzers": 0.60, "Generic": 0.50,
    "Reconnaissance": 0.40, "Analysis": 0.45, "Backdoor": 0.95, "Shellcode": 1.00, "Worms": 1.00,
    "UNKNOWN": 0.50,
}
CHATTER_COST, FATIGUE_FREE, FATIGUE_SLOPE = 10.0, 5, 0.5
BLOCK_ROWS = 50_000
HALO_PARTS = 4  # a slice is at least as many times as wide as the context copied into the next


def action_name(code: Column) -> Column:
    return F.element_at(F.array(*[F.lit(a) for a in ACTIONS]), code + 1)


# ---- lookups -------------------------------------------------------------------------------------

def severity_join(df: DataFrame, family: str = "family") -> DataFrame:
    rows = df.sparkSession.createDataFrame(list(SEVERITY.items()), "_f string, severity_weight double")
    return (
        df.join(F.broadcast(rows), F.col(family) == F.col("_f"), "left").drop("_f")
        .withColumn("severity_weight", F.coalesce("severity_weight", F.lit(0.5)))
    )


def cost_table(spark) -> DataFrame:
    rows = [(r, y, a, c) for r, m in COSTS.items() for y, cs in m.items() for a, c in enumerate(cs)]
    return spark.createDataFrame(rows, "regime string, label int, act int, base_cost double")


def cost_join(df: DataFrame, action: str, y: str, regime: str | None = None, regime_col: str = "regime") -> DataFrame:
    """Base cost of each row; labels other than 1 count as benign."""
    costs = cost_table(df.sparkSession)
    label = F.when(F.col(y) == 1, 1).otherwise(0)
    cond = (label == F.col("label")) & (F.col(action) == F.col("act"))
    if regime is None:
        costs = costs.withColumnRenamed("regime", "_regime")
        return df.join(F.broadcast(costs), cond & (F.col(regime_col) == F.col("_regime")), "left").drop("_regime", "label", "act")
    costs = costs.filter(F.col("regime") == regime).drop("regime")
    return df.join(F.broadcast(costs), cond, "left").drop("label", "act")


def canonical_host(host: Column) -> Column:
    """Lower-cased trimmed text; dotted IPv4 octets lose leading zeros, so equal addresses compare equal."""
    t = F.lower(F.trim(host))
    plain = F.array_join(F.transform(F.split(t, r"\."), lambda o: o.cast("int").cast("string")), ".")
    return F.when(t.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), plain).otherwise(t)


def mark_critical(df: DataFrame, protected: DataFrame, host: str = "host_id") -> DataFrame:
    """``protected`` is the operator's list of protected assets (an ``identifier`` column)."""
    p = protected.select(canonical_host(F.col("identifier")).alias("_p")).distinct()
    return (
        df.withColumn("_host", canonical_host(F.col(host)))
        .join(p, F.col("_host") == F.col("_p"), "left")
        .withColumn("is_critical", F.col("_p").isNotNull()).drop("_host", "_p")
    )


# ---- policies ------------------------------------------------------------------------------------

def always_allow() -> Column:
    return F.lit(ALLOW)


# Thresholds of the ladder's policies and of the tier machine.
SINGLE_TAU, TIER_LOW, TIER_TOP = 0.50, 0.40, 0.75
SUSPECT, HIGH_RISK, PERSISTENT, ALERT_DENSITY, COOLDOWN_STEPS = 0.40, 0.85, 0.70, 3, 30


def single_threshold(score: Column, tau: float = SINGLE_TAU, four_action: bool = True) -> Column:
    return F.when(score >= tau, ISOLATE if four_action else RATE_LIMIT).otherwise(ALLOW)


def two_tier(score: Column, low: float = TIER_LOW, high: float = TIER_TOP, four_action: bool = True) -> Column:
    """The upper tier isolates and the lower one limits; with three actions each is one step milder."""
    top, mid = (ISOLATE, RATE_LIMIT) if four_action else (RATE_LIMIT, ALERT)
    return F.when(score >= high, top).when(score >= low, mid).otherwise(ALLOW)


def cost_optimal(score: Column, regime: str, four_action: bool = True) -> Column:
    """Least expected cost; actions within 1e-9 of the least go to the least disruptive one."""
    m, p = COSTS[regime], clip(score, 0, 1)
    n = 4 if four_action else 3
    expected = [(1.0 - p) * m[0][a] + p * m[1][a] for a in range(n)]
    least = F.least(*expected)
    out = F.lit(n - 1)
    for a in range(n - 2, -1, -1):
        out = F.when(expected[a] <= least + 1e-9, a).otherwise(out)
    return out


TIER_STATES = [(t, c) for t in range(4) for c in range(COOLDOWN_STEPS + 1)]


def tier_step(
    four_action: bool = True, suspect: float = SUSPECT, high: float = HIGH_RISK, persistent: float = PERSISTENT, density: int = ALERT_DENSITY, cooldown: int = COOLDOWN_STEPS
):
    """Transition of the tier machine: state (tier, cooldown), input (score, alerts in the last 10)."""
    top = ISOLATE if four_action else RATE_LIMIT

    def step(state: tuple, row: tuple) -> tuple:
        tier, cool = state
        score, alerts = row
        cool = max(cool - 1, 0)
        if tier in (ALLOW, ALERT) and score >= high:
            return (top, cooldown)
        if tier == ALLOW:
            return (ALERT if score >= suspect else ALLOW, cool)
        if tier == ALERT:
            if alerts >= density:
                return (RATE_LIMIT, cooldown)
            return (ALLOW if score < suspect and alerts == 0 else ALERT, cool)
        if tier == RATE_LIMIT:
            if four_action and (score >= high or (alerts >= 5 and score >= persistent)):
                return (ISOLATE, cooldown)
            return (ALERT if cool == 0 and score < suspect and alerts == 0 else RATE_LIMIT, cool)
        if cool == 0 and score < suspect:
            return (RATE_LIMIT, cooldown // 2)
        return (ISOLATE, cool)

    return step


def ranked_hosts(df: DataFrame, host: str = "host_id", ts: str = "ts", order: str = "seq", chunk_s: float = DAY) -> DataFrame:
    return numbered(df, [host], [ts, order], time_chunk(ts, chunk_s))


def tier_machine(df: DataFrame, host: str = "host_id", score: str = "score", ts: str = "ts", order: str = "seq", *, four_action: bool = True, chunk_s: float = DAY, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per-host tier with memory of the last ten alerts and a 30-step cooldown, as column ``action``."""
    ranked = ranked_hosts(df, host, ts, order, chunk_s)
    placed = blocks_with_context(ranked, "rn", 9, block_rows)
    w = Window.partitionBy(host, "_block").orderBy("rn").rowsBetween(-9, 0)
    counted = (
        placed.withColumn("_alerts", F.sum((F.col(score) >= 0.40).cast("int")).over(w).cast("int"))
        .filter("_own").drop("_block", "_own")
    )
    return block_machine(
        counted, [host], "rn", [score, "_alerts"], tier_step(four_action), (ALLOW, 0), TIER_STATES,
        lambda s: s[0], block_rows=block_rows, out="action",
    ).drop("_alerts", "rn")


# ---- state vector --------------------------------------------------------------------------------

def state_vector(
    df: DataFrame, host: str = "host_id", score: str = "score", bps: str = "flow_bytes_per_s", ts: str = "ts", order: str = "seq", *,
    action: str | None = None, cooldown: str | None = None, disabled: Sequence[int] = (),
    chunk_s: float = DAY, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Six state dimensions per row: score, score minus the mean of the five scores before, share of
    alerts over the last twenty rows and this one, previous action / 3, cooldown fraction, log volume."""
    s0 = clip(F.col(score).cast("double"), 0, 1)
    ranked = ranked_hosts(df, host, ts, order, chunk_s).withColumn("_s", s0)
    placed = blocks_with_context(ranked, "rn", 20, block_rows)
    w = Window.partitionBy(host, "_block").orderBy("rn")
    past = F.avg("_s").over(w.rowsBetween(-5, -1))
    alert = (F.col("_s") >= 0.5).cast("double")
    dims = [
        F.col("_s"),
        F.coalesce(clip(F.col("_s") - past, -1, 1), F.lit(0.0)),
        F.avg(alert).over(w.rowsBetween(-20, 0)),
        F.coalesce(F.lag(F.col(action)).over(w) / 3.0, F.lit(0.0)) if action else F.lit(0.0),
        clip(F.coalesce(F.col(cooldown).cast("double"), F.lit(0.0)) / 30.0, 0, 1) if cooldown else F.lit(0.0),
        clip(F.log10(1.0 + F.greatest(F.col(bps).cast("double"), F.lit(0.0))) / 8.0, 0, 1),
    ]
    cols = {f"s{i}": (F.lit(0.0) if i in disabled else d) for i, d in enumerate(dims)}
    return placed.withColumns(cols).filter("_own").drop("_s", "_block", "_own", "rn")


def state_vector_8(df: DataFrame, family: str = "family", confidence: str | None = None, score: str = "score", disabled: Sequence[int] = (), **kw) -> DataFrame:
    """State vector plus severity of the family and confidence in it (the clipped
    score where none is given, whether or not the score's own dimension is disabled). A disabled
    dimension is 0."""
    six = severity_join(state_vector(df, score=score, disabled=disabled, **kw), family)
    conf = F.col(confidence if confidence else score)
    more = {"s6": clip(F.col("severity_weight"), 0, 1), "s7": clip(conf, 0, 1)}
    return six.withColumns({n: F.lit(0.0) if int(n[1]) in disabled else c for n, c in more.items()}).drop("severity_weight")


# ---- safety --------------------------------------------------------------------------------------

def clamp_three(action: Column) -> Column:
    return F.when(action == ISOLATE, RATE_LIMIT).otherwise(action)


def exempt_critical(action: Column, critical: Column) -> Column:
    return F.when((action == ISOLATE) & critical, ALERT).otherwise(action)


def blast_radius(df: DataFrame, action: str, host: str = "host_id", ts: str = "ts", order: str = "seq", *, window: str = "1 hour", limit: float = 0.05, min_hosts: int = 20, slice_s: float = 60.0) -> DataFrame:
    """Within each event-time window, hosts may be isolated in order of their first isolation as long as
    they stay within ``limit`` of the hosts seen in the window; further isolations become alerts.

    The ranking runs over one row per (window, host), not over flows, and by slices of a window."""
    win = F.window(ts, window)["start"]
    base = df.withColumn("_w", win)
    hosts = base.groupBy("_w", host).agg(F.min(F.when(F.col(action) == ISOLATE, F.struct(F.col(ts).alias("t"), F.col(order).alias("o")))).alias("_first"))
    seen = hosts.groupBy("_w").agg(F.count("*").alias("_known"))
    firsts = hosts.filter(F.col("_first").isNotNull()).select("_w", host, F.col("_first.t").alias("_ft"), F.col("_first.o").alias("_fo"))
    ranked = numbered(firsts, ["_w"], ["_ft", "_fo"], time_chunk("_ft", slice_s), "_rank")
    blocked = ranked.join(seen, "_w").filter(F.col("_rank") / F.greatest("_known", F.lit(min_hosts)) > limit)
    blocked = blocked.select(F.col("_w").alias("_bw"), F.col(host).alias("_bh"), F.lit(True).alias("_blocked"))
    marked = base.join(blocked, (F.col("_w") == F.col("_bw")) & (F.col(host) == F.col("_bh")), "left")
    hit = F.coalesce(F.col("_blocked"), F.lit(False)) & (F.col(action) == ISOLATE)
    return marked.withColumn("blast_radius_hit", hit).withColumn(
        action, F.when(F.col("blast_radius_hit"), ALERT).otherwise(F.col(action))
    ).select(*df.columns, "blast_radius_hit")


def safety_gate(df: DataFrame, proposed: str = "proposed", host: str = "host_id", ts: str = "ts", order: str = "seq", *, three_action: bool = False, critical: str = "is_critical", cooldown_s: float = 30.0, blast_window: str | None = None, chunk_s: float = DAY) -> DataFrame:
    """Clamp, exemption, blast radius (where ``blast_window`` is given) and cooldown hold, in this order:
    enforced action, override flag, reason, remaining cooldown.

    A held ALLOW never renews the cooldown and an ALERT ends the hold, so the enforced action depends
    only on the last non-ALLOW action within the cooldown: ``cooldown_s`` of context is enough."""
    p = F.col(proposed)
    clamped = clamp_three(p) if three_action else p
    safe = exempt_critical(clamped, F.col(critical))
    base = df.withColumn("_p", safe.cast("int"))
    if blast_window is not None:
        base = blast_radius(base, "_p", host, ts, order, window=blast_window)
    else:
        base = base.withColumn("blast_radius_hit", F.lit(False))
    placed = with_halo(base, ts, max(chunk_s, HALO_PARTS * cooldown_s), cooldown_s)
    w = Window.partitionBy(host, "_chunk").orderBy(ts, order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    us = F.unix_micros(F.col(ts))
    mark = F.when(F.col("_p") != ALLOW, F.struct(F.col("_p").alias("a"), us.alias("us")))
    harsh = F.when(F.col("_p") >= RATE_LIMIT, us)
    placed = placed.withColumns({
        "_last": F.last(mark, ignorenulls=True).over(before),
        "_cool": F.last(harsh, ignorenulls=True).over(before),
    }).filter("_own")
    hold = (F.col("_p") == ALLOW) & (F.col("_last.a") >= RATE_LIMIT) & (us - F.col("_last.us") < micros(cooldown_s))
    hold = F.coalesce(hold, F.lit(False))
    reason = (
        F.when(hold, "MANDATORY_ACTION_COOLDOWN")
        .when(F.col("blast_radius_hit"), "BLAST_RADIUS_CIRCUIT_BREAKER")
        .when((clamped == ISOLATE) & F.col(critical), "CRITICAL_INFRASTRUCTURE_EXEMPTION")
    )
    if three_action:
        reason = reason.when(p == ISOLATE, "ACTION_MODE_3_ACTION_CLAMP")
    left = (F.lit(micros(cooldown_s)) - (us - F.col("_cool"))) / 1e6
    return placed.withColumns({
        "enforced": F.when(hold, F.col("_last.a")).otherwise(F.col("_p")),
        "override_reason": reason,
        "cooldown_remaining_s": F.greatest(F.coalesce(left, F.lit(0.0)), F.lit(0.0)),
    }).withColumn("overridden", F.col("override_reason").isNotNull()).drop("_p", "_last", "_cool", "_chunk", "_own", "blast_radius_hit")


def override_summary(log: DataFrame) -> DataFrame:
    per = log.groupBy("override_reason").agg(F.count("*").alias("n"))
    return attach_row(per, per.agg(F.sum("n").alias("_t"))).filter(F.col("override_reason").isNotNull()).select(
        "override_reason", "n", (F.col("n") / F.col("_t")).alias("override_rate"))


# ---- costs ---------------------------------------------------------------------------------------

def alert_run(df: DataFrame, action: str, host: str = "host_id", ts: str = "ts", order: str = "seq", chunk_s: float = DAY, out: str = "consecutive_alerts", before: str | None = None) -> DataFrame:
    """Length of the current run of ALERT actions, 0 elsewhere; ``before`` names a column for the action of the
    row before (null for the first of a host), which takes the same pass.

    Inside a slice the run is counted from the last non-ALERT row; a slice that starts inside a run
    takes over the alerts at the end of the slices before it."""
    placed = df.withColumns({"_chunk": time_chunk(ts, chunk_s), "_a": (F.col(action) == ALERT).cast("long")})
    w = Window.partitionBy(host, "_chunk").orderBy(ts, order)
    held = F.struct(F.col(action).alias("v"))
    placed = placed.withColumns({"_rn": F.row_number().over(w).cast("long"), "_prev": F.lag(held).over(w)})
    placed = placed.withColumn("_at", F.max(F.when(F.col("_a") == 0, F.col("_rn"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    per = placed.groupBy(host, "_chunk").agg(
        F.count("*").alias("_n"), F.max("_at").alias("_lastcut"), F.max_by(held, "_rn").alias("_final")
    ).withColumn("_tail", F.col("_n") - F.coalesce("_lastcut", F.lit(0)))
    cw = Window.partitionBy(host).orderBy("_chunk")
    full = F.col("_lastcut").isNull()
    run = F.sum((~full).cast("long")).over(cw.rowsBetween(Window.unboundedPreceding, 0))
    gw = Window.partitionBy(host, "_g").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, 0)
    carried = (
        per.withColumn("_g", run).withColumn("_end", F.sum("_tail").over(gw))
        .withColumns({"_carry": F.coalesce(F.lag("_end").over(cw), F.lit(0)), "_held": F.lag("_final").over(cw)})
        .select(host, "_chunk", "_carry", "_held")
    )
    own = F.when(F.col("_at").isNull(), F.col("_rn") + F.col("_carry")).otherwise(F.col("_rn") - F.col("_at"))
    found = {out: F.when(F.col("_a") == 1, own).otherwise(0)}
    if before is not None:
        found[before] = F.coalesce("_prev", "_held")["v"]
    return _join_chunk(placed, carried, [host]).withColumns(found).drop("_chunk", "_a", "_rn", "_at", "_prev", "_carry", "_held")


def step_cost(log: DataFrame, regime: str, action: str = "enforced", y: str = "y", host: str = "host_id", ts: str = "ts", order: str = "seq", *, cooldown: str = "cooldown_remaining_s", chunk_s: float = DAY) -> DataFrame:
    """Base, chatter and fatigue cost per row. The cooldown is read after enforcement, so a row that
    starts a mitigation already counts as inside it."""
    priced = cost_join(log, action, y, regime)
    priced = alert_run(priced, action, host, ts, order, chunk_s, before="prev_action").withColumn("prev_action", F.coalesce("prev_action", F.lit(ALLOW)))
    cooling = (F.col(action) >= RATE_LIMIT) | (F.col(cooldown) > 0)
    jump = F.abs(F.col(action) - F.col("prev_action")) >= 2
    return priced.withColumns({
        "chatter_cost": F.when(cooling & jump, CHATTER_COST).otherwise(0.0),
        "fatigue_cost": F.greatest(F.col("consecutive_alerts") - FATIGUE_FREE, F.lit(0)) * FATIGUE_SLOPE,
    }).withColumn("total_cost", F.col("base_cost") + F.col("chatter_cost") + F.col("fatigue_cost"))


def severity_cost(costed: DataFrame, action: str = "enforced", y: str = "y", family: str = "family") -> DataFrame:
    """Uncontained attacks cost more the more severe their family is."""
    w = severity_join(costed, family)
    open_attack = (F.col(y) == 1) & (F.col(action) <= ALERT)
    scale = 1.0 + 0.5 * F.greatest(F.col("severity_weight") - 0.5, F.lit(0.0))
    return w.withColumn(
        "total_cost",
        F.when(open_attack, F.col("base_cost") * scale + F.col("chatter_cost") + F.col("fatigue_cost")).otherwise(F.col("total_cost")),
    )


# ---- run metrics ---------------------------------------------------------------------------------

def chattering_index(log: DataFrame, action: str, keys: Sequence[str], ts: str = "ts", order: str = "seq", chunk_s: float = DAY) -> DataFrame:
    """Share of consecutive actions of a key that jump by two or more."""
    key = keys[0]
    prev = previous(log, action, key, ts, order, "_pa", chunk_s)
    jump = F.when(F.col("_pa").isNotNull(), (F.abs(F.col(action) - F.col("_pa")) >= 2).cast("double"))
    return prev.groupBy(key).agg(F.coalesce(F.avg(jump), F.lit(0.0)).alias("chattering_index"))


def mitigation_delay(log: DataFrame, action: str, y: str = "y", key: str | None = None, ts: str = "ts", order: str = "seq", penalty: int = 50, chunk_s: float = DAY) -> DataFrame:
    """Steps from the start of each attack run to its first mitigation (``penalty`` if none), and their
    mean. Without a key the whole stream is one sequence, in slices of about as many rows each."""
    if key:
        k, ranked = key, numbered(log, [key], [ts, order], time_chunk(ts, chunk_s))
        ranked = previous(ranked, y, key, ts, order, "_py", chunk_s, default=0).withColumn("_chunk", time_chunk(ts, chunk_s))
    else:
        k, ranked = "_all", ranked_globally(log.withColumn("_all", F.lit(0)), [ts, order])
        ends = ranked.groupBy("_chunk").agg(F.max_by(y, "rn").alias("_end"))  # one row per slice
        carried = ends.select(F.col("_chunk").alias("_c"), F.lag("_end", 1, 0).over(Window.orderBy("_chunk")).alias("_carry"))
        inside = F.lag(y).over(Window.partitionBy("_chunk").orderBy("rn"))
        first = F.row_number().over(Window.partitionBy("_chunk").orderBy("rn")) == 1
        ranked = ranked.join(carried, F.col("_chunk") == F.col("_c")).withColumn("_py", F.when(first, F.col("_carry")).otherwise(inside)).drop("_c", "_carry")
    start = ((F.col(y) == 1) & (F.col("_py") != 1)).cast("long")
    placed = ranked.withColumn("_start", start)
    w = Window.partitionBy(k, "_chunk").orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
    carried = carry_sum(placed, [k], "_start", "_before")
    runs = _join_chunk(placed.withColumn("_l", F.sum("_start").over(w)), carried, [k]).filter(F.col(y) == 1)
    per = runs.groupBy(k, (F.col("_before") + F.col("_l")).alias("attack_run")).agg(
        F.min("rn").alias("start_rn"),
        F.min(F.when(F.col(action) >= RATE_LIMIT, F.col("rn"))).alias("mitigated_rn"),
    )
    delay = F.coalesce(F.col("mitigated_rn") - F.col("start_rn"), F.lit(penalty))
    got = per.withColumn("delay", delay)
    agg = [F.count("*").alias("attack_runs"), F.avg("delay").alias("mitigation_delay")]
    return got.groupBy(k).agg(*agg) if key else got.agg(*agg)


def run_metrics(costed: DataFrame, keys: Sequence[str] = (), action: str = "enforced", y: str = "y") -> DataFrame:
    """Costs, false quarantines, availability, containment and action counts in one pass."""
    a, benign, attack = F.col(action), F.col(y) == 0, F.col(y) == 1
    share = lambda cond, base: F.try_divide(F.count_if(cond & base).cast("double"), F.nullif(F.count_if(base), F.lit(0)))
    aggs = [
        F.count("*").alias("steps"), F.sum("total_cost").alias("total_cost"), F.avg("total_cost").alias("mean_cost"),
        F.coalesce(share(a == ISOLATE, benign), F.lit(0.0)).alias("false_quarantine_rate"),
        F.coalesce(100.0 * share(a == ALLOW, benign), F.lit(100.0)).alias("availability"),
        F.count_if(attack & (a >= RATE_LIMIT)).alias("contained_attacks"),
        F.count_if(attack & (a < RATE_LIMIT)).alias("uncontained_attacks"),
        *[F.count_if(a == i).alias(f"n_{n.lower()}") for i, n in enumerate(ACTIONS)],
    ]
    return costed.groupBy(*keys).agg(*aggs) if keys else costed.agg(*aggs)


def cost_reduction(runs: DataFrame, baseline: str, policy: str = "policy") -> DataFrame:
    base = runs.filter(F.col(policy) == baseline).agg(F.max("total_cost").alias("_base"))
    return attach_row(runs, base).withColumn(
        "cost_reduction_pct", F.coalesce(100.0 * ratio(F.col("_base") - F.col("total_cost"), F.col("_base")), F.lit(0.0))
    ).drop("_base")


BASELINES = ("always_allow", "single_threshold", "two_tier", "cost_optimal")
MODES = {"4_action": True, "3_action": False}


def baseline_action(policy: str, score: Column, regime: str, four_action: bool) -> Column:
    """Proposed action of a baseline policy without memory."""
    if policy == "cost_optimal":
        return cost_optimal(score, regime, four_action)
    return {
        "always_allow": lambda: always_allow(), "single_threshold": lambda: single_threshold(score, four_action=four_action),
        "two_tier": lambda: two_tier(score, four_action=four_action),
    }[policy]()


def played(
    df: DataFrame, score: str = "score", y: str = "y", policies: Sequence[str] = BASELINES, regimes: Sequence[str] = tuple(COSTS), *,
    host: str = "host_id", ts: str = "ts", order: str = "seq", cooldown_s: float = 30.0, chunk_s: float = DAY,
) -> DataFrame:
    """Every policy in both action modes through the safety gate: policy, mode, regime (of a policy that depends on it,
    else null), ``order``, label, enforced action and the costs of chatter and fatigue.

    A row is copied once per policy and mode with the action proposed there, and a host becomes a host of
    that policy and mode, so one gate and one pass of windows play them all. ``state_machine`` is the tier machine."""
    keep = df.select(host, ts, order, y, score, "is_critical")
    for mode, four in MODES.items():
        if "state_machine" in policies:
            keep = tier_machine(keep, host, score, ts, order, four_action=four, chunk_s=chunk_s).withColumnRenamed("action", f"_tier_{mode}")
    lines = [(p, mode, regime) for mode in MODES for p in policies for regime in (regimes if p == "cost_optimal" else (None,))]
    actions = []
    for p, mode, regime in lines:
        action = (F.col(f"_tier_{mode}") if p == "state_machine" else baseline_action(p, F.col(score), regime, MODES[mode])).cast("int")
        actions.append(action if MODES[mode] else clamp_three(action))
    # a copy carries the number of its line through shuffles and sorts; the names come back at the end
    copies = keep.select(host, ts, order, y, "is_critical", F.posexplode(F.array(*actions)).alias("_line", "proposed"))
    copies = copies.withColumn("_host", F.concat_ws("|", F.col("_line").cast("string"), F.col(host).cast("string"))).drop(host)
    log = safety_gate(copies, host="_host", ts=ts, order=order, cooldown_s=cooldown_s, chunk_s=chunk_s)
    fixed = step_cost(log, regimes[0], y=y, host="_host", ts=ts, order=order, chunk_s=chunk_s)
    named = F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(mode).alias("mode"), F.lit(regime).cast("string").alias("only")) for p, mode, regime in lines])
    return fixed.withColumn("_names", named[F.col("_line")]).select(
        "_names.*", order, F.when(F.col(y) == 1, 1).otherwise(0).alias("label"), F.col("enforced").alias("act"),
        (F.col("chatter_cost") + F.col("fatigue_cost")).alias("extra"),
    )


def priced_counts(log: DataFrame, regimes: Sequence[str], keys: Sequence[Column] = ()) -> DataFrame:
    """Rows, extra and total cost per policy, mode, regime, ``keys``, label and action; base costs follow from the counts."""
    counted = log.groupBy("policy", "mode", "only", *keys, "label", "act").agg(F.count("*").alias("n"), F.sum("extra").alias("extra"))
    costs = cost_table(log.sparkSession).filter(F.col("regime").isin(list(regimes)))
    priced = counted.join(F.broadcast(costs), ["label", "act"]).filter(F.col("only").isNull() | (F.col("only") == F.col("regime")))
    return priced.withColumn("total", F.col("n") * F.col("base_cost") + F.col("extra")).drop("only")


def policy_matrix(
    df: DataFrame, score: str = "score", y: str = "y", policies: Sequence[str] = BASELINES, regimes: Sequence[str] = tuple(COSTS), **play,
) -> DataFrame:
    """Every policy under every regime in both action modes: costs and containment, and the reduction against
    ``always_allow`` of the same regime and mode."""
    priced = priced_counts(played(df, score, y, policies, regimes, **play), regimes)
    some = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    out = priced.groupBy("policy", "mode", "regime").agg(
        F.sum("n").alias("steps"), F.sum("total").alias("total_cost"), (F.sum("total") / F.sum("n")).alias("mean_cost"),
        some((F.col("label") == 1) & (F.col("act") >= RATE_LIMIT)).alias("contained_attacks"),
        some((F.col("label") == 0) & (F.col("act") == ISOLATE)).alias("false_quarantines"),
    )
    base = F.max(F.when(F.col("policy") == "always_allow", F.col("total_cost"))).over(Window.partitionBy("mode", "regime"))
    reduction = F.coalesce(100.0 * ratio(F.col("_base") - F.col("total_cost"), F.col("_base")), F.lit(0.0))
    return out.withColumn("_base", base).withColumn("cost_reduction_pct", reduction).drop("_base")


def paired_policies(
    df: DataFrame, score: str = "score", y: str = "y", policies: Sequence[str] = BASELINES, regimes: Sequence[str] = tuple(COSTS), *,
    order: str = "seq", resamples: int = bootstrap.RESAMPLES, seed: int = bootstrap.SEED, **play,
) -> DataFrame:
    """Paired tests of the cost per flow: every policy but the first against the first, and every one but the
    first two against the second, per regime and mode. All pairs share one set of resamples."""
    log = played(df, score, y, policies, regimes, order=order, **play)
    priced = priced_counts(log, regimes, [bootstrap.bucket_of(order).alias("bucket")])
    configs = [(m, r, p) for m in MODES for r in regimes for p in policies]
    mine = lambda c: (F.col("mode") == c[0]) & (F.col("regime") == c[1]) & (F.col("policy") == c[2])
    sums = durable(priced.groupBy("bucket").agg(  # one row per bucket, read more than once
        F.sum(F.when(mine(configs[0]), F.col("n"))).alias("n"), *[F.coalesce(F.sum(F.when(mine(c), F.col("total"))), F.lit(0.0)).alias(f"c{i}") for i, c in enumerate(configs)]))
    at = {c: F.col(f"c{i}") for i, c in enumerate(configs)}
    pairs = {
        "|".join((m, r, base, p)): at[m, r, p] - at[m, r, base]
        for m in MODES for r in regimes for k, base in enumerate(policies[:2]) for p in policies[k + 1:]
    }
    found = bootstrap.paired_differences(sums, pairs, "n", resamples, seed)
    part = F.split("pair", "\\|")
    better = F.when(~F.col("significant"), "equal").when(F.col("delta") < 0, F.col("candidate")).otherwise(F.col("baseline"))
    named = found.withColumns({c: part[i] for i, c in enumerate(("mode", "regime", "baseline", "candidate"))}).withColumn("better_policy", better)
    return named.select("mode", "regime", "baseline", "candidate", "delta", "ci_lower", "ci_upper", "resamples", "p_value", "significant", "better_policy")


def containment_by_family(log: DataFrame, family: str = "family", action: str = "enforced", y: str = "y") -> DataFrame:
    """Action counts per family (pivot over the four codes) with containment or false-quarantine share."""
    per = log.groupBy(family).pivot(action, [0, 1, 2, 3]).agg(F.count(F.lit(1))).fillna(0, ["0", "1", "2", "3"])
    attack = log.groupBy(family).agg(F.max(y).alias("is_attack"))
    n = F.col("0") + F.col("1") + F.col("2") + F.col("3")
    return per.join(attack, family).select(
        family, "is_attack", n.alias("flows"), *[F.col(str(i)).alias(f"n_{a.lower()}") for i, a in enumerate(ACTIONS)],
        F.when(F.col("is_attack") == 1, 100.0 * (F.col("2") + F.col("3")) / n).alias("containment_pct"),
        F.when(F.col("is_attack") == 0, 100.0 * F.col("3") / n).alias("false_quarantine_pct"),
    )


def action_flip_rate(a: DataFrame, b: DataFrame, action: str, seq: str = "seq") -> DataFrame:
    left, right = a.select(seq, F.col(action).alias("_a")), b.select(seq, F.col(action).alias("_b"))
    return left.join(right, seq).agg(F.count("*").alias("n"), F.avg((F.col("_a") != F.col("_b")).cast("double")).alias("flip_rate"))


# ---- feedback ------------------------------------------------------------------------------------

# Rewards by action (ALLOW, ALERT, RATE_LIMIT, ISOLATE) for known attacks, known benign rows,
# high and low observed risk; and for a failed verification and an ALLOW at low or other risk.
REWARD_ATTACK = (-1.5, 0.2, 0.8, 1.2)
REWARD_BENIGN = (0.2, -0.05, -0.6, -2.0)
REWARD_HIGH_RISK = (0.0, 0.1, 0.6, 1.0)
REWARD_LOW_RISK = (0.0, -0.05, -0.4, -1.5)
REWARD_UNVERIFIED, REWARD_CALM_ALLOW, REWARD_RISKY_ALLOW = -2.5, 0.15, -1.0


def reward(action: Column, risk: Column, verified: Column, truth: Column) -> Column:
    """Reward table: failed verification, known truth, or observed risk only."""
    pick = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), action + 1)
    return (
        F.when(~verified, F.lit(REWARD_UNVERIFIED))
        .when(truth == 1, pick(REWARD_ATTACK))
        .when(truth.isNotNull(), pick(REWARD_BENIGN))
        .when(action == ALLOW, F.when(risk < 0.30, REWARD_CALM_ALLOW).otherwise(REWARD_RISKY_ALLOW))
        .when(risk >= 0.70, pick(REWARD_HIGH_RISK))
        .otherwise(pick(REWARD_LOW_RISK))
    )


def transitions(states: DataFrame, action: str, y: str, host: str = "host_id", ts: str = "ts", order: str = "seq", dims: int = 6, chunk_s: float = DAY) -> DataFrame:
    """(state, action, reward, next state, done) per row; the last row of a host is terminal."""
    state = F.array(*[F.col(f"s{i}") for i in range(dims)])
    nxt = following(states.withColumn("state", state), F.col("state"), host, ts, order, "next_state", chunk_s)
    return nxt.select(
        order, host, "state", F.col(action).alias("action"),
        reward(F.col(action), F.col("s0"), F.lit(True), F.col(y)).alias("reward"),
        F.coalesce("next_state", "state").alias("next_state"), F.col("next_state").isNull().alias("done"),
    )


def greedy_action(df: DataFrame, q: str = "q_values") -> DataFrame:
    """Best action of a value array and its margin over the second best."""
    ordered = F.sort_array(q, asc=False)
    return df.withColumns({
        "greedy_action": (F.array_position(q, F.array_max(q)) - 1).cast("int"),
        "decision_margin": F.when(F.size(q) > 1, F.element_at(ordered, 1) - F.element_at(ordered, 2)),
    })


def state_factors(df: DataFrame, action: str, critical: str) -> DataFrame:
    """The state bands behind a decision as (code, value) pairs in fixed order: risk, trajectory, alert
    density, previous action, cooldown steps left, volume, host kind, and the rationale of the action."""
    s = [F.col(f"s{i}") for i in range(6)]
    pair = lambda code, value: F.struct(F.lit(code).alias("code"), value.cast("double").alias("value"))
    steps = F.bround(s[4] * 30)
    rationale = [F.col(action) == i for i in range(4)]
    factors = [
        F.when(s[0] >= 0.75, pair("RISK_SEVERE", s[0])).when(s[0] >= 0.50, pair("RISK_ABOVE_THRESHOLD", s[0]))
        .when(s[0] >= 0.40, pair("RISK_SUSPECT", s[0])).otherwise(pair("RISK_BENIGN", s[0])),
        F.when(s[1] > 0.15, pair("SCORE_RISING", s[1])).when(s[1] < -0.15, pair("SCORE_FALLING", s[1])),
        F.when(s[2] >= 0.50, pair("ALERTS_DENSE", s[2])).when(s[2] >= 0.20, pair("ALERTS_MODERATE", s[2])),
        F.when(s[3] >= 0.85, pair("WAS_ISOLATED", s[3])).when(s[3] >= 0.50, pair("WAS_RATE_LIMITED", s[3]))
        .when(s[3] >= 0.20, pair("WAS_ALERTED", s[3])),
        F.when(steps > 0, pair("COOLDOWN_STEPS", steps)),
        F.when(s[5] >= 0.60, pair("HEAVY_TRANSFER", s[5])),
        F.when(F.col(critical), pair("CRITICAL_HOST", F.lit(1.0))).otherwise(pair("STANDARD_HOST", F.lit(0.0))),
        F.when(rationale[3], pair("CONTAIN_PERSISTENT_ATTACK", F.col(action))).when(rationale[2], pair("LIMIT_TO_STAY_AVAILABLE", F.col(action)))
        .when(rationale[1], pair("WATCH_WITHOUT_CONTAINMENT", F.col(action))).when(rationale[0], pair("NORMAL_TRAFFIC", F.col(action))),
    ]
    return df.withColumn("factors", F.array_compact(F.array(*factors)))


def verify_effects(log: DataFrame, observed: DataFrame, action: str = "enforced", host: str = "host_id", critical: str = "is_critical", advisory: Column | None = None) -> DataFrame:
    """Whether the observed state of the network shows the action. ``observed`` has one row per host:
    isolated, rate_limited, is_critical. Rows that are only ``advisory`` changed nothing and are skipped."""
    hurt = observed.filter(F.col("is_critical") & (F.col("isolated") | F.col("rate_limited"))).agg((F.count("*") > 0).alias("_collateral"))
    state = observed.select(F.col(host).alias("_h"), F.col("isolated").alias("_iso"), F.col("rate_limited").alias("_rl"), F.lit(1).cast("long").alias("_w"))
    a, no = F.col(action), lambda c: F.coalesce(F.col(c), F.lit(False))
    joined = attach_row(log.join(state, F.col(host) == F.col("_h"), "left"), hurt)
    status = (
        F.when(F.col(critical) & (a >= RATE_LIMIT), "FAILED_CRITICAL_HOST_IMPACTED")
        .when(F.lit(False) if advisory is None else advisory, "SKIPPED_ADVISORY")
        .when(F.col("_collateral"), "FAILED_COLLATERAL_OUTAGE")
        .when((a == ISOLATE) & ~no("_iso"), "FAILED_EFFECT_NOT_OBSERVED")
        .when((a == RATE_LIMIT) & ~no("_rl"), "FAILED_EFFECT_NOT_OBSERVED")
        .otherwise("VERIFIED")
    )
    return joined.withColumn("verification", status).drop("_h", "_iso", "_rl", "_w", "_collateral")


def rule_expiry(rules: DataFrame, now: Column, installed: str = "installed_ts", ttl: str = "ttl_s") -> DataFrame:
    """Installed rules with remaining seconds and whether they are still active at ``now``."""
    left = F.col(ttl) - (F.unix_micros(now) - F.unix_micros(installed)) / 1e6
    return rules.withColumns({"remaining_s": F.greatest(left, F.lit(0.0)), "is_active": left > 0})


def audit_coverage(log: DataFrame, audits: DataFrame, action: str = "enforced", seq: str = "seq") -> DataFrame:
    """Share of non-ALLOW actions with an audit row, and the mean decision margin of those rows."""
    a = first_per_key(audits.select(seq, "decision_margin"), [seq], ["decision_margin"]).withColumn("_has", F.lit(1))
    acted = log.filter(F.col(action) != ALLOW).select(seq).join(a, seq, "left")
    return acted.agg(
        F.count("*").alias("actions"), F.count("_has").alias("audited"),
        F.avg(F.coalesce(F.col("_has").cast("double"), F.lit(0.0))).alias("coverage"),
        F.avg("decision_margin").alias("mean_margin"),
    )


def observed_state(log: DataFrame, action: str = "enforced", host: str = "host_id", order: str = "seq") -> DataFrame:
    """Latest state per host from an action log."""
    return log.groupBy(host).agg(
        F.max_by(action, order).alias("_a"), F.bool_or("is_critical").alias("is_critical")
    ).select(host, (F.col("_a") == ISOLATE).alias("isolated"), (F.col("_a") == RATE_LIMIT).alias("rate_limited"), "is_critical")
