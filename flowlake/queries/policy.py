"""Response policies on scored events: W6 to W9, W13 to W16, Y1 to Y21, J4, J9, J10, A28, A30, X7, X8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake.operators import ordered, policy, sequences
from flowlake.queries.book import Book, big, rnd, rounded
from flowlake.queries.quality import BUCKET, PAIRED, WEIGHTS
from flowlake.sources.views import cte, table, view

BOOK = Book()
E = cte("scored_events")
COOL_S = 172_800.0
COOL_US = int(COOL_S * 1e6)
SEV = {f: w for f, w in policy.SEVERITY.items()}
SEV_SQL = "case family " + " ".join(f"when '{f}' then {w}" for f, w in SEV.items()) + " else 0.5 end"
CRITICAL = [3, 7, 11]
ORDER = "partition by host_id order by ts, seq"


def rows(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "scored_events")


def with_critical(spark, d):
    ids = [f"10.0.0.{i}" for i in CRITICAL]
    return rows(spark, d).withColumn("is_critical", F.col("host_id").isin(ids))


IS_CRITICAL = "host_id in (" + ", ".join(f"'10.0.0.{i}'" for i in CRITICAL) + ")"


@BOOK.query("j4_protected_host_join", f"""{E}, p as (select distinct concat('10.0.0.', n_nationkey) as ip from nation) select seq, host_id in (select ip from p) as is_critical from scored_events""")
def _(spark, d):
    nation = table(spark, d, "nation")
    last = F.when(F.col("n_nationkey") % 2 == 0, F.lpad(F.col("n_nationkey").cast("string"), 3, "0")).otherwise(F.col("n_nationkey").cast("string"))
    listed = nation.select(F.concat(F.lit(" 10.0.000."), last, F.lit(" ")).alias("identifier"))
    return policy.mark_critical(rows(spark, d), listed).select("seq", "is_critical")


@BOOK.query("j9_family_severity_join", f"{E} select seq, {rnd(SEV_SQL)} as severity_weight from scored_events")
def _(spark, d):
    return rounded(policy.severity_join(rows(spark, d)).select("seq", "severity_weight"))


REGIME = "case k % 3 when 0 then 'standard_enterprise' when 1 then 'high_availability' else 'high_security_enclave' end"


def cost_sql(regime: str, y: str, action: str) -> str:
    cases = " ".join(f"when {regime} = '{r}' and {y} = {label} then [{', '.join(map(str, c))}][{action} + 1]" for r, m in policy.COSTS.items() for label, c in m.items())
    return f"case {cases} end"


@BOOK.query("j10_cost_matrix_join", f"{E}, a as (select *, seq % 4 as act, {REGIME} as regime from scored_events) select seq, {rnd(cost_sql('regime', 'y', 'act'))} as base_cost from a")
def _(spark, d):
    regime = F.when(F.col("k") % 3 == 0, "standard_enterprise").when(F.col("k") % 3 == 1, "high_availability").otherwise("high_security_enclave")
    df = rows(spark, d).withColumns({"action": (F.col("seq") % 4).cast("int"), "regime": regime})
    return rounded(policy.cost_join(df, "action", "y").select("seq", "base_cost"))


@BOOK.query("y1_policy_thresholds", f"""{E} select seq, 0 as allow, case when score >= 0.5 then 3 else 0 end as single, case when score >= 0.5 then 2 else 0 end as single_three,
 case when score >= 0.75 then 3 when score >= 0.40 then 2 else 0 end as tier, case when score >= 0.75 then 2 when score >= 0.40 then 1 else 0 end as tier_three from scored_events""")
def _(spark, d):
    s = F.col("score")
    return rounded(rows(spark, d).select(
        "seq", policy.always_allow().alias("allow"), policy.single_threshold(s).alias("single"), policy.single_threshold(s, four_action=False).alias("single_three"),
        policy.two_tier(s).alias("tier"), policy.two_tier(s, four_action=False).alias("tier_three"),
    ))


def optimal_sql(regime: str, actions: int = 4, p: str = "p") -> str:
    m = policy.COSTS[regime]
    e = [f"((1.0 - {p}) * {m[0][a]} + {p} * {m[1][a]})" for a in range(actions)]
    return "case " + " ".join(f"when {e[a]} <= least({', '.join(e)}) + 1e-9 then {a}" for a in range(actions - 1)) + f" else {actions - 1} end"


@BOOK.query("y2_policy_cost_optimal", f"{E}, p as (select seq, greatest(least(score, 1.0), 0.0) as p from scored_events) select seq, " + ", ".join(f"{optimal_sql(r)} as {r}" for r in policy.COSTS) + " from p")
def _(spark, d):
    return rounded(rows(spark, d).select("seq", *[policy.cost_optimal(F.col("score"), r).alias(r) for r in policy.COSTS]))


MACHINE = f"""{E.replace('with ', 'with recursive ', 1)}, a as (select *, row_number() over ({ORDER}) as rn, sum(case when score >= 0.40 then 1 else 0 end) over ({ORDER} rows between 9 preceding and current row) as alerts from scored_events),
walk as (select host_id, cast(0 as bigint) as rn, cast(null as bigint) as seq, 0 as tier, 0 as cool from (select distinct host_id from a)
 union all select a.host_id, a.rn, a.seq,
  case when w.tier in (0, 1) and score >= 0.85 then 3
   when w.tier = 0 then case when score >= 0.40 then 1 else 0 end
   when w.tier = 1 then case when alerts >= 3 then 2 when score < 0.40 and alerts = 0 then 0 else 1 end
   when w.tier = 2 then case when score >= 0.85 or (alerts >= 5 and score >= 0.70) then 3 when greatest(w.cool - 1, 0) = 0 and score < 0.40 and alerts = 0 then 1 else 2 end
   else case when greatest(w.cool - 1, 0) = 0 and score < 0.40 then 2 else 3 end end,
  case when w.tier in (0, 1) and score >= 0.85 then 30
   when w.tier = 1 and alerts >= 3 then 30
   when w.tier = 2 and (score >= 0.85 or (alerts >= 5 and score >= 0.70)) then 30
   when w.tier = 3 and greatest(w.cool - 1, 0) = 0 and score < 0.40 then 15
   else greatest(w.cool - 1, 0) end
 from walk w join a on a.host_id = w.host_id and a.rn = w.rn + 1)"""


@BOOK.query("y4_policy_state_machine", f"{MACHINE} select seq, {big('tier')} as action from walk where rn > 0")
def _(spark, d):
    return rounded(policy.tier_machine(rows(spark, d)).select("seq", "action"))


@BOOK.query("y5_critical_exemption", f"{E} select seq, case when score >= 0.75 and {IS_CRITICAL} then 1 when score >= 0.75 then 3 when score >= 0.40 then 2 else 0 end as action from scored_events")
def _(spark, d):
    df = with_critical(spark, d)
    return rounded(df.select("seq", policy.exempt_critical(policy.two_tier(F.col("score")), F.col("is_critical")).alias("action")))


@BOOK.query("y6_action_clamp", f"{E} select seq, case when score >= 0.40 then 2 else 0 end as action from scored_events")
def _(spark, d):
    return rounded(rows(spark, d).select("seq", policy.clamp_three(policy.two_tier(F.col("score"))).alias("action")))


def gate_sql(three: bool, proposed: str = "case when score >= 0.75 then 3 when score >= 0.40 then 2 when score >= 0.3 then 1 else 0 end") -> str:
    clamp = "case when proposed = 3 then 2 else proposed end" if three else "proposed"
    return f"""g1 as (select *, {proposed} as proposed, {IS_CRITICAL} as critical from scored_events),
g2 as (select *, {clamp} as clamped from g1), g3 as (select *, case when clamped = 3 and critical then 1 else clamped end as safe from g2),
g4 as (select *, last_value(case when safe <> 0 then safe end ignore nulls) over before as last_act, last_value(case when safe <> 0 then epoch_us(ts) end ignore nulls) over before as last_us,
 last_value(case when safe >= 2 then epoch_us(ts) end ignore nulls) over before as cool_us from g3 window before as ({ORDER} rows between unbounded preceding and 1 preceding)),
g5 as (select *, coalesce(safe = 0 and last_act >= 2 and epoch_us(ts) - last_us < {COOL_US}, false) as hold from g4),
gate as (select *, case when hold then last_act else safe end as enforced, case when hold then 'MANDATORY_ACTION_COOLDOWN' when clamped = 3 and critical then 'CRITICAL_INFRASTRUCTURE_EXEMPTION'
 {"when proposed = 3 then 'ACTION_MODE_3_ACTION_CLAMP'" if three else ''} end as override_reason,
 greatest(coalesce(({COOL_US} - (epoch_us(ts) - cool_us)) / 1e6, 0), 0) as cooldown_remaining_s from g5)"""


def proposed(df: DataFrame) -> DataFrame:
    s = F.col("score")
    return df.withColumn("proposed", F.when(s >= 0.75, 3).when(s >= 0.40, 2).when(s >= 0.3, 1).otherwise(0))


def gated(spark, d, three: bool = False, **kw) -> DataFrame:
    return policy.safety_gate(proposed(with_critical(spark, d)), three_action=three, cooldown_s=COOL_S, **kw)


GATE = f"{E}, {gate_sql(False)}"


@BOOK.query("y7_cooldown_hold", f"{GATE} select seq, {big('enforced')} as enforced, override_reason, {rnd('cooldown_remaining_s', 3)} as cooldown_remaining_s from gate")
def _(spark, d):
    return rounded(gated(spark, d).select("seq", "enforced", "override_reason", "cooldown_remaining_s"), 3)


@BOOK.query("x8_safety_gate_three", f"{E}, {gate_sql(True)} select seq, {big('enforced')} as enforced, override_reason from gate")
def _(spark, d):
    return rounded(gated(spark, d, True).select("seq", "enforced", "override_reason"))


DAY_US = 86_400_000_000


@BOOK.query("y8_blast_radius", f"""{E}, p as (select *, epoch_us(ts) // {DAY_US} as w, case when score >= 0.45 then 3 else 0 end as act from scored_events), known as (select w, count(distinct host_id) as n from p group by w),
f as (select w, host_id, min(row(epoch_us(ts), seq)) as first_at from p where act = 3 group by all), r as (select w, host_id, row_number() over (partition by w order by first_at) as rk from f),
b as (select r.w, host_id from r join known using (w) where rk / greatest(n, 20) > 0.05) select seq, case when act = 3 and b.host_id is not null then 1 else act end as action, act = 3 and b.host_id is not null as blast_radius_hit from p left join b on p.w = b.w and p.host_id = b.host_id""")
def _(spark, d):
    df = rows(spark, d).withColumn("action", F.when(F.col("score") >= 0.45, 3).otherwise(0))
    return rounded(policy.blast_radius(df, "action", window="1 day").select("seq", "action", "blast_radius_hit"))


_SAFE = "g3 as (select *, case when clamped = 3 and critical then 1 else clamped end as safe from g2)"
_BLAST = f"""g3a as (select *, epoch_us(ts) // {DAY_US} as w, case when clamped = 3 and critical then 1 else clamped end as wanted from g2), known as (select w, count(distinct host_id) as n from g3a group by w),
firsts as (select w, host_id, min(row(epoch_us(ts), seq)) as first_at from g3a where wanted = 3 group by all), ranks as (select w, host_id, row_number() over (partition by w order by first_at) as rk from firsts),
blocked as (select ranks.w, ranks.host_id, true as is_blocked from ranks join known using (w) where rk / greatest(n, 20) > 0.05),
g3 as (select g3a.*, coalesce(is_blocked, false) and wanted = 3 as blast, case when coalesce(is_blocked, false) and wanted = 3 then 1 else wanted end as safe from g3a left join blocked on blocked.w = g3a.w and blocked.host_id = g3a.host_id)"""
BLAST_GATE = f"{E}, {gate_sql(False).replace(_SAFE, _BLAST).replace('when clamped = 3 and critical then ' + chr(39) + 'CRITICAL', 'when blast then ' + chr(39) + 'BLAST_RADIUS_CIRCUIT_BREAKER' + chr(39) + ' when clamped = 3 and critical then ' + chr(39) + 'CRITICAL')}"


@BOOK.query("y8_gate_with_blast_radius", f"{BLAST_GATE} select override_reason, count(*) as n from gate group by override_reason")
def _(spark, d):
    got = gated(spark, d, blast_window="1 day")
    return got.groupBy("override_reason").agg(F.count("*").alias("n"))


COSTED = f"""{GATE}, pv as (select *, coalesce(lag(enforced) over ({ORDER}), 0) as prev_action, sum(case when enforced <> 1 then 1 else 0 end) over ({ORDER} rows between unbounded preceding and current row) as island from gate),
runs as (select *, case when enforced = 1 then sum(case when enforced = 1 then 1 else 0 end) over (partition by host_id, island order by ts, seq rows between unbounded preceding and current row) else 0 end as consecutive_alerts from pv),
costed as (select *, {cost_sql("'standard_enterprise'", 'y', 'enforced')} as base_cost, case when (enforced >= 2 or cooldown_remaining_s > 0) and abs(enforced - prev_action) >= 2 then 10.0 else 0.0 end as chatter_cost,
 greatest(consecutive_alerts - 5, 0) * 0.5 as fatigue_cost from runs)"""


def costed(spark, d):
    return policy.step_cost(gated(spark, d), "standard_enterprise")


@BOOK.query("w15_fatigue_count", f"{COSTED} select seq, {big('consecutive_alerts')} as consecutive_alerts from costed")
def _(spark, d):
    return policy.alert_run(gated(spark, d), "enforced").select("seq", "consecutive_alerts")


@BOOK.query("y9_step_cost", f"{COSTED} select seq, {rnd('base_cost')} as base_cost, {rnd('chatter_cost')} as chatter_cost, {rnd('fatigue_cost')} as fatigue_cost, {rnd('base_cost + chatter_cost + fatigue_cost')} as total_cost from costed")
def _(spark, d):
    return rounded(costed(spark, d).select("seq", "base_cost", "chatter_cost", "fatigue_cost", "total_cost"))


@BOOK.query("y10_severity_cost", f"""{COSTED} select seq, {rnd(f'case when y = 1 and enforced <= 1 then base_cost * (1 + 0.5 * greatest({SEV_SQL} - 0.5, 0)) else base_cost end + chatter_cost + fatigue_cost')} as total_cost from costed""")
def _(spark, d):
    return rounded(policy.severity_cost(costed(spark, d)).select("seq", "total_cost"))


METRICS = f"""count(*) as steps, {rnd('sum(base_cost + chatter_cost + fatigue_cost)', 4)} as total_cost, {rnd('avg(base_cost + chatter_cost + fatigue_cost)', 4)} as mean_cost,
 {rnd('coalesce(count(*) filter (where y = 0 and enforced = 3) / nullif(count(*) filter (where y = 0), 0), 0)', 4)} as false_quarantine_rate, {rnd('coalesce(100.0 * count(*) filter (where y = 0 and enforced = 0) / nullif(count(*) filter (where y = 0), 0), 100)', 4)} as availability,
 count(*) filter (where y = 1 and enforced >= 2) as contained_attacks, count(*) filter (where y = 1 and enforced < 2) as uncontained_attacks, """ + ", ".join(f"count(*) filter (where enforced = {i}) as n_{n.lower()}" for i, n in enumerate(policy.ACTIONS))


@BOOK.query("y11_run_metrics", f"{COSTED} select host_id, {METRICS} from costed group by host_id")
def _(spark, d):
    return rounded(policy.run_metrics(costed(spark, d), ["host_id"]), 4)


@BOOK.query("y15_containment", f"{COSTED} select count(*) filter (where y = 1 and enforced >= 2) as contained_attacks, count(*) filter (where y = 1 and enforced < 2) as uncontained_attacks from costed")
def _(spark, d):
    return policy.run_metrics(costed(spark, d)).select("contained_attacks", "uncontained_attacks")


@BOOK.query("y12_cost_reduction", f"""{COSTED}, r as (select family as policy, sum(base_cost) as total_cost from costed group by family), b as (select total_cost as base from r where policy = 'BENIGN')
select policy, {rnd('total_cost', 4)} as total_cost, {rnd('coalesce(100 * (base - total_cost) / nullif(base, 0), 0)', 4)} as cost_reduction_pct from r, b""")
def _(spark, d):
    runs = costed(spark, d).groupBy(F.col("family").alias("policy")).agg(F.sum("base_cost").alias("total_cost"))
    return rounded(policy.cost_reduction(runs, "BENIGN"), 4)


MATRIX_POLICIES = {
    "always_allow": ("0", "0"), "single_threshold": ("case when score >= 0.5 then 3 else 0 end", "case when score >= 0.5 then 2 else 0 end"),
    "two_tier": ("case when score >= 0.75 then 3 when score >= 0.40 then 2 else 0 end", "case when score >= 0.75 then 2 when score >= 0.40 then 1 else 0 end"),
}


def played_sql(policies: dict[str, tuple[str, str]]) -> tuple[list[str], dict[tuple[str, str], str]]:
    """CTEs that play each policy in each mode, and the name of each one's costed rows (column ``extra``)."""
    parts, names = [], {}
    for i, (name, modes) in enumerate(policies.items()):
        for three, action in enumerate(modes):
            t = f"m{i}_{three}"
            body = gate_sql(bool(three), action)
            for old in ("g1", "g2", "g3", "g4", "g5", "gate"):
                body = body.replace(f"{old} as (", f"{t}_{old} as (").replace(f"from {old})", f"from {t}_{old})").replace(f"from {old} window", f"from {t}_{old} window")
            parts.append(body + f""", {t}_pv as (select *, coalesce(lag(enforced) over ({ORDER}), 0) as prev_action, sum(case when enforced <> 1 then 1 else 0 end) over ({ORDER} rows between unbounded preceding and current row) as island from {t}_gate),
{t}_c as (select *, case when (enforced >= 2 or cooldown_remaining_s > 0) and abs(enforced - prev_action) >= 2 then 10.0 else 0.0 end
 + greatest(case when enforced = 1 then sum(case when enforced = 1 then 1 else 0 end) over (partition by host_id, island order by ts, seq rows between unbounded preceding and current row) else 0 end - 5, 0) * 0.5 as extra from {t}_pv)""")
            names["3_action" if three else "4_action", name] = f"{t}_c"
    return parts, names


def matrix_sql(policies: dict[str, tuple[str, str]]) -> str:
    """A name may end with the one regime that it is played under, after a bar."""
    parts, names = played_sql(policies)
    selects = []
    for (mode, full), source in names.items():
        name, _, only = full.partition("|")
        for regime in [only] if only else policy.COSTS:
            literal = f"'{regime}'"
            selects.append(f"select '{name}' as policy, '{mode}' as mode, '{regime}' as regime, count(*) as steps, sum({cost_sql(literal, 'y', 'enforced')} + extra) as total_cost, count(*) filter (where y = 1 and enforced >= 2) as contained_attacks, count(*) filter (where y = 0 and enforced = 3) as false_quarantines from {source}")
    return f"""{E}, {', '.join(parts)}, res as ({' union all '.join(selects)}) select r.policy, r.mode, r.regime, r.steps, {rnd('r.total_cost', 4)} as total_cost, {rnd('r.total_cost / r.steps', 4)} as mean_cost, r.contained_attacks, r.false_quarantines,
 {rnd('coalesce(100 * (b.total_cost - r.total_cost) / nullif(b.total_cost, 0), 0)', 4)} as cost_reduction_pct from res r join res b on b.policy = 'always_allow' and b.mode = r.mode and b.regime = r.regime"""


def paired_sql() -> str:
    """Cost differences per bucket and pair, under the weights that all pairs share."""
    parts, names = played_sql(MATRIX_POLICIES)
    costed = [
        f"select {BUCKET.format('seq')} as bucket, '{mode}' as mode, '{regime}' as regime, '{name}' as policy, count(*)::double as n, sum({cost_sql(quoted, 'y', 'enforced')} + extra)::double as c from {source} group by 1"
        for (mode, name), source in names.items() for regime in policy.COSTS for quoted in (f"'{regime}'",)
    ]
    ranks = "values " + ", ".join(f"('{p}', {i})" for i, p in enumerate(MATRIX_POLICIES))
    return f"""{E}, {', '.join(parts)}, ranks as (select * from ({ranks}) t(policy, place)), costs as materialized ({' union all '.join(costed)}),
pairs as (select a.bucket, a.mode, a.regime, a.policy as baseline, b.policy as candidate, a.n, b.c - a.c as d from costs a join costs b using (bucket, mode, regime)
 join ranks ra on ra.policy = a.policy join ranks rb on rb.policy = b.policy where ra.place < 2 and rb.place > ra.place), {WEIGHTS},
v as (select b, mode, regime, baseline, candidate, sum(w * d) / sum(w * n) as value from weights join pairs using (bucket) group by all),
t as (select mode, regime, baseline, candidate, {PAIRED} from v group by all), p as (select mode, regime, baseline, candidate, sum(d) / sum(n) as delta from pairs group by all)
select t.*, {rnd('p.delta')} as delta, case when not significant then 'equal' when p.delta < 0 then candidate else baseline end as better_policy from t join p using (mode, regime, baseline, candidate)"""


@BOOK.query("y13_policy_matrix", matrix_sql(MATRIX_POLICIES))
def _(spark, d):
    return rounded(policy.policy_matrix(with_critical(spark, d), policies=list(MATRIX_POLICIES), cooldown_s=COOL_S), 4)


@BOOK.query("y13_paired_policies", paired_sql())
def _(spark, d):
    return rounded(policy.paired_policies(with_critical(spark, d), policies=list(MATRIX_POLICIES), cooldown_s=COOL_S))


@BOOK.query("y13_ladder")
def _(spark, d):
    """The four steps of the ladder, the machine with memory last, paired with the first two."""
    ladder = [*MATRIX_POLICIES, "state_machine"]
    return rounded(policy.paired_policies(with_critical(spark, d), policies=ladder, cooldown_s=COOL_S))


OPTIMAL_POLICIES = {
    "always_allow": ("0", "0"),
    **{f"cost_optimal|{r}": tuple(optimal_sql(r, n, "greatest(least(score, 1.0), 0.0)") for n in (4, 3)) for r in policy.COSTS},
}


@BOOK.query("y13_policy_matrix_cost_optimal", matrix_sql(OPTIMAL_POLICIES))
def _(spark, d):
    return rounded(policy.policy_matrix(with_critical(spark, d), policies=["always_allow", "cost_optimal"], cooldown_s=COOL_S), 4)


@BOOK.query("w13_chattering_index", f"{GATE}, p as (select host_id, abs(enforced - lag(enforced) over ({ORDER})) as jump from gate) select host_id, {rnd('coalesce(avg(case when jump >= 2 then 1.0 when jump is not null then 0.0 end), 0)')} as chattering_index from p group by host_id")
def _(spark, d):
    return rounded(policy.chattering_index(gated(spark, d), "enforced", ["host_id"]))


DELAY = f"""{GATE}, o as (select *, row_number() over (order by ts, seq) as rn, case when y = 1 and coalesce(lag(y) over (order by ts, seq), 0) <> 1 then 1 else 0 end as st from gate),
r as (select *, sum(st) over (order by rn) as run from o), q as (select run, min(rn) as a, min(rn) filter (where enforced >= 2) as m from r where y = 1 group by run)"""


@BOOK.query("w14_mitigation_delay", f"{DELAY} select count(*) as attack_runs, {rnd('avg(coalesce(m - a, 50))')} as mitigation_delay from q")
def _(spark, d):
    return rounded(policy.mitigation_delay(gated(spark, d), "enforced"))


@BOOK.query("w16_action_flip_rate", f"""{E}, {gate_sql(False)}, h as (select seq, case when score >= 0.75 then 2 when score >= 0.40 then 1 else 0 end as other from scored_events)
select count(*) as n, {rnd('avg(case when enforced <> other then 1.0 else 0.0 end)')} as flip_rate from gate join h using (seq)""")
def _(spark, d):
    other = rows(spark, d).select("seq", policy.two_tier(F.col("score"), four_action=False).alias("enforced"))
    return rounded(policy.action_flip_rate(gated(spark, d), other, "enforced"))


@BOOK.query("y14_containment_by_family", f"""{GATE} select family, {big('max(y)')} as is_attack, count(*) as flows, {', '.join(f'count(*) filter (where enforced = {i}) as n_{a.lower()}' for i, a in enumerate(policy.ACTIONS))},
 {rnd('case when max(y) = 1 then 100.0 * count(*) filter (where enforced >= 2) / count(*) end')} as containment_pct, {rnd('case when max(y) = 0 then 100.0 * count(*) filter (where enforced = 3) / count(*) end')} as false_quarantine_pct from gate group by family""")
def _(spark, d):
    return rounded(policy.containment_by_family(gated(spark, d)))


@BOOK.query("a28_override_summary", f"{GATE} select override_reason, count(*) as n, {rnd('count(*) / (select count(*) from gate)')} as override_rate from gate where override_reason is not null group by override_reason")
def _(spark, d):
    return rounded(policy.override_summary(gated(spark, d)))


@BOOK.query("a30_audit_coverage", f"""{GATE}, au as (select seq, min(score * 2) as decision_margin from gate where seq % 3 = 0 group by seq), x as (select g.seq, a.seq is not null as has, decision_margin from gate g left join au a on a.seq = g.seq where enforced <> 0)
select count(*) as actions, count(*) filter (where has) as audited, {rnd('avg(case when has then 1.0 else 0.0 end)')} as coverage, {rnd('avg(decision_margin)')} as mean_margin from x""")
def _(spark, d):
    log = gated(spark, d)
    audits = rows(spark, d).filter("seq % 3 = 0").select("seq", (F.col("score") * 2).alias("decision_margin"))
    return rounded(policy.audit_coverage(log, audits))


# ---- state ---------------------------------------------------------------------------------------

STATE = f"""{E}, c as (select *, greatest(least(score, 1.0), 0.0) as s0 from scored_events),
st as (select seq, host_id, ts, y, family, s0, coalesce(greatest(least(s0 - avg(s0) over ({ORDER} rows between 5 preceding and 1 preceding), 1.0), -1.0), 0) as s1,
 avg(case when s0 >= 0.5 then 1.0 else 0.0 end) over ({ORDER} rows between 20 preceding and current row) as s2,
 greatest(least(log10(1.0 + greatest(flow_bytes_per_s, 0)) / 8.0, 1.0), 0.0) as s5 from c)"""


@BOOK.query("w6_w7_w8_state_vector", f"{STATE} select seq, {rnd('s0')} as s0, {rnd('s1')} as s1, {rnd('s2')} as s2, {rnd('s5')} as s5 from st")
def _(spark, d):
    return rounded(policy.state_vector(rows(spark, d)).select("seq", "s0", "s1", "s2", "s5"))


@BOOK.query("w8_state_vector_ablation", f"{STATE}, a as (select s.*, coalesce(lag(case when score >= 0.75 then 3 when score >= 0.40 then 2 else 0 end) over (partition by s.host_id order by s.ts, s.seq) / 3.0, 0) as s3 from st s join scored_events e using (seq)) select seq, {rnd('s0')} as s0, {rnd('0')} as s1, {rnd('s3')} as s3 from a")
def _(spark, d):
    df = rows(spark, d).withColumn("act", policy.two_tier(F.col("score")))
    return rounded(policy.state_vector(df, action="act", disabled=[1]).select("seq", "s0", "s1", "s3"))


@BOOK.query("w9_state_vector_8d", f"{STATE} select seq, {rnd('0')} as s0, {rnd('0')} as s6, {rnd('s0')} as s7, {rnd('s2')} as s2 from st")
def _(spark, d):
    return rounded(policy.state_vector_8(rows(spark, d), disabled=[0, 6]).select("seq", "s0", "s6", "s7", "s2"))


@BOOK.query("w9_state_vector_severity", f"{STATE} select seq, {rnd(f'greatest(least({SEV_SQL}, 1.0), 0.0)')} as s6, {rnd('s0')} as s7 from st")
def _(spark, d):
    return rounded(policy.state_vector_8(rows(spark, d)).select("seq", "s6", "s7"))


@BOOK.query("y16_transition_build", f"""{STATE}, t as (select st.*, case when e.score >= 0.75 then 3 when e.score >= 0.40 then 2 else 0 end as act, lead(s0) over (partition by st.host_id order by st.ts, st.seq) as n0, lead(st.seq) over (partition by st.host_id order by st.ts, st.seq) is null as done from st join scored_events e using (seq))
select seq, {big('act')} as action, {rnd('coalesce(n0, s0)')} as next_s0, done, {rnd('case when y = 1 then [-1.5, 0.2, 0.8, 1.2][act + 1] else [0.2, -0.05, -0.6, -2.0][act + 1] end')} as reward from t""")
def _(spark, d):
    states = policy.state_vector(rows(spark, d).withColumn("act", policy.two_tier(F.col("score"))))
    got = policy.transitions(states, "act", "y")
    return rounded(got.select("seq", "action", F.col("next_state")[0].alias("next_s0"), "done", "reward"))


TRUTH = "case when k % 3 = 0 then null else y end"


@BOOK.query("y17_reward", f"""{E}, a as (select seq, score, k % 10 <> 0 as ok, {TRUTH} as truth, seq % 4 as act from scored_events)
select seq, {rnd('''case when not ok then -2.5 when truth = 1 then [-1.5, 0.2, 0.8, 1.2][act + 1] when truth is not null then [0.2, -0.05, -0.6, -2.0][act + 1] when act = 0 then case when score < 0.3 then 0.15 else -1.0 end
 when score >= 0.7 then [0.0, 0.1, 0.6, 1.0][act + 1] else [0.0, -0.05, -0.4, -1.5][act + 1] end''')} as reward from a""")
def _(spark, d):
    act = (F.col("seq") % 4).cast("int")
    truth = F.when(F.col("k") % 3 != 0, F.col("y"))
    return rounded(rows(spark, d).select("seq", policy.reward(act, F.col("score"), F.col("k") % 10 != 0, truth).alias("reward")))


@BOOK.query("y18_greedy_from_q", f"""with q as (select vec_id, embedding[1:4]::double[] as v from embeddings), s as (select vec_id, v, list_sort(v, 'DESC') as o from q) select vec_id, {big('list_position(v, o[1]) - 1')} as greedy_action, {rnd('o[1] - o[2]')} as decision_margin from s""")
def _(spark, d):
    q = table(spark, d, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double")).alias("q_values"))
    return rounded(policy.greedy_action(q).select("vec_id", "greedy_action", "decision_margin"))


@BOOK.query("y19_state_factors", f"""{STATE}, f as (select st.*, {IS_CRITICAL.replace('host_id', 'st.host_id')} as critical, case when e.score >= 0.75 then 3 when e.score >= 0.40 then 2 else 0 end as act from st join scored_events e using (seq))
select seq, concat_ws(',', case when s0 >= 0.75 then 'RISK_SEVERE' when s0 >= 0.5 then 'RISK_ABOVE_THRESHOLD' when s0 >= 0.4 then 'RISK_SUSPECT' else 'RISK_BENIGN' end, case when s1 > 0.15 then 'SCORE_RISING' when s1 < -0.15 then 'SCORE_FALLING' end,
 case when s2 >= 0.5 then 'ALERTS_DENSE' when s2 >= 0.2 then 'ALERTS_MODERATE' end, case when s5 >= 0.6 then 'HEAVY_TRANSFER' end, case when critical then 'CRITICAL_HOST' else 'STANDARD_HOST' end,
 case act when 3 then 'CONTAIN_PERSISTENT_ATTACK' when 2 then 'LIMIT_TO_STAY_AVAILABLE' when 1 then 'WATCH_WITHOUT_CONTAINMENT' else 'NORMAL_TRAFFIC' end) as codes, {rnd('s0')} as risk from f""")
def _(spark, d):
    states = policy.state_vector(with_critical(spark, d).withColumn("act", policy.two_tier(F.col("score"))))
    got = policy.state_factors(states, "act", "is_critical")
    return rounded(got.select("seq", F.array_join(F.transform("factors", lambda f: f["code"]), ",").alias("codes"), F.col("factors")[0]["value"].alias("risk")))


OBSERVED = "obs as (select host_id as h, arg_max(enforced, seq) as last_a from gate group by host_id)"


@BOOK.query("y20_effect_verification", f"""{GATE}, {OBSERVED}, hurt as (select count(*) > 0 as c from obs where last_a >= 2 and h in (select host_id from g1 where critical))
select seq, case when critical and enforced >= 2 then 'FAILED_CRITICAL_HOST_IMPACTED' when k % 5 = 0 then 'SKIPPED_ADVISORY' when c then 'FAILED_COLLATERAL_OUTAGE' when enforced = 3 and last_a <> 3 then 'FAILED_EFFECT_NOT_OBSERVED'
 when enforced = 2 and last_a <> 2 then 'FAILED_EFFECT_NOT_OBSERVED' else 'VERIFIED' end as verification from gate join obs on h = host_id, hurt""")
def _(spark, d):
    log = gated(spark, d)
    got = policy.verify_effects(log, policy.observed_state(log), advisory=F.col("k") % 5 == 0)
    return got.select("seq", "verification")


@BOOK.query("y21_rule_expiry", f"""{E}, n as (select max(epoch_us(ts)) as now_us from scored_events) select seq, {rnd('greatest(k * 3600 - (now_us - epoch_us(ts)) / 1e6, 0)', 3)} as remaining_s, k * 3600 - (now_us - epoch_us(ts)) / 1e6 > 0 as is_active from scored_events, n""")
def _(spark, d):
    df = rows(spark, d)
    rules = ordered.attach_row(df.select("seq", F.col("ts").alias("installed_ts"), (F.col("k") * 3600).alias("ttl_s")), df.agg(F.max("ts").alias("now")))
    return rounded(policy.rule_expiry(rules, F.col("now")).select("seq", "remaining_s", "is_active"), 3)


@BOOK.query("x7_sequence_buffer", f"{E}, r as (select seq, row_number() over ({ORDER}) as rn, list(score) over ({ORDER} rows between 4 preceding and current row) as l from scored_events) select seq, {rnd('list_sum(l)')} as total from r where rn >= 5")
def _(spark, d):
    got = sequences.sequence_windows(rows(spark, d), ["host_id"], ["ts", "seq"], ordered.time_chunk("ts", ordered.DAY), ["score"])
    return rounded(got.select("seq", F.aggregate("sequence", F.lit(0.0), lambda a, x: a + x["score"]).alias("total")))
