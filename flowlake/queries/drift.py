"""Drift and parity: A27, D1 to D6."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlake.operators import drift, policy
from flowlake.queries.book import Book, big, rnd, rounded
from flowlake.sources.views import cte, view

BOOK = Book()
VEC = cte("vectors")
V3 = ["f1", "f2", "f3"]
LONG = f"{VEC}, long as (" + " union all ".join(f"select '{f}' as feature, family, {f} as v from vectors" for f in V3) + ")"
STATS = f"""{LONG}, st as (select feature, family, count(*) as n, avg(v) as mean, stddev_pop(v) as std, min(v) as lo, max(v) as hi, quantile_cont(v, 0.25) as q25, quantile_cont(v, 0.5) as median, quantile_cont(v, 0.75) as q75 from long group by all)"""


def stats(spark, d):
    return drift.population_stats(view(spark, d, "vectors"), V3, "family")


@BOOK.query("a27_population_stats", f"{STATS} select feature, family, n, {rnd('mean')} as mean, {rnd('std')} as std, {rnd('lo')} as min, {rnd('hi')} as max, {rnd('q25')} as q25, {rnd('median')} as median, {rnd('q75')} as q75 from st")
def _(spark, d):
    return rounded(stats(spark, d))


@BOOK.query("d1_shifts", f"""{STATS} select s.feature, {rnd('t.mean - s.mean')} as mean_shift, {rnd('t.median - s.median')} as median_shift, {rnd('t.std / greatest(s.std, 1e-9)')} as std_ratio
 from st s join st t on s.feature = t.feature and s.family = 'N' and t.family = 'R'""")
def _(spark, d):
    return rounded(drift.shifts(stats(spark, d), "family", "N", "R"))


@BOOK.query("d1_prevalence_shift", f"""{VEC}, a as (select avg(case when f1 > 25 then 1.0 else 0.0 end) filter (where family = 'N') as s, avg(case when f1 > 25 then 1.0 else 0.0 end) filter (where family = 'R') as t from vectors)
select {rnd('s')} as source_prevalence, {rnd('t')} as target_prevalence, {rnd('t - s')} as prevalence_shift from a""")
def _(spark, d):
    df = view(spark, d, "vectors").withColumn("large", (F.col("f1") > 25).cast("int"))
    return rounded(drift.prevalence_shift(df, "family", "large", "N", "R"))


ECDF = f"""{LONG}, c as (select feature, v, count(*) filter (where family = 'N') as a, count(*) filter (where family = 'R') as b from long where family in ('N', 'R') group by all),
r as (select feature, v, sum(a) over w as ca, sum(b) over w as cb, sum(a) over (partition by feature) as ta, sum(b) over (partition by feature) as tb, lead(v) over (partition by feature order by v) as nv from c window w as (partition by feature order by v)),
k as (select feature, max(abs(ca / ta - cb / tb)) as ks, coalesce(sum(abs(ca / ta - cb / tb) * (nv - v)), 0) as ws, max(ta) as ns, max(tb) as nt from r group by feature)"""


@BOOK.query("d2_d3_ks_wasserstein", f"{ECDF} select feature, {rnd('ks')} as ks, {rnd('ws')} as wasserstein, {big('ns')} as n_source, {big('nt')} as n_target from k")
def _(spark, d):
    return rounded(drift.ecdf_distance(view(spark, d, "vectors"), V3, "family", "N", "R").drop("ks_pvalue"))


@BOOK.query("d4_benign_ratio_drift", f"{VEC}, " + "p as (select *, case when source_file in ('part-0', 'part-1') then 'train' else 'test' end as split from vectors), " + "x as (" + " union all ".join(
    f"select '{f}' as feature, avg({f}) filter (where split = 'train' and y = 0) as a, avg({f}) filter (where split = 'test' and y = 0) as b from p" for f in V3
) + f") select feature, {rnd('a')} as train_mean, {rnd('b')} as test_mean, {rnd('b / nullif(a, 0)')} as ratio from x")
def _(spark, d):
    split = F.when(F.col("source_file").isin("part-0", "part-1"), "train").otherwise("test")
    return rounded(drift.benign_ratio(view(spark, d, "vectors").withColumn("split", split), V3, "split", "y"))


PAR = f"""{VEC}, a as (select row_id, f1, f2 from vectors where f3 <> 0.01), b as (select row_id, f1 * 1.0001 as f1, f2 from vectors where f3 <> 0.02), j as (select a.f1 as a1, b.f1 as b1, a.f2 as a2, b.f2 as b2, a.row_id is null or b.row_id is null as lone from a full join b on a.row_id = b.row_id)"""


@BOOK.query("d5_feature_parity", f"{PAR} " + " union all ".join(
    f"select 'f{i}' as feature, count(abs(a{i} - b{i})) as compared, {rnd(f'max(abs(a{i} - b{i}))')} as max_abs_error, {rnd(f'avg(abs(a{i} - b{i}))')} as mean_abs_error, {rnd(f'max(abs(a{i} - b{i}) / greatest(abs(a{i}), 1e-12))')} as max_rel_error, max(abs(a{i} - b{i})) <= {tol} as passed, count(*) filter (where lone) as unmatched from j"
    for i, tol in ((1, 0.001), (2, 0.001))))
def _(spark, d):
    df = view(spark, d, "vectors")
    a = df.filter("f3 <> 0.01").select("row_id", "f1", "f2")
    b = df.filter("f3 <> 0.02").select("row_id", (F.col("f1") * 1.0001).alias("f1"), "f2")
    return rounded(drift.feature_parity(a, b, ["row_id"], {"f1": 0.001, "f2": 0.001}))


def noise(i: int) -> str:
    return f"((('0x' || substr(md5(concat(seq, '-7-{i}')), 1, 12))::bigint + 0.5) / 281474976710656.0)"


PERTURBED = f"{cte('scored_events')}, p as (select *, greatest(least(score + sqrt(-2.0 * ln({noise(1)})) * cos(6.283185307179586 * {noise(2)}) * 0.1 + 0.05, 1.0), 0.0) as s from scored_events)"


def perturbed(spark, d):
    return drift.perturb_scores(view(spark, d, "scored_events"), "score", 7, sigma=0.1, shift=0.05, volume=10.0)


@BOOK.query("d6_score_perturbation", f"{PERTURBED} select seq, {rnd('s', 5)} as score, {rnd('flow_bytes_per_s * 10', 3)} as flow_bytes_per_s from p")
def _(spark, d):
    got = perturbed(spark, d)
    return got.select("seq", (F.round("score", 5) + 0.0).alias("score"), (F.round("flow_bytes_per_s", 3) + 0.0).alias("flow_bytes_per_s"))


@BOOK.query("d6_perturbed_policy", f"""{PERTURBED}, a as (select y, case when s >= 0.75 then 3 when s >= 0.40 then 2 else 0 end as act from p),
c as (select y, act, case when y = 1 then [100.0, 12.0, 6.0, 2.0][act + 1] else [0.0, 1.0, 15.0, 60.0][act + 1] end as cost from a)
select count(*) as steps, {rnd('sum(cost)')} as base_cost, {rnd('avg(cost)')} as mean_cost, count(*) filter (where y = 1 and act >= 2) as contained_attacks, count(*) filter (where y = 1 and act < 2) as uncontained_attacks from c""")
def _(spark, d):
    acted = perturbed(spark, d).withColumn("enforced", policy.two_tier(F.col("score")))
    got = policy.run_metrics(policy.cost_join(acted, "enforced", "y", "standard_enterprise").withColumn("total_cost", F.col("base_cost")))
    return rounded(got.select("steps", F.col("total_cost").alias("base_cost"), "mean_cost", "contained_attacks", "uncontained_attacks"))
