"""Detector quality on the scored table: A14 to A24, M1 to M18, P14 to P16, J1, J2, J8, T1, T2, W19."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake.operators import bootstrap, metrics, ml
from flowlake.queries.book import Book, big, rnd, rounded
from flowlake.sources.views import cte, view

BOOK = Book()
S = cte("scored")


def scored(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "scored").withColumn("pred", (F.col("score") >= 0.5).cast("int"))


#: Threshold metrics from tn, fp, fn, tp, each as the textbook defines it.
RATES = f"""
  {big('tn + fp + fn + tp')} as n,
  {rnd('(tp + tn) / nullif(tn + fp + fn + tp, 0)')} as accuracy,
  {rnd('case when tp + fp > 0 then tp / (tp + fp) else 0 end')} as precision,
  {rnd('case when tp + fn > 0 then tp / (tp + fn) else 0 end')} as recall,
  {rnd('case when tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end')} as f1,
  {rnd('case when tn + fn > 0 then tn / (tn + fn) else 0 end')} as benign_precision,
  {rnd('case when tn + fp > 0 then tn / (tn + fp) else 0 end')} as benign_recall,
  {rnd('case when tn + fp + fn > 0 then 2 * tn / (2 * tn + fp + fn) else 0 end')} as benign_f1,
  {rnd('''((case when tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end) + (case when tn + fp + fn > 0 then 2 * tn / (2 * tn + fp + fn) else 0 end))
     / ((case when tp + fp + fn > 0 then 1 else 0 end) + (case when tn + fp + fn > 0 then 1 else 0 end))''')} as macro_f1,
  {rnd('''((case when tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end) * (tp + fn) + (case when tn + fp + fn > 0 then 2 * tn / (2 * tn + fp + fn) else 0 end) * (tn + fp))
     / (tn + fp + fn + tp)''')} as weighted_f1,
  {rnd('''((case when tp + fn > 0 then tp / (tp + fn) else 0 end) + (case when tn + fp > 0 then tn / (tn + fp) else 0 end))
     / ((case when tp + fn > 0 then 1 else 0 end) + (case when tn + fp > 0 then 1 else 0 end))''')} as balanced_accuracy,
  {rnd('case when tn + fp > 0 then tn / (tn + fp) end')} as specificity,
  {rnd('case when tn + fp > 0 then fp / (tn + fp) end')} as fpr,
  {rnd('case when tp + fn > 0 then fn / (tp + fn) end')} as fnr
"""
CELLS = "{tn} as tn, {fp} as fp, {fn} as fn, {tp} as tp".format(**{c: big(c) for c in ("tn", "fp", "fn", "tp")})


def counts(pred: str, y: str = "y") -> str:
    cell = lambda t, p: f"count(*) filter (where {y} = {t} and ({pred}) = {p})"
    return f"{cell(0, 0)} as tn, {cell(0, 1)} as fp, {cell(1, 0)} as fn, {cell(1, 1)} as tp"


HARD = "case when score >= 0.5 then 1 else 0 end"


@BOOK.query("a14_confusion", f"{S} select {counts(HARD)} from scored")
def _(spark, d):
    return metrics.confusion(scored(spark, d))


@BOOK.query("a15_binary_metrics", f"{S}, c as (select family, {counts(HARD)} from scored group by family) select family, {CELLS}, {RATES} from c")
def _(spark, d):
    return rounded(metrics.binary_metrics(scored(spark, d), keys=["family"]))


PREDICTED = "case when score >= 5 then 'RF' when score >= 2 then 'NO' else 'AF' end"
MULTI = f"{S}, p as (select family as actual, {PREDICTED} as predicted from scored)"
PER_CLASS = f"""{MULTI}, names as (select actual as cls from p union select predicted from p),
k as (select cls, (select count(*) from p where actual = cls) as support, (select count(*) from p where predicted = cls) as predicted,
  (select count(*) from p where actual = cls and predicted = cls) as tp from names),
per as (select cls, support, predicted, tp, case when predicted > 0 then tp / predicted else 0 end as pr,
  case when support > 0 then tp / support else 0 end as rc,
  case when support + predicted > 0 then 2 * tp / (support + predicted) else 0 end as f from k)"""


def multi(spark, d):
    guess = F.when(F.col("score") >= 5, "RF").when(F.col("score") >= 2, "NO").otherwise("AF")
    return view(spark, d, "scored").withColumn("guess", guess)


@BOOK.query("a16_multiclass_matrix", f"{MULTI} select actual, predicted, count(*) as n from p group by all")
def _(spark, d):
    return metrics.multiclass_matrix(multi(spark, d), "family", "guess")


@BOOK.query("a16_multiclass_metrics", f"{PER_CLASS} select cls, {big('support')} as support, {big('predicted')} as predicted, {big('tp')} as tp, {rnd('pr')} as precision, {rnd('rc')} as recall, {rnd('f')} as f1 from per")
def _(spark, d):
    return rounded(metrics.multiclass_metrics(multi(spark, d), "family", "guess"))


@BOOK.query("a16_multiclass_summary", f"""{PER_CLASS}, med as (select quantile_cont(support, 0.5) as m from per where support > 0)
select {rnd('sum(tp) / sum(support)')} as accuracy, {rnd('avg(pr)')} as macro_precision, {rnd('avg(rc)')} as macro_recall, {rnd('avg(f)')} as macro_f1,
  {rnd('sum(f * support) / sum(support)')} as weighted_f1,
  {rnd("coalesce(avg(rc) filter (where cls <> 'NO' and support > 0 and support <= m), 0)")} as rare_recall from per, med""")
def _(spark, d):
    return rounded(metrics.multiclass_summary(metrics.multiclass_metrics(multi(spark, d), "family", "guess"), "NO"))


# families that mix labels, and one with a dash that has to be cleaned
MIXED = "case when l_linenumber <= 2 then concat('line', chr(8211), 'a') when l_linenumber = 3 then family else 'zero' end"


@BOOK.query("a17_family_metrics", f"""{S}, b as (select replace({MIXED}, chr(8211), '-') as family, case when {MIXED} = 'zero' then 0 else y end as y, {HARD} as pred from scored),
g as (select family, max(y) as a, count(*) as support, {counts('pred')} from b group by family)
select family, {big('a')} as is_attack, support, {big('case when a = 1 then tp else tn end')} as correct, {big('case when a = 1 then 0 else fp end')} as fp,
 {big('case when a = 1 then fn else 0 end')} as fn, {rnd('(case when a = 1 then tp else tn end) / support')} as detection_rate,
 {rnd('(case when a = 1 then fn else fp end) / support')} as error_rate from g""")
def _(spark, d):
    mixed = F.when(F.col("l_linenumber") <= 2, "line–a").when(F.col("l_linenumber") == 3, F.col("family")).otherwise("zero")
    df = scored(spark, d).withColumn("family", mixed)
    return rounded(metrics.family_metrics(df.withColumn("y", F.when(F.col("family") == "zero", 0).otherwise(F.col("y"))), "family"))


CELL = "case when y = 1 then (case when score >= 0.5 then 'TP' else 'FN' end) else (case when score >= 0.5 then 'FP' else 'TN' end) end"


@BOOK.query("a18_confidence_distribution", f"""{S} select {CELL} as outcome, count(*) as n, {rnd('avg(score)')} as mean, {rnd('stddev_pop(score)')} as std,
 {rnd('min(score)')} as min, {rnd('max(score)')} as max, {rnd('quantile_cont(score, 0.25)')} as p25, {rnd('quantile_cont(score, 0.5)')} as median,
 {rnd('quantile_cont(score, 0.75)')} as p75 from scored group by 1""")
def _(spark, d):
    return rounded(metrics.confidence_distribution(scored(spark, d)))


@BOOK.query("a19_duplicate_breakdown", f"""{S}, v as (select *, count(*) over (partition by l_quantity, l_discount, l_tax) as copies from scored),
c as (select copies > 1 as is_duplicate, {counts(HARD)} from v group by 1) select is_duplicate, {CELLS}, {RATES} from c""")
def _(spark, d):
    return rounded(metrics.duplicate_breakdown(scored(spark, d), ["l_quantity", "l_discount", "l_tax"]))


P3 = "case when score >= 0.5 then 1 else 0 end as pa, case when score_b >= 0.5 then 1 else 0 end as pb, case when score_c >= 0.5 then 1 else 0 end as pf"


@BOOK.query("a20_disagreement", f"""{S}, t as (select y, {P3} from scored) select count(*) as n, count(*) filter (where pa <> pb) as disagreements,
 count(*) filter (where pa = 1 and pb = 0 and y = 1) as a_only_right, count(*) filter (where pa = 1 and pb = 0 and y = 0) as a_only_false_alarm,
 count(*) filter (where pb = 1 and pa = 0 and y = 1) as b_only_right, count(*) filter (where pb = 1 and pa = 0 and y = 0) as b_only_false_alarm,
 count(*) filter (where (pa = y) <> (pb = y) and pf = y) as fusion_rescues, count(*) filter (where pa <> y and pb <> y and pf = y) as fusion_rescues_both_wrong,
 count(*) filter (where pa = y and pb = y and pf <> y) as fusion_degradations,
 {rnd('avg(case when pf = y then 1.0 else 0.0 end) filter (where pa <> pb)')} as fusion_accuracy_on_disagreements from t""")
def _(spark, d):
    return rounded(metrics.disagreement(scored(spark, d), "y", "score", "score_b", "score_c"))


@BOOK.query("a20_agreement_cube", f"""{S}, t as (select case when (score >= 0.5) = (y = 1) then 1 else 0 end as a_right, case when (score_b >= 0.5) = (y = 1) then 1 else 0 end as b_right, y as truth from scored)
select {big('a_right')} as a_right, {big('b_right')} as b_right, {big('truth')} as truth, {big('grouping(a_right, b_right, truth)')} as level, count(*) as n from t group by cube (a_right, b_right, truth)""")
def _(spark, d):
    return rounded(metrics.agreement_cube(scored(spark, d), "y", "score", "score_b"))


UNIT = f"{S}, u as (select y, l_discount * 10 as s from scored)"
BINS = f"""{UNIT}, e as (select i as bin, i / 10.0 as lower, (i + 1) / 10.0 as upper from range(10) t(i)),
c as (select e.bin, count(u.s) as n, avg(u.s) as mp, avg(u.y) as ob from e left join u on (u.s >= cast(e.lower as double) or e.bin = 0) and (u.s < cast(e.upper as double) or e.bin = 9) group by e.bin)"""


def unit(spark, d):
    return view(spark, d, "scored").select("y", (F.col("l_discount") * 10).alias("s"))


@BOOK.query("a21_reliability", f"{BINS} select {big('bin')} as bin, {rnd('bin / 10.0')} as lower, {rnd('(bin + 1) / 10.0')} as upper, n, {rnd('mp')} as mean_predicted, {rnd('ob')} as observed, {rnd('mp - ob')} as gap from c")
def _(spark, d):
    return rounded(metrics.reliability(unit(spark, d), "y", "s"))


@BOOK.query("a22_brier_ece", f"{BINS} select (select {rnd('avg((s - y) * (s - y))')} from u) as brier, {rnd('sum(n * coalesce(abs(mp - ob), 0)) / sum(n)')} as ece from c")
def _(spark, d):
    return rounded(metrics.brier_ece(unit(spark, d), "y", "s"))


RUNS = f"{S}, runs as (select family as model, l_linenumber as seed, avg(score) as m1, avg(score_b) as m2 from scored group by all)"


@BOOK.query("a23_run_summary", " union all ".join(
    f"(select model, '{m}' as metric, {rnd(f'avg({m})')} as mean, {rnd(f'stddev_pop({m})')} as std, {rnd(f'min({m})')} as min, {rnd(f'max({m})')} as max, count({m}) as n from runs group by model)"
    if i else f"{RUNS} (select model, '{m}' as metric, {rnd(f'avg({m})')} as mean, {rnd(f'stddev_pop({m})')} as std, {rnd(f'min({m})')} as min, {rnd(f'max({m})')} as max, count({m}) as n from runs group by model)"
    for i, m in enumerate(("m1", "m2"))))
def _(spark, d):
    runs = view(spark, d, "scored").groupBy(F.col("family").alias("model"), F.col("l_linenumber").alias("seed"))
    runs = runs.agg(F.avg("score").alias("m1"), F.avg("score_b").alias("m2"))
    return rounded(metrics.run_summary(runs, ["m1", "m2"]).drop("values"))


@BOOK.query("a24_latency_summary", f"""{S} select family, count(*) as n, {rnd('min(l_extendedprice)')} as min, {rnd('avg(l_extendedprice)')} as mean, {rnd('max(l_extendedprice)')} as max,
 {rnd('quantile_cont(l_extendedprice, 0.5)')} as p50, {rnd('quantile_cont(l_extendedprice, 0.95)')} as p95, {rnd('quantile_cont(l_extendedprice, 0.99)')} as p99 from scored group by family""")
def _(spark, d):
    return rounded(metrics.latency_summary(view(spark, d, "scored"), "family", "l_extendedprice"))


# ---- curves --------------------------------------------------------------------------------------


def curve(score: str, keys: str = "", source: str = "scored") -> str:
    """Per distinct score the rates of everything at or above it; ``auc`` and ``ap`` sum over them."""
    k, part = (f"{keys}, ", f"partition by {keys}") if keys else ("", "")
    return f"""pts as (select {k}{score} as s, sum(case when y = 1 then 1 else 0 end) as p, sum(case when y = 0 then 1 else 0 end) as q from {source} group by all),
cum as (select *, sum(p) over ({part} order by s desc) as ptop, sum(q) over ({part} order by s desc) as qtop,
  sum(q) over ({part} order by s) - q as below, sum(p) over ({part}) as np, sum(q) over ({part}) as nq from pts)"""


AUC = f"{rnd('case when max(np) > 0 and max(nq) > 0 then sum(p * (below + q / 2)) / (max(np) * max(nq)) end')} as roc_auc"
AP = f"{rnd('case when max(np) > 0 and max(nq) > 0 then sum(p * ptop / (ptop + qtop)) / max(np) end')} as pr_auc"


@BOOK.query("m1_roc_auc", f"{S}, {curve('score')} select {big('max(np)')} as n_pos, {big('max(nq)')} as n_neg, {AUC}, {AP} from cum")
def _(spark, d):
    return rounded(metrics.auc(view(spark, d, "scored")))


@BOOK.query("m2_pr_auc_by_line", f"{S}, {curve('score_c', 'l_linenumber')} select {big('l_linenumber')} as l_linenumber, {big('max(np)')} as n_pos, {big('max(nq)')} as n_neg, {AUC}, {AP} from cum group by l_linenumber")
def _(spark, d):
    return rounded(metrics.auc(view(spark, d, "scored"), score="score_c", keys=["l_linenumber"]))


@BOOK.query("m4_evaluate", f"""{S}, {curve('score')}, c as (select {counts(HARD)} from scored)
select {CELLS}, cast(null as varchar) as refused, {RATES}, (select {AUC.rsplit(' as ', 1)[0]} from cum) as roc_auc, (select {AP.rsplit(' as ', 1)[0]} from cum) as pr_auc from c""")
def _(spark, d):
    return rounded(metrics.evaluate(view(spark, d, "scored")))


SWEEP = f"""{S}, t as (select i, i / 100.0 as threshold from range(101) g(i)),
sw as (select t.i, count(*) filter (where y = 0 and s < i / 100) as tn, count(*) filter (where y = 0 and s >= i / 100) as fp,
 count(*) filter (where y = 1 and s < i / 100) as fn, count(*) filter (where y = 1 and s >= i / 100) as tp from t, (select y, l_discount * 10 as s from scored) u group by t.i)"""


@BOOK.query("m5_threshold_sweep", f"{SWEEP} select {rnd('i / 100')} as threshold, {CELLS}, {RATES} from sw")
def _(spark, d):
    return rounded(metrics.threshold_sweep(unit(spark, d), "y", "s"))


@BOOK.query("m6_operating_points", f"""{SWEEP}, x as (select i / 100 as threshold, case when tp + fp > 0 then tp / (tp + fp) else 0 end as precision, case when tp + fn > 0 then tp / (tp + fn) else 0 end as recall,
 case when tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end as f1, fp / (tn + fp) as fpr, fn / (tp + fn) as fnr, fp + 10 * fn as cost from sw),
o as (select 'max_f1' as objective, (select threshold from x order by f1 desc, threshold limit 1) as threshold
 union all select 'min_fpr_at_recall', (select threshold from x where recall >= 0.95 order by fpr, threshold limit 1)
 union all select 'min_fnr_at_fpr', (select threshold from x where fpr <= 0.01 order by fnr, threshold limit 1)
 union all select 'min_cost', (select threshold from x order by cost, threshold limit 1))
select objective, {rnd('o.threshold')} as threshold, {rnd('precision')} as precision, {rnd('recall')} as recall, {rnd('f1')} as f1, {rnd('fpr')} as fpr, {rnd('fnr')} as fnr, {rnd('cost')} as cost from o left join x on o.threshold = x.threshold""")
def _(spark, d):
    return rounded(metrics.operating_points(metrics.threshold_sweep(unit(spark, d), "y", "s")))


@BOOK.query("m7_recall_at_fpr", f"{S}, {curve('score_c', 'family')} select family, {rnd('coalesce(max(ptop / nullif(np, 0)) filter (where qtop / nullif(nq, 0) <= 0.1), 0)')} as recall_at_fpr from cum group by family")
def _(spark, d):
    return rounded(metrics.recall_at_fpr(view(spark, d, "scored"), 0.1, score="score_c", keys=["family"]))


# ---- bootstrap: the same hashed weights in both dialects ------------------------------------------------

BUCKET = f"cast(('0x' || substr(md5(cast({{}} as varchar)), 1, 8)) as bigint) % {bootstrap.BUCKETS}"
UNIFORM = "cast(('0x' || substr(md5({}), 1, 13)) as bigint) / 4503599627370496.0"
WEIGHTS = f"""draws as (select k.range as bucket, r.range as b, {UNIFORM.format(f"'{bootstrap.SEED}|' || k.range || '|' || r.range")} as u from range({bootstrap.BUCKETS}) k, range({bootstrap.RESAMPLES}) r),
weights as (select * from (select bucket, b, {' + '.join(f'(u >= {c!r})::int' for c in bootstrap.POISSON_ONE)} as w from draws) where w > 0)"""
OUTCOMES = {"tn": (0, "<"), "fp": (0, ">="), "fn": (1, "<"), "tp": (1, ">=")}


def outcome_sums(score: str, suffix: str = "") -> str:
    return ", ".join(f"count(*) filter (where y = {y} and {score} {op} 0.5) as {c}{suffix}" for c, (y, op) in OUTCOMES.items())


def resampled_sql(columns: list[str]) -> str:
    return f"{WEIGHTS}, per as (select b, {', '.join(f'cast(sum(w * {c}) as double) as {c}' for c in columns)} from weights join sums using (bucket) group by b)"


def rate_pairs(x: str = "") -> dict[str, str]:
    over = lambda a, b: f"coalesce(({a}) / nullif({b}, 0), 0)"
    tn, fp, fn, tp = (f"{c}{x}" for c in OUTCOMES)
    return {
        "accuracy": over(f"{tp} + {tn}", f"{tn} + {fp} + {fn} + {tp}"), "precision": over(tp, f"{tp} + {fp}"), "recall": over(tp, f"{tp} + {fn}"),
        "f1": over(f"2 * {tp}", f"2 * {tp} + {fp} + {fn}"), "fpr": over(fp, f"{fp} + {tn}"),
    }


def long_sql(source: str, values: dict[str, str], name: str = "metric") -> str:
    return " union all ".join(f"select '{m}' as {name}, {v} as value from {source}" for m, v in values.items())


INTERVAL = f"""metric, {rnd('quantile_cont(value, 0.025)')} as ci_lower, {rnd('quantile_cont(value, 0.975)')} as ci_upper, {rnd('avg(value)')} as mean, {rnd('stddev_pop(value)')} as std, count(*) as resamples"""
PAIRED = f"""{rnd('quantile_cont(value, 0.025)')} as ci_lower, {rnd('quantile_cont(value, 0.975)')} as ci_upper, count(*) as resamples,
 {rnd('least(1, 2 * least(avg((value <= 0)::int), avg((value >= 0)::int)))')} as p_value, quantile_cont(value, 0.025) > 0 or quantile_cont(value, 0.975) < 0 as significant"""


@BOOK.query("m8_bootstrap_ci", f"""{S}, sums as (select {BUCKET.format('row_id')} as bucket, {outcome_sums('score')} from scored group by 1), {resampled_sql(list(OUTCOMES))},
v as ({long_sql('per', rate_pairs())}) select {INTERVAL} from v group by metric""")
def _(spark, d):
    return rounded(bootstrap.metric_ci(view(spark, d, "scored")))


@BOOK.query("m9_bootstrap_counts_ci", f"""{S}, counts as (select {outcome_sums('score')} from scored), cells as ({' union all '.join(f"select '{c}' as cell, {c} as n from counts" for c in OUTCOMES)}),
ends as (select distinct n, greatest(0, floor(n - 9 * sqrt(n) - 12))::bigint as lo, ceil(n + 9 * sqrt(n) + 12)::bigint as hi from cells),
steps as (select n, lo, unnest(generate_series(lo, hi)) as k from ends),
terms as (select n, lo, k, case when n = 0 and k > 0 then 0 else exp(sum(case when k = lo or n = 0 then 0.0 else ln(n / k) end) over (partition by n order by k)) end as term from steps),
cdf as (select n, lo, k, sum(term) over (partition by n order by k) / sum(term) over (partition by n) as x from terms),
us as (select cell, n, r.range as b, {UNIFORM.format(f"'{bootstrap.SEED}|' || cell || '|' || r.range")} as u from cells, range({bootstrap.RESAMPLES}) r),
ws as (select cell, b, case when c.k is null then e.lo else c.k + 1 end as w from us join ends e on e.n = us.n asof left join cdf c on c.n = us.n and us.u >= c.x),
per as (select b, {', '.join(f"cast(sum(w) filter (where cell = '{c}') as double) as {c}" for c in OUTCOMES)} from ws group by b),
v as ({long_sql('per', rate_pairs())}) select {INTERVAL} from v group by metric""")
def _(spark, d):
    return rounded(bootstrap.counts_ci(scored(spark, d)))


@BOOK.query("m10_bootstrap_auc_ci")
def _(spark, d):
    return rounded(bootstrap.auc_ci(view(spark, d, "scored")))


DELTA = {m: f"{a} - {b}" for (m, a), b in zip(rate_pairs("_a").items(), rate_pairs("_b").values(), strict=True)}


@BOOK.query("m11_paired_comparison", f"""{S}, sums as (select {BUCKET.format('row_id')} as bucket, {outcome_sums('score', '_a')}, {outcome_sums('score_b', '_b')} from scored group by 1),
{resampled_sql([f'{c}{x}' for x in ('_a', '_b') for c in OUTCOMES])}, v as ({long_sql('per', DELTA)}),
whole as (select {', '.join(f'sum({c}{x})::double as {c}{x}' for x in ('_a', '_b') for c in OUTCOMES)} from sums), p as ({long_sql('whole', DELTA)})
select metric, {rnd('max(p.value)')} as delta, t.* exclude (metric) from p join (select metric, {PAIRED} from v group by metric) t using (metric) group by all""")
def _(spark, d):
    return rounded(bootstrap.paired_comparison(view(spark, d, "scored"), "y", "score", "score_b"))


COST = "case when {0} >= 0.5 and y = 0 then 15.0 when {0} < 0.5 and y = 1 then 100.0 else 0.0 end"


@BOOK.query("m12_paired_cost_comparison", f"""{S}, sums as (select {BUCKET.format('row_id')} as bucket, count(*)::double as n, sum({COST.format('score')} - {COST.format('score_b')})::double as d from scored group by 1),
{resampled_sql(['n', 'd'])}, v as (select d / n as value from per) select 'mean_cost' as metric, {rnd('(select sum(d) / sum(n) from sums)')} as delta, {PAIRED} from v""")
def _(spark, d):
    log = view(spark, d, "scored").select(F.col("row_id").alias("seq"), "y", "score", "score_b")
    cost = lambda s: F.when((F.col(s) >= 0.5) & (F.col("y") == 0), 15.0).when((F.col(s) < 0.5) & (F.col("y") == 1), 100.0).otherwise(0.0)
    a, b = (log.select("seq", cost(s).alias("total_cost")) for s in ("score", "score_b"))
    return rounded(bootstrap.paired_cost_comparison(a, b))


FUSED = "coalesce(0.6 * score + 0.4 * case when l_linenumber = 1 then null else score_b end, score)"


@BOOK.query("m13_fusion", f"{S} select l_linenumber, count(*) as n, {rnd(f'avg({FUSED})')} as mean_fused, {rnd(f'max({FUSED})')} as max_fused from scored group by l_linenumber")
def _(spark, d):
    b = F.when(F.col("l_linenumber") != 1, F.col("score_b"))
    fused = metrics.fuse(F.col("score"), b, 0.6)
    out = view(spark, d, "scored").groupBy("l_linenumber").agg(F.count("*").alias("n"), F.avg(fused).alias("mean_fused"), F.max(fused).alias("max_fused"))
    return rounded(out.withColumn("l_linenumber", F.col("l_linenumber")))


@BOOK.query("m14_tune_alpha", f"""{S}, g as (select i / 10 as alpha from range(11) t(i)), u as (select alpha, y, alpha * score_c + (1.0 - alpha) * score_b as m from scored, g), {curve('m', 'alpha', 'u')},
r as (select alpha, max(np) as np, max(nq) as nq, sum(p * (below + q / 2)) / (max(np) * max(nq)) as auc, sum(p * ptop / (ptop + qtop)) / max(np) as ap from cum group by alpha),
b as (select alpha as best_alpha from r order by round(auc, 9) desc, round(abs(alpha - 0.5), 9), alpha limit 1)
select {rnd('alpha')} as alpha, {big('np')} as n_pos, {big('nq')} as n_neg, {rnd('auc')} as roc_auc, {rnd('ap')} as pr_auc, {rnd('best_alpha')} as best_alpha, alpha = best_alpha as is_best from r, b""")
def _(spark, d):
    return rounded(metrics.tune_alpha(view(spark, d, "scored"), "y", "score_c", "score_b"))


@BOOK.query("m15_compare_components", f"""{S}, u as (select 'a' as model, y, score as s from scored union all select 'b', y, score_b from scored union all select 'fused', y, 0.5 * score + 0.5 * score_b from scored),
{curve('s', 'model', 'u')}, c as (select model, {counts('case when s >= 0.5 then 1 else 0 end')} from u group by model), r as (select model, {AUC}, {AP} from cum group by model)
select c.model, {CELLS}, {RATES}, roc_auc, pr_auc from c join r on c.model = r.model""")
def _(spark, d):
    scores = {"a": F.col("score"), "b": F.col("score_b"), "fused": metrics.fuse(F.col("score"), F.col("score_b"), 0.5)}
    return rounded(metrics.compare_components(view(spark, d, "scored"), "y", scores))


@BOOK.query("m16_platt")
def _(spark, d):
    df = view(spark, d, "scored")
    slope, intercept = ml.platt(df, "score_c", "y")
    return rounded(df.groupBy("family").agg(F.avg(ml.apply_platt(F.col("score_c"), slope, intercept)).alias("mean_probability")), 4)


@BOOK.query("m17_degradation", f"""{S}, m as (select family as model, l_linenumber <= 3 as src, avg(score) as f1, avg(score_b) as fpr from scored group by all)
select a.model, {rnd('a.f1')} as source_f1, {rnd('a.fpr')} as source_fpr, {rnd('b.f1')} as target_f1, {rnd('b.fpr')} as target_fpr, {rnd('b.f1 - a.f1')} as delta_f1, {rnd('b.fpr - a.fpr')} as delta_fpr
from m a join m b on a.model = b.model and a.src and not b.src""")
def _(spark, d):
    df = view(spark, d, "scored")
    table = lambda rows: rows.groupBy(F.col("family").alias("model")).agg(F.avg("score").alias("f1"), F.avg("score_b").alias("fpr"))
    early, late = df.filter("l_linenumber <= 3"), df.filter("l_linenumber > 3")
    return rounded(metrics.degradation(table(early), table(late), ["f1", "fpr"]))


@BOOK.query("m18_family_auc", f"""{S}, f as (select distinct family as fam from scored where family <> 'NO'), u as (select fam, 1 as y, score_c as s from scored join f on family = fam union all select fam, 0, score_c from scored, f where family = 'NO'),
{curve('s', 'fam', 'u')} select fam as family, {big('max(np)')} as n_pos, {big('max(nq)')} as n_neg, {AUC}, {AP} from cum group by fam""")
def _(spark, d):
    return rounded(metrics.family_auc(view(spark, d, "scored"), "family", "NO", "score_c"))


@BOOK.query("w19_score_rank", f"""{S}, c as (select family, score as score, count(*) as n from scored group by all)
select family, {rnd('score')} as score, n, {rnd('sum(n) over (partition by family order by score) - n + (n + 1) / 2')} as avg_rank from c""")
def _(spark, d):
    return rounded(metrics.rank_average(view(spark, d, "scored"), "score", ["family"]))


# ---- predicates, joins and examples --------------------------------------------------------------


@BOOK.query("p14_threshold_predict", f"{S} select l_linenumber, count(*) filter (where score >= 0.50) as research, count(*) filter (where score >= 0.40) as operational from scored group by l_linenumber")
def _(spark, d):
    df = metrics.threshold_predict(view(spark, d, "scored"), "score", {"research": 0.50, "operational": 0.40})
    return rounded(df.groupBy("l_linenumber").agg(F.sum("research").alias("research"), F.sum("operational").alias("operational")))


@BOOK.query("p15_outcome_class", f"""{S}, o as (select case when l_linenumber = 7 then 'UNVERIFIED' when y = {HARD} then 'CORRECT' when {HARD} = 1 then 'FALSE_POSITIVE' else 'FALSE_NEGATIVE' end as outcome from scored)
select outcome, count(*) as n from o group by outcome""")
def _(spark, d):
    df = scored(spark, d).withColumn("y", F.when(F.col("l_linenumber") != 7, F.col("y")))
    return df.groupBy(metrics.outcome(F.col("y"), F.col("pred")).alias("outcome")).agg(F.count("*").alias("n"))


@BOOK.query("p16_score_bands", f"""{S} select count(*) filter (where score < 0.40) as low, count(*) filter (where score >= 0.40 and score < 0.65) as medium, count(*) filter (where score >= 0.65) as high,
 count(*) filter (where score < 0.50) as informational_b, count(*) filter (where score >= 0.50 and score < 0.65) as low_b, count(*) filter (where score >= 0.65 and score < 0.85) as medium_b,
 count(*) filter (where score >= 0.85) as high_b, {rnd('avg(score)')} as mean, {rnd('min(score)')} as min, {rnd('max(score)')} as max, {rnd('quantile_cont(score, 0.5)')} as median from scored""")
def _(spark, d):
    return rounded(metrics.score_bands(view(spark, d, "scored")))


SIDES = f"{S}, a as (select row_id, score from scored where l_linenumber <> 2), b as (select row_id, score_b from scored where l_linenumber <> 5)"


def sides(spark, d):
    df = view(spark, d, "scored")
    return df.filter("l_linenumber <> 2").select("row_id", "score"), df.filter("l_linenumber <> 5").select("row_id", "score_b")


@BOOK.query("j1_score_align_inner", f"{SIDES} select count(*) as aligned, (select count(*) from a where row_id not in (select row_id from b)) as dropped_a, (select count(*) from b where row_id not in (select row_id from a)) as dropped_b from a join b using (row_id)")
def _(spark, d):
    return metrics.align_inner(*sides(spark, d))[1]


@BOOK.query("j2_score_align_strict", f"{SIDES} select row_id, 'a' as side from a where row_id not in (select row_id from b) union all select row_id, 'b' from b where row_id not in (select row_id from a)")
def _(spark, d):
    return metrics.align_strict(*sides(spark, d))


@BOOK.query("j8_multi_model_join", f"{S} select row_id, {rnd('score')} as rf, {rnd('score_b')} as lstm from scored")
def _(spark, d):
    df = view(spark, d, "scored")
    long = df.select("row_id", F.lit("rf").alias("model"), "score").union(df.select("row_id", F.lit("lstm"), "score_b"))
    return rounded(metrics.widen_scores(long, ["rf", "lstm"]))


@BOOK.query("t1_worst", f"""{S}, p as (select *, {HARD} as pred from scored) (select row_id, {rnd('score')} as score, 'FN' as kind from p where y = 1 and pred = 0 order by p.score, row_id limit 20)
 union all (select row_id, {rnd('score')} as score, 'FP' as kind from p where y = 0 and pred = 1 order by p.score desc, row_id limit 20)""")
def _(spark, d):
    return rounded(metrics.worst(scored(spark, d), 20).select("row_id", "score", "kind"))


@BOOK.query("t2_disagreement_examples", f"{S} select row_id, {rnd('score')} as score, {rnd('score_b')} as score_b from scored where (score >= 0.5) <> (score_b >= 0.5) order by row_id limit 25")
def _(spark, d):
    return rounded(metrics.disagreement_examples(view(spark, d, "scored"), 25, "score", "score_b").select("row_id", "score", "score_b"))
