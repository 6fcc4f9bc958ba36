"""Splits, leakage and samples: L4 to L6, L8 to L14, W12, J5, T5 to T8, U4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake.operators import events, ordered, sequences, splits
from flowlake.queries.book import Book, big, rnd, rounded
from flowlake.sources.views import cte, table, view

BOOK = Book()
VEC = cte("vectors")
V3 = ["f1", "f2", "f3"]


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "vectors")


def by_rank(n: str, first: float = 0.6, second: float = 0.8, names=("train", "validation", "test")) -> str:
    return f"case when rn <= round_even({n} * {first}, 0) then '{names[0]}' when rn <= round_even({n} * {second}, 0) then '{names[1]}' else '{names[2]}' end"


STRATIFIED = f"""{VEC}, r as (select *, row_number() over (partition by family order by md5(concat(row_id, '-42')), row_id) as rn, count(*) over (partition by family) as n from vectors),
parts as (select *, {by_rank('n')} as split from r)"""


def stratified(spark, d):
    return splits.stratified_split(vectors(spark, d), "family", "row_id")


@BOOK.query("l4_split_stratified", f"{STRATIFIED} select row_id, split from parts")
def _(spark, d):
    return stratified(spark, d).select("row_id", "split")


@BOOK.query("l5_split_grouped", f"""{VEC}, g as (select distinct grp from vectors), r as (select grp, row_number() over (order by md5(concat(grp, '-42')), grp) as rn, count(*) over () as n from g)
select row_id, {by_rank('n')} as split from vectors join r using (grp)""")
def _(spark, d):
    return splits.grouped_split(vectors(spark, d), "grp", "row_id").select("row_id", "split")


def cut(name: str, target: str, low: str, high: str) -> str:
    """The boundary next to the row at the target rank whose own rank is nearest; later ones win ties."""
    return f"""{name}_t as (select {target} as target, n, {low} as low, {high} as high from base),
{name}_row as (select us // 3600000000 * 3600000000 as h, us % 3600000000 = 0 as sharp, b.* from {name}_t b, o where o.rn = b.target + 1),
{name}_c as (select h + k * 3600000000 as boundary, low, high, target from {name}_row, range(-1, 2) t(k) where (k in (0, 1)) or sharp),
{name}_i as (select boundary, low, high, target, (select count(*) from o where us < boundary) as idx from {name}_c),
{name} as (select coalesce((select idx from {name}_i where idx > low and idx < high order by abs(idx - target), idx desc limit 1), (select target from {name}_t)) as cut)"""


TEMPORAL = """o as (select {id} as row_id, epoch_us({ts}) as us, row_number() over (order by {ts}, {id}) as rn from {source}),
base as (select count(*) as n from o), """


@BOOK.query("l6_split_temporal", f"with {TEMPORAL.format(id='event_id', ts='ts', source='events')} {cut('a', 'cast(round_even(n * 0.6, 0) as bigint)', '1', 'n - 2')}, {cut('b', 'cast(round_even(n * 0.8, 0) as bigint)', '(select cut + 1 from a)', 'n - 1')} "
            "select row_id, case when rn <= (select cut from a) then 'train' when rn <= (select cut from b) then 'validation' else 'test' end as split from o")
def _(spark, d):
    ev = table(spark, d, "events").select(F.col("event_id").alias("row_id"), F.col("ts").cast("timestamp").alias("ts"))
    return splits.temporal_split(ev, "ts", "row_id").select("row_id", "split")


@BOOK.query("w12_repair_timestamps", f"""{VEC}, b as (select row_id, source_file, case when f2 = 0.05 then null when f2 = 0.06 then timestamp '1990-01-01 00:00:00' else ts end as t from vectors),
m as (select *, max(t) filter (where t >= timestamp '2000-01-01 00:00:00') over (partition by source_file) as latest from b)
select row_id, epoch_us(case when t is null or t < timestamp '2000-01-01 00:00:00' then latest else t end) as us, t is null or t < timestamp '2000-01-01 00:00:00' as repaired from m""")
def _(spark, d):
    old = F.when(F.col("f2") == 0.05, F.lit(None).cast("timestamp")).when(F.col("f2") == 0.06, F.lit("1990-01-01 00:00:00").cast("timestamp")).otherwise(F.col("ts"))
    got = splits.repair_timestamps(vectors(spark, d).withColumn("ts", old), "ts", "source_file", ["row_id"])
    return got.select("row_id", F.unix_micros("ts").alias("us"), "repaired")


def overlap(keys: str, source: str = "parts") -> str:
    pair = lambda a, b: f"select '{a}' as split_a, '{b}' as split_b, count(*) filter (where n_{a} > 0 and n_{b} > 0) as shared_keys, {big(f'coalesce(sum(n_{a} + n_{b}) filter (where n_{a} > 0 and n_{b} > 0), 0)')} as shared_rows from k"
    counts = ", ".join(f"count(*) filter (where split = '{s}') as n_{s}" for s in splits.SPLITS)
    return f"k as (select {keys}, {counts} from {source} group by all) " + " union all ".join(pair(a, b) for a, b in (("train", "validation"), ("train", "test"), ("validation", "test")))


@BOOK.query("l8_leak_rows", f"{STRATIFIED}, {overlap('f1, f2, f3')}")
def _(spark, d):
    return splits.leak_rows(stratified(spark, d), V3)


@BOOK.query("l9_leak_near", f"{STRATIFIED}, {overlap('round(f1 * 1.01, 2) as a, round(f2, 2) as b, round(f3, 2) as c')}")
def _(spark, d):
    return splits.leak_near(stratified(spark, d).withColumn("f1", F.col("f1") * 1.01), V3, 2)


@BOOK.query("l10_leak_group", f"{STRATIFIED}, {overlap('grp')}")
def _(spark, d):
    return splits.leak_column(stratified(spark, d), "grp")


@BOOK.query("j5_split_overlap", f"{STRATIFIED}, {overlap('source_file, f1')}")
def _(spark, d):
    return splits.split_overlap(stratified(spark, d), ["source_file", "f1"])


@BOOK.query("l11_leak_time", f"""{STRATIFIED}, s as (select split, min(ts) as lo, max(ts) as hi from parts group by split)
select a.split as split_a, b.split as split_b, a.hi >= b.lo and b.hi >= a.lo as overlaps from s a, s b where (a.split, b.split) in (('train', 'validation'), ('train', 'test'), ('validation', 'test'))""")
def _(spark, d):
    return splits.leak_time(stratified(spark, d), "ts")


@BOOK.query("l12_leak_sequence", f"""{STRATIFIED}, w as (select row_number() over k as rn, min(split) over k5 as lo, max(split) over k5 as hi from parts window k as (partition by grp order by ts, row_id), k5 as (partition by grp order by ts, row_id rows between 4 preceding and current row))
select count(*) as windows, count(*) filter (where lo <> hi) as crossing from w where rn >= 5""")
def _(spark, d):
    got = sequences.sequence_windows(stratified(spark, d), ["grp"], ["ts", "row_id"], ordered.time_chunk("ts", ordered.DAY), ["f1"], split="split")
    return splits.leak_sequences(got)


@BOOK.query("l13_leak_report", f"""{STRATIFIED}, e as (select {', '.join(f"count(*) filter (where split = '{s}') > 0 as {s[0]}" for s in ('train', 'validation'))}, count(*) filter (where split = 'test') > 0 as x from parts group by f1, f2, f3),
rr as (select {', '.join(f"count(*) filter (where split = '{s}') > 0 as {s[0]}" for s in ('train', 'validation'))}, count(*) filter (where split = 'test') > 0 as x from parts group by round(f1, 6), round(f2, 6), round(f3, 6)),
g as (select {', '.join(f"count(*) filter (where split = '{s}') > 0 as {s[0]}" for s in ('train', 'validation'))}, count(*) filter (where split = 'test') > 0 as x from parts group by grp),
sp as (select split, min(ts) as lo, max(ts) as hi, count(*) as n from parts group by split),
w as (select row_number() over k as rn, min(split) over k5 as lo, max(split) over k5 as hi from parts window k as (partition by grp order by ts, row_id), k5 as (partition by grp order by ts, row_id rows between 4 preceding and current row)),
c as (select 'exact_rows' as "check", {big('sum((t and v)::int + (t and x)::int + (v and x)::int)')} as found from e union all select 'rounded_rows', {big('sum((t and v)::int + (t and x)::int + (v and x)::int)')} from rr
 union all select 'groups', {big('sum((t and v)::int + (t and x)::int + (v and x)::int)')} from g union all select 'source_ips', null
 union all select 'time_order', count(*) from sp a, sp b where (a.split, b.split) in (('train', 'validation'), ('train', 'test'), ('validation', 'test')) and a.hi >= b.lo and b.hi >= a.lo
 union all select 'sequences', count(*) filter (where lo <> hi) from w where rn >= 5)
select "check", found, case when found is null then 'NOT_PERFORMED' when found > 0 then 'FAILED' else 'PASSED' end as status from c
 union all select 'overall', (select count(*) from c where found > 0), case when (select count(*) from c where found > 0) > 0 then 'FAILED' else 'PASSED' end
 union all select concat('size_', split), n, 'INFO' from sp""")
def _(spark, d):
    df = stratified(spark, d)
    windows = sequences.sequence_windows(df, ["grp"], ["ts", "row_id"], ordered.time_chunk("ts", ordered.DAY), ["f1"], split="split")
    return splits.leak_report(df, V3, "grp", "src_ip", "ts", windows)


POLICY = f"""{STRATIFIED}, h as (select *, row_number() over (partition by family order by md5(concat(row_id, '-42')), row_id) as prn, count(*) over (partition by family) as pn from (select * exclude (rn, n) from parts where split = 'validation')),
held as (select * exclude (split), case when prn <= round_even(pn * 0.6, 0) then 'policy_train' else 'policy_validation' end as split from h)"""


@BOOK.query("l14_policy_partition", f"{POLICY} select row_id, split from held")
def _(spark, d):
    return splits.policy_partition(stratified(spark, d), "family", "row_id").select("row_id", "split")


@BOOK.query("l14_partition_manifest", f"""{POLICY}, s as (select split, count(*) as n, count(*) filter (where y = 1) as attack, sum(('0x' || substr(md5(concat(row_id, '|', split)), 1, 12))::bigint) as total from held group by split)
select split, n, attack, sha256(concat(split, ':', n, ':', total)) as manifest_hash from s""")
def _(spark, d):
    return splits.partition_manifest(splits.policy_partition(stratified(spark, d), "family", "row_id"), "row_id", "y")


@BOOK.query("t5_stratified_subsample", f"""{VEC}, r as (select row_id, row_number() over (partition by family order by md5(concat(row_id, '-42')), row_id) as rn, count(*) over (partition by family) as c, count(*) over () as n from vectors)
select row_id from r where rn <= greatest(round_even(c * (1000.0 / n), 0), 1)""")
def _(spark, d):
    return splits.stratified_subsample(vectors(spark, d), "family", "row_id", 1000).select("row_id")


@BOOK.query("t6_balanced_sample", f"""{VEC}, r as (select row_id, y, row_number() over (partition by y order by md5(concat(row_id, '-42')), row_id) as rn from vectors) select row_id, {big('y')} as y from r where rn <= 400""")
def _(spark, d):
    return rounded(splits.balanced_sample(vectors(spark, d), "y", "row_id", 800).select("row_id", "y"))


@BOOK.query("t6_family_sample", f"{VEC} select row_id, family from vectors where family = 'A' order by md5(concat(row_id, '-42')), row_id limit 300")
def _(spark, d):
    return splits.family_sample(vectors(spark, d), "family", "A", "row_id", 300).select("row_id", "family")


@BOOK.query("t7_quota_sample", f"{VEC}, r as (select row_id, row_number() over (partition by source_file, family order by row_id) as rn from vectors) select row_id from r where rn <= 50")
def _(spark, d):
    from flowlake.operators import audit

    return audit.quota_sample(vectors(spark, d), ["source_file", "family"], ["row_id"], 50).select("row_id")


@BOOK.query("t8_weighted_sample", f"""{VEC}, u as (select row_id, pow(f1, 0.6) as p, (('0x' || substr(md5(concat(row_id, '-42')), 1, 12))::bigint + 1) / 281474976710657.0 as u from vectors),
k as (select row_id, p, -ln(u) / p as key from u), s as (select * from k order by key, row_id limit 500), t as (select sum(p) as total, count(*) as n from u),
w as (select row_id, pow(n * p / total, -0.4) as w from s, t) select row_id, {rnd('w / max(w) over ()')} as weight from w""")
def _(spark, d):
    return rounded(splits.weighted_sample(vectors(spark, d), "f1", "row_id", 500).select("row_id", "weight"))


@BOOK.query("u4_interleave_mix", f"""{VEC}, r as (select row_id, family, row_number() over (partition by family order by md5(concat(row_id, '-42')), row_id) - 1 as z from vectors)
select row_id, case family when 'N' then z // 2 * 4 + case when z % 2 = 0 then 0 else 2 end when 'A' then z * 4 + 1 else z * 4 + 3 end as position from r""")
def _(spark, d):
    return events.interleave(vectors(spark, d), "family", "row_id", ["N", "A", "N", "R"]).select("row_id", "position")
