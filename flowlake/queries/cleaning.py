"""Cleaning, labels, conflicts, accounting and profiles: P5 to P9, P13, J3, J6, L1, L3, L7, L15, A2 to A13, W17, W18, U1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake.operators import audit, clean
from flowlake.queries.book import Book, big, rnd, rounded
from flowlake.sources.views import cte, view

BOOK = Book()
RAW, VEC = cte("raw_flows"), cte("vectors")
DATASET = "cicids2017"
FEATURES = ["fwd_bytes", "bwd_bytes"]
V3 = ["f1", "f2", "f3"]


def raw(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "raw_flows")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "vectors")


NORM = "upper(regexp_replace(trim(replace(replace(replace(replace(native_label, chr(8211), '-'), chr(8212), '-'), chr(65533), '-'), chr(8217), '''')), '\\s+', ' ', 'g'))"
CONTRACT = f"""{RAW}, n as (select *, {NORM} as norm from raw_flows), labelled as (select *, case norm when 'BENIGN' then 'BENIGN' when 'DOS HULK' then 'ATTACK' when 'WEB ATTACK - XSS' then 'ATTACK' when 'PORTSCAN' then 'ATTACK' else 'UNKNOWN' end as canonical_label,
 case norm when 'BENIGN' then 0 when 'DOS HULK' then 1 when 'WEB ATTACK - XSS' then 1 when 'PORTSCAN' then 1 else -1 end as binary_label,
 case norm when 'BENIGN' then 'BENIGN' when 'DOS HULK' then 'DoS' when 'WEB ATTACK - XSS' then 'Web' when 'PORTSCAN' then 'PortScan' else 'UNKNOWN' end as attack_family from n)"""


def labelled(spark, d):
    return clean.apply_contract(raw(spark, d), "native_label", DATASET)


@BOOK.query("l1_normalize_label", f"{RAW} select native_label, {NORM} as normalized, count(*) as n from raw_flows group by all")
def _(spark, d):
    df = raw(spark, d)
    return df.groupBy("native_label", clean.normalize_label(F.col("native_label")).alias("normalized")).agg(F.count("*").alias("n"))


@BOOK.query("j3_label_contract_join", f"{CONTRACT} select row_id, norm as normalized_label, canonical_label, {big('binary_label')} as binary_label, attack_family from labelled")
def _(spark, d):
    return rounded(labelled(spark, d).select("row_id", "normalized_label", "canonical_label", "binary_label", "attack_family"))


@BOOK.query("l3_contract_stats", f"""{CONTRACT} select count(*) filter (where canonical_label <> 'UNKNOWN') as accepted, count(*) filter (where canonical_label = 'UNKNOWN') as rejected,
 count(*) filter (where canonical_label = 'BENIGN') as benign, count(*) filter (where canonical_label = 'ATTACK') as attack, count(distinct native_label) as distinct_raw_labels from labelled""")
def _(spark, d):
    return clean.contract_stats(labelled(spark, d), "native_label")


@BOOK.query("p7_reject_unknown_labels", f"{CONTRACT} select row_id, canonical_label from labelled where canonical_label <> 'UNKNOWN'")
def _(spark, d):
    return clean.reject_unknown(labelled(spark, d))[0].select("row_id", "canonical_label")


@BOOK.query("a4_rejection_summary", f"""{CONTRACT} select 'cicids2017' as dataset, native_label as original_label, norm as normalized_label, count(*) as row_count, {rnd('100.0 * count(*) / (select count(*) from labelled)')} as percentage,
 'label not in contract' as reason from labelled where canonical_label = 'UNKNOWN' group by native_label, norm""")
def _(spark, d):
    return rounded(clean.rejection_summary(labelled(spark, d), "native_label", DATASET))


STRICT = "case when l_linenumber = 1 then ' benign ' when l_linenumber = 2 then '1.0' when l_linenumber = 3 then 'DoS-something' when l_linenumber = 4 then 'odd' when l_linenumber = 5 then '0' when l_linenumber = 6 then 'Anomaly' else '2' end"
STRICT_Y = "case l_linenumber when 1 then 0 when 2 then 1 when 3 then 1 when 5 then 0 when 6 then 1 end"


def strict(spark, d):
    texts = [" benign ", "1.0", "DoS-something", "odd", "0", "Anomaly", "2"]
    label = F.element_at(F.array(*[F.lit(t) for t in texts]), F.col("l_linenumber").cast("int"))
    return view(spark, d, "scored").withColumn("label", label)


@BOOK.query("p13_strict_binary_label", f"{cte('scored')} select {STRICT} as label, {big(STRICT_Y)} as strict, count(*) as n from scored group by all")
def _(spark, d):
    return rounded(strict(spark, d).groupBy("label", clean.strict_binary_label(F.col("label")).alias("strict")).agg(F.count("*").alias("n")))


@BOOK.query("p13_label_errors", f"{cte('scored')} select {STRICT} as label, count(*) as rows_in_error from scored where ({STRICT_Y}) is null group by all")
def _(spark, d):
    return clean.label_errors(strict(spark, d), "label")


@BOOK.query("p8_drop_negative_duration", f"{RAW} select row_id from raw_flows where not (duration_us < 0) or duration_us is null")
def _(spark, d):
    return clean.drop_negative_duration(raw(spark, d), ["dur", "duration_us"]).select("row_id")


@BOOK.query("p9_repeated_header_filter", f"{cte('scored')} select row_id from scored where lower(trim(case when l_linenumber = 3 then ' Label' else family end)) <> 'label'")
def _(spark, d):
    df = view(spark, d, "scored").withColumn("Label", F.when(F.col("l_linenumber") == 3, " Label").otherwise(F.col("family")))
    return clean.drop_repeated_header(df, "Label").select("row_id")


BAD = "isinf(fwd_bytes)"
MISS = "(fwd_bytes is null or isnan(fwd_bytes))"


@BOOK.query("p6_finite_report", f"""{RAW} select count(*) as rows_in, count(*) filter (where coalesce({BAD}, false)) as inf_rows, count(*) filter (where {MISS}) as nan_rows,
 count(*) filter (where not {MISS} and not coalesce({BAD}, false)) as rows_kept from raw_flows""")
def _(spark, d):
    return clean.finite_report(raw(spark, d), FEATURES)


@BOOK.query("p6_non_finite_filter", f"{RAW} select row_id from raw_flows where fwd_bytes is not null and isfinite(fwd_bytes) and isfinite(bwd_bytes)")
def _(spark, d):
    return clean.finite_only(raw(spark, d), FEATURES).select("row_id")


@BOOK.query("p5_feature_contract_check", f"""{RAW} select 'fwd_bytes' as feature, count(*) filter (where fwd_bytes is null or not isfinite(fwd_bytes)) as violations from raw_flows
 union all select 'bwd_bytes', count(*) filter (where bwd_bytes is null or not isfinite(bwd_bytes)) from raw_flows""")
def _(spark, d):
    return clean.contract_check(raw(spark, d), FEATURES)[1]


@BOOK.query("a2_label_counts", f"{RAW} select native_label, count(*) as n from raw_flows group by 1 order by n desc, native_label limit 50")
def _(spark, d):
    return audit.label_counts(raw(spark, d), "native_label")


@BOOK.query("a5_null_inf_profile", f"""{RAW} select 'fwd_bytes' as "column", count(*) filter (where {MISS}) as missing, count(*) filter (where coalesce({BAD}, false)) as infinite from raw_flows
 union all select 'bwd_bytes', count(*) filter (where bwd_bytes is null or isnan(bwd_bytes)), count(*) filter (where isinf(bwd_bytes)) from raw_flows""")
def _(spark, d):
    return audit.null_inf_profile(raw(spark, d), FEATURES)


def shares(c: str) -> str:
    return f"""(with c as (select {c} as v, count(*) as n from vectors group by 1) select '{c}' as "column", count(v) as distinct_values, {rnd('max(n) / sum(n)')} as top_share, count(v) <= 1 as is_constant, max(n) / sum(n) >= 0.999 as is_near_constant from c)"""


@BOOK.query("a6_constant_columns", f"{VEC} " + " union all ".join(f"select * from {shares(c)}" for c in ("f2", "f3", "source_file", "family")))
def _(spark, d):
    return rounded(audit.value_shares(vectors(spark, d), ["f2", "f3", "source_file", "family"]))


@BOOK.query("a7_duration_profile", f"{RAW} select count(*) filter (where duration_us < 0) as negative, count(*) filter (where duration_us = 0) as zero, count(*) filter (where duration_us is null) as missing, {rnd('min(duration_us)')} as min, {rnd('max(duration_us)')} as max from raw_flows")
def _(spark, d):
    return rounded(audit.duration_profile(raw(spark, d), "duration_us"))


@BOOK.query("a8_duplicate_count", f"""{VEC}, g as (select f1, f2, f3, count(*) as n from vectors group by all)
select {big('sum(n)')} as total_rows, count(*) as distinct_rows, {big('sum(n - 1)')} as duplicate_rows, {rnd('sum(n - 1) / sum(n)')} as duplicate_fraction from g""")
def _(spark, d):
    return rounded(audit.duplicate_count(vectors(spark, d), V3))


@BOOK.query("a9_schema_variation", f"""{VEC}, files as (select distinct family as dataset, source_file, concat('c', cast(f2 * 100 as int)) as column_name from vectors where f3 > 0.07 and f1 < 3),
s as (select dataset, source_file, string_agg(column_name, ',' order by column_name) as cols from files group by all), c as (select dataset, cols, count(*) as files from s group by all)
select dataset, {big('sum(files)')} as files, count(*) as column_sets, count(*) = 1 as identical from c group by dataset""")
def _(spark, d):
    df = vectors(spark, d).filter("f3 > 0.07 and f1 < 3")
    files = df.select(F.col("family").alias("dataset"), "source_file", F.concat(F.lit("c"), F.round(F.col("f2") * 100).cast("int").cast("string")).alias("column_name")).distinct()
    return audit.schema_variation(files)


GROUPED = f"{VEC}, g as (select f1, f2, f3, count(*) as copies, count(*) filter (where y = 0) as n0, count(*) filter (where y = 1) as n1, min(family) <> max(family) as family_conflict from vectors group by all), c as (select *, n0 > 0 and n1 > 0 as bad from g)"


def grouped(spark, d):
    return clean.vector_table(vectors(spark, d), V3, "y", "family")


@BOOK.query("a10_conflict_summary", f"""{GROUPED} select count(*) as vectors, count(*) filter (where copies > 1) as duplicated_vectors, {big('coalesce(sum(copies - 1) filter (where copies > 1), 0)')} as excess_rows, count(*) filter (where bad) as conflict_vectors,
 {big('coalesce(sum(copies) filter (where bad), 0)')} as conflict_rows, {big('coalesce(sum(n0) filter (where bad), 0)')} as conflict_benign_rows, {big('coalesce(sum(n1) filter (where bad), 0)')} as conflict_attack_rows,
 count(*) filter (where family_conflict) as family_conflict_vectors from c""")
def _(spark, d):
    return clean.conflict_summary(grouped(spark, d))


@BOOK.query("a10_conflict_examples", f"{GROUPED} select {rnd('f1')} as f1, {rnd('f2')} as f2, {rnd('f3')} as f3, copies from c where bad order by copies desc, c.f1, c.f2, c.f3 limit 10")
def _(spark, d):
    return rounded(clean.conflict_examples(grouped(spark, d), V3).select(*V3, "copies"))


@BOOK.query("j6_conflict_members", f"{GROUPED} select row_id from vectors v join c on v.f1 = c.f1 and v.f2 = c.f2 and v.f3 = c.f3 where bad")
def _(spark, d):
    return clean.conflict_members(vectors(spark, d), grouped(spark, d), V3, ["row_id"]).select("row_id")


@BOOK.query("j6_resolve_conflicts", f"{GROUPED} select row_id from vectors v join c on v.f1 = c.f1 and v.f2 = c.f2 and v.f3 = c.f3 where not bad")
def _(spark, d):
    return clean.resolve_conflicts(vectors(spark, d), grouped(spark, d), V3, ["row_id"]).select("row_id")


@BOOK.query("a11_bayes_ceiling", f"{GROUPED} select {big('sum(copies)')} as ambiguous_rows, {rnd('sum(greatest(n0, n1)) / sum(copies)')} as max_accuracy, {rnd('sum(least(n0, n1)) / sum(copies)')} as min_error from c where bad")
def _(spark, d):
    return rounded(clean.bayes_ceiling(grouped(spark, d)))


@BOOK.query("w17_dedup_first", f"{VEC} select min(row_id) as row_id from vectors group by f1, f2, f3")
def _(spark, d):
    return clean.dedup_first(vectors(spark, d).select(*V3, "row_id"), V3, ["row_id"]).select("row_id")


@BOOK.query("w18_tag_duplicates", f"{VEC} select row_id, count(*) over (partition by f1, f2, f3) > 1 as is_duplicate from vectors")
def _(spark, d):
    return clean.tag_duplicates(vectors(spark, d), V3, ["row_id"]).select("row_id", "is_duplicate")


@BOOK.query("l7_duplicate_policy", f"""{VEC}, a as (select count(*) as n from (select distinct f1, f2, f3 from vectors)), b as (select count(*) as n, count(*) filter (where copies > 1) as marked from (select count(*) over (partition by f1, f2, f3) as copies from vectors))
select 'deduplicate' as policy, a.n as row_count, 0 as marked from a union all select 'retain', b.n, b.marked from b union all select 'none', b.n, 0 from b""")
def _(spark, d):
    df = vectors(spark, d).select(*V3, "row_id")
    line = lambda p, marked: clean.duplicate_policy(df, V3, "row_id", p).agg(F.count("*").alias("row_count"), marked.alias("marked")).select(F.lit(p).alias("policy"), "row_count", F.col("marked").cast("long"))
    none = F.max(F.lit(0))
    return line("deduplicate", none).union(line("retain", F.count_if("is_duplicate"))).union(line("none", none))


@BOOK.query("a13_dataset_summary", " union all ".join(
    f"(select {f} as family, {s} as source_file, {lv} as level, count(*) as n, count(*) filter (where y = 0) as benign, count(*) filter (where y = 1) as attack, {rnd('count(*) filter (where y = 0) / greatest(count(*) filter (where y = 1), 1)')} as imbalance from vectors {g})"
    if i else f"{VEC} (select {f} as family, {s} as source_file, {lv} as level, count(*) as n, count(*) filter (where y = 0) as benign, count(*) filter (where y = 1) as attack, {rnd('count(*) filter (where y = 0) / greatest(count(*) filter (where y = 1), 1)')} as imbalance from vectors {g})"
    for i, (f, s, lv, g) in enumerate((("cast(null as varchar)", "cast(null as varchar)", 3, ""), ("family", "cast(null as varchar)", 1, "group by family"), ("cast(null as varchar)", "source_file", 2, "group by source_file")))))
def _(spark, d):
    return rounded(clean.dataset_summary(vectors(spark, d), "family", "source_file"))


@BOOK.query("a12_class_distribution", f"{VEC} select source_file, count(*) as n, count(*) filter (where y = 0) as benign, count(*) filter (where y = 1) as attack, {rnd('avg(y)')} as attack_fraction from vectors group by source_file")
def _(spark, d):
    return rounded(clean.class_distribution(vectors(spark, d), "source_file"))


@BOOK.query("u1_union_populations", f"{VEC} select family, count(*) as n, count(extra) as with_extra from (select family, f1 as extra from vectors where y = 1 union all select family, null from vectors where y = 0) group by family")
def _(spark, d):
    df = vectors(spark, d)
    parts = [df.filter("y = 1").select("family", F.col("f1").alias("extra")), df.filter("y = 0").select("family")]
    return clean.union_populations(parts).groupBy("family").agg(F.count("*").alias("n"), F.count("extra").alias("with_extra"))


# rows are equal when everything but the row's own id is; the id gives the order
BUILD = ["source_file", "duration_us", "fwd_packets", "bwd_packets", "fwd_bytes", "bwd_bytes", "native_label"]
TAGGED = f"""{CONTRACT}, t1 as (select *, row_number() over (partition by {', '.join(BUILD)} order by row_id) as copy from labelled),
t2 as (select *, case when copy > 1 then 'duplicate_row' when canonical_label = 'UNKNOWN' then 'unknown_label' when duration_us < 0 then 'negative_duration'
 when fwd_bytes is null or not isfinite(fwd_bytes) or not isfinite(bwd_bytes) then 'non_finite' end as early from t1),
t3 as (select *, case when early is null then min(binary_label) filter (where early is null) over (partition by fwd_bytes, bwd_bytes) <> max(binary_label) filter (where early is null) over (partition by fwd_bytes, bwd_bytes) end as bad,
 case when early is null then min(row_id) filter (where early is null) over (partition by fwd_bytes, bwd_bytes) end as first_id from t2),
tagged as (select *, coalesce(early, case when bad then 'label_conflict' when row_id <> first_id then 'duplicate_vector' end) as reason from t3)"""


def tagged(spark, d, conflicts="reject_conflicts"):
    return clean.tag_removals(
        raw(spark, d), DATASET, columns=BUILD, features=FEATURES, label="native_label", duration="duration_us", order="row_id", conflicts=conflicts
    )


# under keep_first a conflict removes no row
KEEP_FIRST = TAGGED.replace("case when bad then 'label_conflict' when row_id", "case when row_id")


@BOOK.query("l15_population_build", f"{KEEP_FIRST} select row_id, {big('binary_label')} as binary_label, attack_family from tagged where reason is null")
def _(spark, d):
    return rounded(clean.population(tagged(spark, d, "keep_first")).select("row_id", "binary_label", "attack_family"))


ACCOUNT = "count(*) as raw_rows, " + ", ".join(f"count(*) filter (where reason = '{r}') as {r}" for r in clean.REASONS) + ", count(*) filter (where reason is null) as final_rows, true as reconciles"


@BOOK.query("a3_row_accounting", f"{TAGGED} select source_file, 0 as is_total, {ACCOUNT} from tagged group by source_file union all select null, 1, {ACCOUNT} from tagged")
def _(spark, d):
    return rounded(clean.accounting(tagged(spark, d), "source_file", "removal_reason", clean.REASONS))
