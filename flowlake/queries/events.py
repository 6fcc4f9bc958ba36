"""Events, sinks, scans, listings and explorers: S1 to S3, S6 to S10, P11, P12, T3, T4, A25, A31, U2, X6, X9."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlake.operators import events, policy
from flowlake.queries.book import Book, big, rnd, rounded
from flowlake.queries.policy import GATE, gated
from flowlake.sources import scans, sinks
from flowlake.sources.views import cte, table, view

BOOK = Book()
E = cte("scored_events")
SEVERITY = "case when score >= 0.85 then 'HIGH' when score >= 0.65 then 'MEDIUM' when score >= 0.5 then 'LOW' else 'INFORMATIONAL' end"
VERDICT = "case when score >= 0.5 then 'ATTACK' else 'BENIGN' end"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the place the cluster shares, or a private one where none is named."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{shared or tempfile.mkdtemp(prefix='flowlake-')}/{name}-{spark.sparkContext.applicationId}-{next(_ids)}"


def _numbers():
    n = 0
    while True:
        yield n
        n += 1


_ids = _numbers()


def security_events(spark: SparkSession, d: str) -> DataFrame:
    """Security events in the stored schema, from the scored events."""
    s = F.col("score")
    rule = F.struct(F.lit("R").alias("rule_id"), F.lit("n").alias("name"), F.lit("LOW").alias("severity"), F.lit("d").alias("description"), F.col("k").cast("string").alias("matched_value"))
    text = lambda k, v: F.create_map(F.lit(k), v.cast("string"))
    return view(spark, d, "scored_events").select(
        F.col("seq").cast("string").alias("event_id"), "ts", F.concat(F.lit("flow-"), F.col("k").cast("string")).alias("flow_id"),
        F.when(F.col("k") % 2 == 0, "LIVE").otherwise("REPLAY").alias("source_mode"), F.col("host_id").alias("source_ip"), F.lit("10.1.0.1").alias("dest_ip"),
        F.lit(40000).alias("source_port"), F.lit(80).alias("dest_port"), F.lit(6).alias("protocol"), F.when(s >= 0.5, "ATTACK").otherwise("BENIGN").alias("hybrid_verdict"),
        s.alias("hybrid_risk_score"), F.when(s >= 0.85, "HIGH").when(s >= 0.65, "MEDIUM").when(s >= 0.5, "LOW").otherwise("INFORMATIONAL").alias("severity"),
        (s >= 0.7).alias("source_escalated"), F.create_map(F.lit("score"), s).alias("features"), F.when(s >= 0.5, F.array(rule)).otherwise(F.array().cast("array<struct<rule_id:string,name:string,severity:string,description:string,matched_value:string>>")).alias("rule_matches"),
        text("m", F.lit("rf")).alias("detection"), text("a", F.col("k")).alias("response"), text("x", F.col("y")).alias("metadata"),
    )


@BOOK.query("p11_event_filter", f"{E} select cast(seq as varchar) as event_id from scored_events where {SEVERITY} = 'LOW' and {VERDICT} = 'ATTACK' and ts >= timestamp '2024-01-03' and ts <= timestamp '2024-01-20'")
def _(spark, d):
    got = events.event_filter(security_events(spark, d), severity=" low ", verdict="attack", mode="ALL", start="2024-01-03 00:00:00", end="2024-01-20 00:00:00")
    return got.select("event_id")


@BOOK.query("t3_page", f"{E} select seq from scored_events where score >= 0.3 order by ts, seq limit 1500 offset 1500")
def _(spark, d):
    return events.page(view(spark, d, "scored_events").filter("score >= 0.3"), ["ts", "seq"], 2, 1500)[0].select("seq")


@BOOK.query("t3_page_totals", f"{E} select count(*) as total_rows, (count(*) + 1499) // 1500 as total_pages, (count(*) + 1499) // 1500 as page from scored_events where score >= 0.3")
def _(spark, d):
    return events.page(view(spark, d, "scored_events").filter("score >= 0.3"), ["ts", "seq"], 999, 1500)[1]


@BOOK.query("t4_recent_events", f"{E} select cast(seq as varchar) as event_id from scored_events order by ts desc, cast(seq as varchar) desc limit 1500")
def _(spark, d):
    return events.recent_events(security_events(spark, d), 1500).select("event_id")


@BOOK.query("t4_list_events", f"{E} select cast(seq as varchar) as event_id from scored_events order by ts desc, cast(seq as varchar) desc limit 1000 offset 50")
def _(spark, d):
    return events.list_events(security_events(spark, d), 5000, 50).select("event_id")


@BOOK.query("a25_event_breakdown", f"""{E}, e as (select {SEVERITY} as severity, {VERDICT} as hybrid_verdict, score from scored_events),
g as (select severity, hybrid_verdict, {big('grouping(severity, hybrid_verdict)')} as level, count(*) as events, count(*) filter (where hybrid_verdict = 'ATTACK') as threats, count(*) filter (where score >= 0.5) as rule_matches, count(*) filter (where score >= 0.7) as escalations
 from (select severity, hybrid_verdict, hybrid_verdict as hv, score from e) group by grouping sets ((), (severity), (hybrid_verdict)))
select severity, hybrid_verdict, level, events, case when hybrid_verdict = 'BENIGN' then 0 else threats end as threats, rule_matches, escalations from g""".replace("count(*) filter (where hybrid_verdict = 'ATTACK') as threats", "count(*) filter (where hv = 'ATTACK') as threats"))
def _(spark, d):
    return rounded(events.event_breakdown(security_events(spark, d)))


@BOOK.query("p12_flow_explorer_filter", f"""{cte('scored')}, p as (select row_id, y, case when score >= 0.5 then 1 else 0 end as pred from scored) select row_id, case when pred = 1 then 'FALSE_POSITIVE' else 'FALSE_NEGATIVE' end as outcome from p where y <> pred and y = 1""")
def _(spark, d):
    df = view(spark, d, "scored").withColumn("pred", (F.col("score") >= 0.5).cast("int"))
    return events.explorer_filter(df, "errors", "attack").select("row_id", "outcome")


@BOOK.query("u2_timeline_union", f"""{GATE} select seq, 0 as step, 'EVALUATION' as kind from gate union all select seq, 1, 'RECOMMENDATION' from gate where proposed > 0 union all select seq, 2, 'BLOCK' from gate where enforced = 3""")
def _(spark, d):
    return rounded(events.timeline(gated(spark, d)).select("seq", "step", "kind"))


PHI = "phi as (select vec_id as row_id, concat('f', i) as feature, cast(embedding[i] as double) as phi, concat('c', label) as family from embeddings, range(1, 65) t(i) where i <= len(embedding))"


def phi(spark, d):
    cells = F.posexplode("embedding").alias("i", "phi")
    df = table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), "label", cells)
    return df.select("row_id", F.concat(F.lit("f"), (F.col("i") + 1).cast("string")).alias("feature"), F.col("phi").cast("double").alias("phi"), F.concat(F.lit("c"), F.col("label").cast("string")).alias("family"))


@BOOK.query("a31_attribution_rollup", f"with {PHI}, g as (select feature, avg(abs(phi)) as mean_abs, avg(phi) as mean from phi group by feature) select feature, {rnd('mean_abs')} as mean_abs, {rnd('mean')} as mean, row_number() over (order by mean_abs desc, feature) as rank from g")
def _(spark, d):
    return rounded(events.attribution_rollup(phi(spark, d)))


@BOOK.query("a31_attribution_by_class", f"with {PHI}, g as (select family, feature, avg(abs(phi)) as mean_abs from phi group by all), r as (select *, row_number() over (partition by family order by mean_abs desc, feature) as rank from g) select family, feature, {rnd('mean_abs')} as mean_abs, rank from r where rank <= 5")
def _(spark, d):
    return rounded(events.attribution_by_class(phi(spark, d), "family"))


@BOOK.query("a31_attribution_per_row", f"with {PHI}, g as (select row_id, feature, case when phi > 0 then 'positive' else 'negative' end as sign, phi from phi where phi <> 0), r as (select *, row_number() over (partition by row_id, sign order by abs(phi) desc, feature) as rank from g) select row_id, feature, sign, rank from r where rank <= 3")
def _(spark, d):
    return rounded(events.attribution_per_row(phi(spark, d), "row_id").select("row_id", "feature", "sign", "rank"))


# ---- sinks and scans, by what is read back from files written from the tables -------------------------


@BOOK.query("s8_event_table_sink", f"{E} select cast(seq as varchar) as event_id, epoch_us(ts) as us, {SEVERITY} as severity from scored_events")
def _(spark, d):
    path = scratch(spark, "events")
    batch = security_events(spark, d)
    sinks.append_events(batch.filter("cast(event_id as long) % 3 <> 0"), path)
    resent = batch.filter("cast(event_id as long) % 3 = 1").withColumn("ts", F.col("ts") + F.expr("interval 1 day"))
    sinks.append_events(resent.union(batch.filter("cast(event_id as long) % 3 = 0")), path)
    return spark.read.parquet(path).select("event_id", F.unix_micros("ts").alias("us"), "severity")


@BOOK.query("s9_event_jsonl", f"{E} select cast(seq as varchar) as event_id, {rnd('score')} as hybrid_risk_score, {big('case when score >= 0.5 then 1 else 0 end')} as rules from scored_events")
def _(spark, d):
    path = scratch(spark, "audit")
    sinks.append_jsonl(security_events(spark, d).filter("source_mode = 'LIVE'"), path)
    sinks.append_jsonl(security_events(spark, d).filter("source_mode <> 'LIVE'"), path)
    return rounded(sinks.read_jsonl(spark, path).select("event_id", "hybrid_risk_score", F.size("rule_matches").alias("rules")))


@BOOK.query("s9_json_columns", f"{E} select cast(seq as varchar) as event_id, {rnd('score')} as score, cast(k as varchar) as response from scored_events")
def _(spark, d):
    back = sinks.from_json_columns(sinks.to_json_columns(security_events(spark, d)))
    return rounded(back.select("event_id", F.col("features")["score"].alias("score"), F.col("response")["a"].alias("response")))


@BOOK.query("s10_export_csv", f"{cte('scored')} select row_id, {rnd('score', 2)} as score, family from scored")
def _(spark, d):
    path = scratch(spark, "export")
    sinks.export_csv(view(spark, d, "scored"), path, ["row_id", "score", "family"], {"score": 2})
    return rounded(spark.read.option("header", True).schema("row_id string, score double, family string").csv(path))


@BOOK.query("s7_predictions_scan", f"{cte('raw_flows')} select row_id, {rnd('fwd_bytes')} as score from raw_flows where fwd_bytes is not null and isfinite(fwd_bytes)")
def _(spark, d):
    path = scratch(spark, "predictions")
    view(spark, d, "raw_flows").select("row_id", F.col("fwd_bytes").alias("score"), "native_label").write.parquet(path)
    return rounded(scans.predictions_scan(spark, path, ["row_id", "score"], ["score"]))


@BOOK.query("s1_csv_flow_scan", f"{cte('vectors')} select row_id, cast(round(f1) as varchar) as f1, family from vectors".replace("cast(round(f1) as varchar)", "cast(cast(round(f1) as bigint) as varchar)"))
def _(spark, d):
    path = scratch(spark, "csv")
    df = view(spark, d, "vectors").select("row_id", F.round("f1").cast("long").alias("f1"), "family", "y")
    df.filter("y = 0").select("row_id", F.col("f1").alias("f1 "), "family").write.option("header", True).csv(f"{path}/a")
    df.filter("y = 1").select("family", "row_id", "f1").write.option("header", True).csv(f"{path}/b")
    return scans.csv_flow_scan(spark, [f"{path}/a", f"{path}/b"], "x").select("row_id", "f1", "family")


@BOOK.query("s1_row_index", f"{cte('vectors')} select source_file, count(*) as n, {big('sum(i)')} as index_sum from (select source_file, row_number() over (partition by source_file) - 1 as i from vectors) group by source_file")
def _(spark, d):
    path = scratch(spark, "indexed")
    df = view(spark, d, "vectors").select("row_id", "source_file").withColumn("part", F.col("source_file"))
    # a file in several parts, each a range of its rows
    df.repartitionByRange("part", "row_id").sortWithinPartitions("part", "row_id").write.partitionBy("part").option("header", True).csv(path)
    key = F.regexp_extract("source_path", "part=([^/]+)/", 1)
    lines = scans.csv_flow_scan(spark, path, "x").select(key.alias("source_file"), "source_path", "file_block", "line_id")
    got = scans.with_row_index(lines, F.col("source_file"))
    return got.groupBy("source_file").agg(F.count("*").alias("n"), F.sum("source_row_index").alias("index_sum"))


LINE = "concat(cast(event_id as varchar({n})), ',', event_type, ',', cast(user_id as varchar({n})))"


def day_files(spark: SparkSession, d: str, path: str, line: str = LINE.format(n=20), where: str = "true") -> None:
    """One text file per day of the events, lines by event id."""
    df = table(spark, d, "events").select(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd").alias("day"), F.dayofmonth(F.col("ts").cast("timestamp")).alias("dom"), "event_id", F.expr(line).alias("value"))
    df.filter(where).repartition("day").sortWithinPartitions("day", "event_id").select("day", "value").write.partitionBy("day").text(path)


def day_digests(spark: SparkSession, path: str) -> DataFrame:
    return scans.file_digests(spark, path, scratch(spark, "digests")).withColumn("file_name", F.concat(F.regexp_extract("file_path", "day=([^/]+)/", 1), F.lit(".csv")))


DAYS = f"""days as (select strftime(ts, '%Y-%m-%d') || '.csv' as file_name, day(ts) % 5 as kind, sha256(string_agg({LINE.format(n=20)} || chr(10), '' order by event_id)) as sha256,
 sha256(string_agg({LINE.format(n=20)} || '!' || chr(10), '' order by event_id)) as changed, sum(strlen({LINE.format(n=20)}) + 1) as bytes from events group by all)"""


@BOOK.query("s2_population_select", f"with {DAYS} select file_name, {big('bytes')} as bytes from days where kind <> 4 and file_name not in ('2024-01-02.csv', '2024-01-03.csv')")
def _(spark, d):
    path = scratch(spark, "population")
    day_files(spark, d, path, where="dom % 5 <> 4")
    files = day_digests(spark, path)
    listed = files.withColumn("position", F.dense_rank().over(Window.orderBy("file_name")))  # one row per file
    return scans.population_select(listed, exclude=["2024-01-02.csv", "2024-01-03.csv"], order="alphabetical").select("file_name", "bytes")


@BOOK.query("s3_manifest_verify", f"""with {DAYS}, r as (select file_name, case when kind = 0 then null else sha256 end as expected from days where kind <> 3),
p as (select file_name, case when kind = 1 then changed else sha256 end as actual from days where kind <> 2)
select coalesce(r.file_name, p.file_name) as file_name, case when r.file_name is null then 'unregistered' when p.file_name is null then 'missing' when expected is null then 'unverifiable' when expected = actual then 'verified' else 'mismatch' end as status, actual as sha256
from r full join p on r.file_name = p.file_name""")
def _(spark, d):
    """Files of a day are registered, and then some are changed, removed, added or registered without a digest."""
    first, second = scratch(spark, "registered"), scratch(spark, "present")
    day_files(spark, d, first, where="dom % 5 <> 3")
    day_files(spark, d, second, f"concat({LINE.format(n=20)}, case when day(cast(ts as timestamp)) % 5 = 1 then '!' else '' end)", "dom % 5 <> 2")
    kind = F.dayofmonth(F.to_date(F.substring("file_name", 1, 10))) % 5
    expected = day_digests(spark, first).select(F.lit("events").alias("dataset"), "file_name", F.when(kind != 0, F.col("sha256")).alias("sha256"))
    return scans.manifest_verify(expected, day_digests(spark, second)).select("file_name", "status", F.col("actual_sha256").alias("sha256"))


@BOOK.query("s6_json_flow_samples", f"{cte('scored')} select family as category, row_id as flow_id, {rnd('score')} as score from scored where family <> 'AF'")
def _(spark, d):
    path = scratch(spark, "samples")
    flow = F.struct(F.col("row_id").alias("flow_id"), F.col("family").alias("label"), F.create_map(F.lit("score"), F.col("score")).alias("features"))
    df = view(spark, d, "scored").groupBy(F.col("family").alias("category"), F.pmod(F.xxhash64("row_id"), F.lit(64)).alias("part")).agg(F.collect_list(flow).alias("flows"))
    df.drop("part").write.json(path)
    got = scans.json_flow_samples(spark, path, ["AO", "NF", "NO", "RF", "RO"])
    return rounded(got.select("category", "flow_id", F.col("features")["score"].alias("score")))
