"""Cases that once went wrong, each by hand."""

from __future__ import annotations

import datetime as dt
import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from flowlake.operators import clean, events, flows, hosts, metrics, ml, policy, rules, splits
from flowlake.sources import scans, sinks

T0 = dt.datetime(2024, 1, 1)


def test_one_class_has_a_full_macro_f1(spark):
    df = spark.createDataFrame([(1, 1), (1, 1)], "y int, pred int")
    assert metrics.binary_metrics(df).first()["macro_f1"] == 1.0


def test_calibration_compares_with_the_edges(spark):
    df = spark.createDataFrame([(0, 0.3), (1, 0.7)], "y int, score double")
    bins = {r["bin"]: r for r in metrics.reliability(df).collect()}
    assert bins[2]["n"] == 0 or bins[3]["n"] == 1
    assert sum(r["n"] for r in bins.values()) == 2 and bins[7]["gap"] == pytest.approx(-0.3)


def test_page_of_more_than_a_thousand_rows(spark):
    rows, totals = events.page(spark.range(4000), ["id"], 2, 1500)
    assert [r["id"] for r in rows.collect()] == list(range(1500, 3000)) and totals.first()["total_pages"] == 3


def test_event_id_resent_on_another_day(spark, tmp_path):
    path = str(tmp_path / "events")
    event = lambda day: spark.createDataFrame([("a", T0 + dt.timedelta(days=day), "10.0.0.1")], "event_id string, ts timestamp, source_ip string")
    for day in (0, 0, 3):
        sinks.append_events(event(day), path)
    assert spark.read.parquet(path).count() == 1


def test_missing_times_are_refused_and_each_cut_falls_back_alone(spark):
    rows = [(i, T0 + dt.timedelta(minutes=i)) for i in range(100)]
    df = spark.createDataFrame(rows, "row_id long, ts timestamp")
    with pytest.raises(ValueError, match="missing"):
        splits.temporal_split(df.union(spark.createDataFrame([(999, None)], df.schema)), "ts", "row_id")
    got = {r["split"]: r["n"] for r in splits.temporal_split(df, "ts", "row_id").groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert got["train"] == 60 and got["validation"] == 20  # an hour boundary for the first cut, the exact rank for the second


def test_full_width_label_is_folded(spark):
    df = spark.createDataFrame([("ＢＥＮＩＧＮ",), ("DoS  Hulk",), (None,)], "label string")
    got = {r["label"]: r["canonical_label"] for r in clean.apply_contract(df, "label", "cicids2017").collect()}
    assert got == {"ＢＥＮＩＧＮ": "BENIGN", "DoS  Hulk": "ATTACK", None: "UNKNOWN"}


def test_unknown_policy_is_refused(spark):
    with pytest.raises(ValueError, match="policy"):
        clean.duplicate_policy(spark.range(1), ["id"], "id", "other")


def test_isolation_forest_draws_for_each_tree(spark):
    df = spark.range(500).select("id", F.rand(1).alias("a"), F.rand(2).alias("b"))
    drawn = ml.tree_draws(df, ["a", "b"], "id", 10, 256, 42).toPandas().sort_values(["tree", "rank"]).groupby("tree").head(256)
    rows = {tree: frozenset(g["a"]) for tree, g in drawn.groupby("tree")}
    assert {len(r) for r in rows.values()} == {256} and len(set(rows.values())) == 10
    assert ml.isolation_forest(df, ["a", "b"], "id", trees=10).select("tree").distinct().count() == 10


def packets(spark, seconds, fins=()):
    rows = [(T0 + dt.timedelta(seconds=s), "10.0.0.1", "10.0.0.2", 1, 2, 6, 40, True, False, True, False, i in fins, False, False, None, i) for i, s in enumerate(seconds)]
    names = "ts timestamp, src_ip string, dst_ip string, src_port int, dst_port int, protocol int, packet_length int, is_tcp boolean, syn boolean, ack boolean, rst boolean, fin boolean, psh boolean, urg boolean, raw_flags int, pkt_id long"
    return spark.createDataFrame(rows, names)


def test_flow_cuts_by_silence_fin_and_lifetime(spark):
    seq = lambda df, **kw: [r["flow_seq"] for r in flows.flow_split(df, **kw).orderBy("pkt_id").collect()]
    assert seq(packets(spark, [0, 120, 241, 242], fins=(2,))) == [1, 1, 2, 3]
    assert seq(packets(spark, [0, 100, 200, 300]), max_life_s=150) == [1, 1, 2, 2]
    got = flows.with_close_reasons(flows.assemble_flows(packets(spark, [0, 100, 200, 900]), 120, 150), 120)
    assert {r["flow_seq"]: r["closed_reason"] for r in got.collect()} == {1: "MAX_DURATION", 2: "TIMEOUT", 3: "FLUSH"}


def test_multi_flow_rule_comes_fourth_and_its_gap_is_named(spark):
    df = spark.createDataFrame([(6, 20.0, 0.0, 40.0)], "protocol int, syn_count double, ack_count double, packet_length_mean double")
    row = rules.rules_from_features(df).first()
    assert "RULE-PORT-SCAN-MULTI-FLOW" in row["unavailable_rules"] and "src_ip/dst_ip" in row["unavailable_features"]


def test_sliding_counts_are_running_sums(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice(("a", "b", None)), T0 + dt.timedelta(seconds=rnd.randrange(40)), rnd.choice((True, True, False, None))) for i in range(160)]
    rows.append((160, "a", None, True))
    df = spark.createDataFrame(rows, "seq long, host string, ts timestamp, hit boolean")
    for window_s, chunk_s in ((7.0, 3.0), (3.0, 10.0), (0.0, 5.0)):
        out = hosts.suspicious_count(df, "host", "ts", "seq", "hit", window_s, chunk_s)
        want = {
            seq: sum(bool(hit) for s, h, at, hit in rows if h == host and at is not None and (at, s) <= (ts, seq) and (ts - at).total_seconds() <= window_s)
            for seq, host, ts, _ in rows if ts is not None
        }
        assert {r["seq"]: r["suspicious_count"] for r in out.collect()} == want
        assert out.columns == [*df.columns, "suspicious_count"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "RangeFrame" not in plan  # Spark goes through every row of such a frame for each row


def test_plain_labels_do_not_meet_in_one_task(spark):
    df = spark.range(400).select("id", F.when(F.col("id") % 50 == 0, "Web Attack – XSS").otherwise("DoS Hulk").alias("label"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(before, ("false", "-1", "16"), strict=True):
            spark.conf.set(k, v)
        got = clean.fold_compatibility(df, "label").withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(got) == 400 and max(Counter(r["task"] for r in got).values()) < 100


def test_headers_come_without_sorting_lines(spark, tmp_path):
    for name, text in (("a", "x,y\n1,2\n3,4\n"), ("b", "y,x\n2,1\n"), ("c", "x,y\n")):
        (tmp_path / f"{name}.csv").write_text(text)
    found = scans.file_headers(spark, str(tmp_path))
    assert {r["source_path"][-5:]: r["header"] for r in found.collect()} == {"a.csv": "x,y", "b.csv": "y,x", "c.csv": "x,y"}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Exchange" not in plan


def test_row_index_of_a_file_in_parts(spark, tmp_path):
    spark.range(50).select("id", (F.col("id") % 2).alias("part")).repartitionByRange(5, "part", "id").sortWithinPartitions("part", "id").write.partitionBy("part").option("header", True).csv(str(tmp_path / "f"))
    scan = scans.csv_flow_scan(spark, str(tmp_path / "f"), "x")
    assert scan.select("source_path").distinct().count() > 2
    part = F.regexp_extract("source_path", "part=([^/]+)/", 1)
    got = scans.with_row_index(scan, part).select(part.alias("part"), F.col("id").cast("int").alias("id"), "source_row_index").collect()
    assert len(got) == 50 and all(r["source_row_index"] == r["id"] // 2 for r in got)


def test_best_weight_comes_without_a_second_read(spark):
    df = spark.createDataFrame([(i % 2, i / 9, (i * 5 % 7) / 7) for i in range(8)], "y int, a double, b double")
    tuned = metrics.tune_alpha(df, "y", "a", "b")
    assert sum(r["is_best"] for r in tuned.collect()) == 1
    assert "scalar-subquery" not in tuned._jdf.queryExecution().optimizedPlan().toString()


def test_a_run_of_alerts_and_the_action_before_cross_slices_in_one_pass(spark):
    acts = [1, 1, 0, 1, 1, 1, 2, 1]  # a row every ten hours: slices of a day hold two or three
    log = spark.createDataFrame([(h, T0 + dt.timedelta(hours=10 * i), i, a) for h in ("a", None) for i, a in enumerate(acts)], "host_id string, ts timestamp, seq long, act int")
    got = policy.alert_run(log, "act", before="was").orderBy("seq").collect()
    for host in ("a", None):
        mine = [r for r in got if r["host_id"] == host]
        assert [r["consecutive_alerts"] for r in mine] == [1, 2, 0, 1, 2, 3, 0, 1]
        assert [r["was"] for r in mine] == [None, *acts[:-1]]


def test_costs_of_steps_join_the_slices_once(spark):
    log = spark.createDataFrame([("a", T0, 1, 1, 3, 0.0)], "host_id string, ts timestamp, seq long, y int, enforced int, cooldown_remaining_s double")
    plan = policy.step_cost(log, "high_availability")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") <= 3  # costs in both branches, and the carried slices


def test_family_auc_copies_no_benign_count(spark):
    rows = [("NO", s) for s in (0.1, 0.4, 0.4, None)] + [("A", 0.4), ("A", 0.9), ("B", 0.05), ("B", None), (None, 0.7)]
    df = spark.createDataFrame(rows, "family string, score double")
    got = metrics.family_auc(df, "family", "NO", "score")
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
    found = {r["family"]: (r["n_pos"], r["n_neg"], r["roc_auc"]) for r in got.collect()}
    assert found == {"A": (2, 4, pytest.approx((3 + 4) / 8)), "B": (2, 4, pytest.approx((1 + 0.5) / 8))}  # no score is least
    alone = metrics.family_auc(df.filter("family = 'A'"), "family", "NO", "score").first()
    assert (alone["n_pos"], alone["n_neg"], alone["roc_auc"]) == (2, 0, None)


def records_shuffled(df) -> int:
    """Rows that the exchanges of an executed ``df`` wrote."""
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        if name == "ShuffleExchangeExec":
            total += node.metrics().apply("shuffleRecordsWritten").value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return total


def test_stratified_split_leaves_rows_where_they_are(spark):
    rows = [(f"r{i // 2 if i % 5 == 0 else i}", None if i % 50 == 3 else "abc"[i % 3 if i % 7 else 0], i) for i in range(30_000)]
    rows += [(None, "c", i) for i in range(30)] + [("lonely", "d", 1)]
    got = splits.stratified_split(spark.createDataFrame(rows, "row_id string, family string, v int").coalesce(1), "family", "row_id")
    found = got.collect()
    # a seeded hash order per class, cut at rounded shares; rows of one id are told apart by nothing
    place = lambda r: hashlib.md5("-".join([*([r] if r else []), "42"]).encode()).hexdigest()
    want = Counter()
    for family in "abcd":
        ids = sorted((r[0] for r in rows if r[1] == family), key=lambda r: (place(r), r or ""))
        cuts = round(len(ids) * 0.6), round(len(ids) * (0.6 + 0.2))
        want.update((family, r, "train" if k < cuts[0] else "validation" if k < cuts[1] else "test") for k, r in enumerate(ids))
    assert Counter((r["family"], r["row_id"], r["split"]) for r in found) == want and got.columns == ["family", "row_id", "v", "split"]
    # counts per class and slice of hashes, and the rows of the slices with a cut
    slices = len({(r[1], place(r[0])[:3]) for r in rows if r[1]})
    assert records_shuffled(got) < 2.5 * slices + 200, (records_shuffled(got), slices)
