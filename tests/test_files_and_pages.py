"""File digests, pages of a sorted table, and global ranks on skewed times."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from flowlake.operators import events, ordered, policy, splits
from flowlake.sources import scans

CONTENTS = {
    "plain.csv": b"a,b\n1,2\n3,4\n", "no-end.csv": b"a,b\n1,2", "crlf.csv": b"a,b\r\n1,2\r\n", "one-line.csv": b"x" * 5000, "only-ends.csv": b"\n\n\n",
    "marked.csv": b"\xef\xbb\xbfa,b\n1,2\n", "marked-no-end.csv": b"\xef\xbb\xbfa,b\n1,2", "bytes.csv": bytes(range(256)) * 50, "empty.csv": b"", "deep/long.csv": b"0123456789\n" * 200_000,
}


def test_digests_of_files_of_any_shape(spark, tmp_path):
    for name, data in CONTENTS.items():
        path = tmp_path / "files" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300000")  # the long file would be split seven times
    try:
        got = scans.file_digests(spark, str(tmp_path / "files"), str(tmp_path / "staging")).collect()
        assert spark.conf.get("spark.sql.files.maxPartitionBytes") == "300000"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {r["file_name"]: (r["bytes"], r["sha256"]) for r in got} == {n.split("/")[-1]: (len(c), hashlib.sha256(c).hexdigest()) for n, c in CONTENTS.items()}


def test_worst_file_speaks_for_its_dataset(spark):
    rows = [("a", "verified"), ("a", "unverifiable"), ("b", "mismatch"), ("b", "missing"), ("c", "verified"), ("c", "verified"), (None, "unregistered")]
    df = spark.createDataFrame(rows, "dataset string, status string")
    assert {r["dataset"]: r["overall"] for r in scans.manifest_overall(df).collect()} == {"a": "unverifiable", "b": "missing", "c": "verified"}


@pytest.mark.parametrize("kind", ["spread", "ties", "nulls", "few"])
def test_pages_cover_the_sorted_table(spark, kind):
    rnd = random.Random(4)
    n = 3 if kind == "few" else 1203
    value = {"spread": lambda i: float(i * 7 % 1000), "ties": lambda i: float(i % 3), "nulls": lambda i: None if i % 3 == 0 else rnd.random(), "few": float}[kind]
    rows = [(value(i), i) for i in range(n)]
    df = spark.createDataFrame(rows, "x double, id long").repartition(3)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0.0, r[1]))
    for number in (1, 2, 3, 99):
        got, totals = events.page(df, ["x", "id"], number, 500)
        at = min(number, -(-n // 500))
        assert [tuple(r) for r in got.collect()] == want[500 * (at - 1):500 * at]
        assert tuple(totals.first()) == (n, -(-n // 500), at)


def test_pages_by_time_and_of_nothing(spark):
    df = spark.range(50).select(F.timestamp_seconds(1000 - F.col("id")).alias("ts"), "id")
    got, _ = events.page(df, ["ts", "id"], 2, 20)
    assert [r["id"] for r in got.collect()] == list(range(29, 9, -1))
    none, totals = events.page(df.filter("id < 0"), ["ts", "id"], 4, 20)
    assert none.collect() == [] and tuple(totals.first()) == (0, 1, 1)


def test_recent_events_are_not_clamped(spark):
    df = spark.range(1500).select(F.timestamp_seconds("id").alias("ts"), F.col("id").cast("string").alias("event_id"))
    got = [int(r["event_id"]) for r in events.recent_events(df, 1200).collect()]
    assert got == list(range(1499, 299, -1)) and events.list_events(df, 1200).count() == 1000


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows on one day, and half of those at one instant."""
    t = F.when(F.col("id") % 6 == 0, 86_400 * 5).when(F.col("id") % 6 == 1, 86_400 * 5 + F.col("id") % 80_000).otherwise((F.col("id") * 7919) % (86_400 * 30))
    return spark.range(6000).select(F.timestamp_seconds(t).alias("ts"), F.col("id").alias("seq"), (F.col("id") % 5 == 0).cast("int").alias("y"), (F.col("id") % 4).cast("int").alias("enforced"))


def test_global_ranks_and_even_slices(spark, skewed):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        got = ordered.ranked_globally(skewed, ["ts", "seq"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [r["seq"] for r in sorted(got, key=lambda r: r["rn"])] == [r["seq"] for r in sorted(got, key=lambda r: (r["ts"], r["seq"]))]
    sizes = sorted(sum(r["_chunk"] == c for r in got) for c in {r["_chunk"] for r in got})
    assert len(sizes) == 12 and sizes[-1] < 2 * sizes[len(sizes) // 2]


def test_delay_and_split_on_skewed_times(spark, skewed):
    rows = sorted(skewed.collect(), key=lambda r: (r["ts"], r["seq"]))
    delays, start = [], None
    for i, r in enumerate(rows):
        if r["y"] == 1 and (i == 0 or rows[i - 1]["y"] != 1):
            start = i
            delays.append(50)
        if r["y"] == 1 and r["enforced"] >= 2 and delays[-1] == 50 and i - start < 50:
            delays[-1] = i - start
    got = policy.mitigation_delay(skewed, "enforced").first()
    assert (got["attack_runs"], got["mitigation_delay"]) == (len(delays), pytest.approx(sum(delays) / len(delays)))
    split = {r["seq"]: r["split"] for r in splits.temporal_split(skewed, "ts", "seq").collect()}
    order = [split[r["seq"]] for r in rows]
    assert order == sorted(order, key=["train", "validation", "test"].index) and set(order) == {"train", "validation", "test"}


def test_ladder_is_played_at_once_and_paired(spark):
    rnd = random.Random(8)
    rows = [(i, 1_700_000_000 + 40 * i, f"h{rnd.randrange(4)}", rnd.random(), rnd.randrange(2), rnd.random() < 0.1) for i in range(400)]
    df = spark.createDataFrame(rows, "seq long, t long, host_id string, score double, y int, is_critical boolean").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    ladder = ["always_allow", "single_threshold", "two_tier", "state_machine"]
    log = policy.played(df, policies=ladder, cooldown_s=90.0).collect()
    for four, mode, names in ((True, "4_action", ("two_tier", "state_machine")), (False, "3_action", ("state_machine",))):
        for name in names:
            if name == "two_tier":
                acted = df.withColumn("proposed", policy.two_tier(F.col("score"), four_action=four))
            else:
                acted = policy.tier_machine(df, four_action=four).withColumnRenamed("action", "proposed")
            alone = policy.step_cost(policy.safety_gate(acted, three_action=not four, cooldown_s=90.0), "high_availability")
            want = {r["seq"]: (r["enforced"], r["chatter_cost"] + r["fatigue_cost"]) for r in alone.collect()}
            got = {r["seq"]: (r["act"], r["extra"]) for r in log if (r["mode"], r["policy"]) == (mode, name)}
            assert got == want
    found = {(r["mode"], r["regime"], r["baseline"], r["candidate"]): r for r in policy.paired_policies(df, policies=ladder, cooldown_s=90.0, resamples=50).collect()}
    matrix = {(r["mode"], r["regime"], r["policy"]): r for r in policy.policy_matrix(df, policies=ladder, cooldown_s=90.0).collect()}
    assert len(found) == 2 * 3 * 5
    for (mode, regime, base, candidate), r in found.items():
        assert r["delta"] == pytest.approx(matrix[mode, regime, candidate]["mean_cost"] - matrix[mode, regime, base]["mean_cost"])
        assert r["ci_lower"] <= r["delta"] <= r["ci_upper"] and r["better_policy"] in (base, candidate, "equal")
