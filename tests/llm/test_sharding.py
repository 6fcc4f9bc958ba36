from __future__ import annotations

import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flowlake.llm import common, sharding

from .corpus import documents, empty, frame


@given(st.lists(st.integers(0, 30), min_size=4, max_size=40), st.integers(1, 4), st.randoms())
@settings(max_examples=200, deadline=None)
def test_walk_places_every_row_once_within_the_bounds(counts, shards, rnd):
    owner = [i % shards for i in range(len(counts))]
    rnd.shuffle(owner)
    owner[:shards] = range(shards)
    room = sharding.bounds(sum(counts), shards)
    ranges = sharding.walk(counts, owner, room)
    rows = [(arc, r) for arc, lo, hi, *_ in ranges for r in range(lo, hi)]
    assert sorted(rows) == [(a, r) for a, n in enumerate(counts) for r in range(n)]
    slots = Counter()
    for _, lo, hi, shard, first in ranges:
        slots.update((shard, first + i) for i in range(hi - lo))
    assert set(slots) == {(s, i) for s in range(shards) for i in range(room[s])} and max(slots.values(), default=1) == 1


def test_rows_that_fit_stay_at_home():
    ranges = sharding.walk([3, 1, 0, 4], [0, 1, 2, 0], [7, 1, 0])
    assert all(shard == [0, 1, 2, 0][arc] for arc, _, _, shard, _ in ranges)


@pytest.mark.parametrize("shards", [1, 3, 40])
def test_counts_slots_and_columns(spark, shards):
    got = sharding.shard(frame(spark), shards, keep=["lang"]).collect()
    rows = documents()
    want = Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    per = Counter(r["shard"] for r in got)
    assert max(per.values()) - min(per.get(s, 0) for s in range(shards)) <= 1
    for s in per:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(per[s]))


def test_one_id_for_a_third_of_the_rows(spark):
    rows = [(5 if i % 3 == 0 else i, f"text {i % 7}", "en", "s", 1) for i in range(600)]
    per = Counter(r["shard"] for r in sharding.shard(frame(spark, rows), 7).collect())
    assert sum(per.values()) == 600 and max(per.values()) - min(per.values()) <= 1


def test_spread_rank_over_several_cells(spark):
    rows = spark.range(1000).selectExpr("id as uid", "case when id < 900 then 'hot' else 'cold' end as g").checkpoint()
    got = common.spread_rank(rows, "g", ["uid"], "uid", "rank", least=50).collect()
    for g in ("hot", "cold"):
        assert sorted(r["rank"] for r in got if r["g"] == g) == list(range(900 if g == "hot" else 100))


def test_empty_table(spark):
    assert sharding.shard(empty(spark)).collect() == []
