from __future__ import annotations

from collections import Counter
from itertools import combinations

from hypothesis import given, settings
from hypothesis import strategies as st

from flowlake.llm import packing

from .corpus import documents, empty, frame


def padded(lengths, counts, edges):
    return sum(c * min(e for e in edges if e >= x) for x, c in zip(lengths, counts, strict=True))


@given(st.dictionaries(st.integers(1, 60), st.integers(1, 9), min_size=1, max_size=9), st.integers(1, 5))
@settings(max_examples=200, deadline=None)
def test_boundaries_are_optimal(histogram, buckets):
    lengths = sorted(histogram)
    counts = [histogram[x] for x in lengths]
    edges = packing.boundaries(lengths, counts, buckets)
    best = min(
        padded(lengths, counts, [*inner, lengths[-1]]) for k in range(min(buckets, len(lengths))) for inner in combinations(lengths[:-1], k)
    )
    assert len(edges) <= buckets and edges[-1] == lengths[-1] and padded(lengths, counts, edges) == best


def check(got, rows, budget):
    want = Counter((r[0], len((r[1] or "").encode()) + 1) for r in rows)
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got) == want
    assert all(r["padding"] == r["boundary"] - r["n_tokens"] >= 0 for r in got)
    batches = {}
    for r in got:
        batches.setdefault((r["bucket"], r["batch"]), []).append(r)
    for (bucket, batch), members in batches.items():
        per = max(1, budget // members[0]["boundary"])
        assert sorted(m["slot"] for m in members) == list(range(len(members))) and len(members) <= per
        if (bucket, batch + 1) in batches:
            assert len(members) == per
    for bucket in {b for b, _ in batches}:
        numbers = sorted(n for b, n in batches if b == bucket)
        assert numbers == list(range(len(numbers)))


def test_batches(spark):
    check(packing.pack(frame(spark), buckets=4, budget=2000, keep=["lang"]).collect(), documents(), 2000)


def test_boundaries_follow_the_whole_table(spark):
    rows = documents()
    counted = sorted(Counter(len((r[1] or "").encode()) + 1 for r in rows).items())
    want = packing.boundaries([x for x, _ in counted], [n for _, n in counted], 5)
    got = packing.pack(frame(spark), buckets=5, budget=10_000, cells=10**6).select("boundary").distinct().collect()
    assert {r[0] for r in got} <= set(want)


def test_empty_table(spark):
    assert packing.pack(empty(spark)).collect() == []


def rows_of(counted):
    return [(i, "a" * (x - 1), "en", "s", x - 1) for i, x in enumerate(x for x, n in counted for _ in range(n))]


def test_a_huge_row_leaves_the_boundaries_of_the_others(spark):
    counted = [(x, 1 + x % 7) for x in range(2, 400, 3)] + [(20_000_000, 1)]
    rows = rows_of(counted)
    want = padded(*zip(*counted, strict=True), packing.boundaries(*zip(*counted, strict=True), packing.BUCKETS))
    got = packing.pack(frame(spark, rows, clashing=False)).agg({"boundary": "sum"}).first()[0]
    assert got == want
    small = counted[:-1]
    assert want - 20_000_000 == padded(*zip(*small, strict=True), packing.boundaries(*zip(*small, strict=True), packing.BUCKETS - 1))


def test_cells_of_nearly_equal_lengths(spark):
    longest, cells = 2_000_000, 5000
    lengths = spark.range(1, 30_001).selectExpr("id as n_tokens").union(spark.range(1).selectExpr(f"{longest}L as n_tokens"))
    counted = packing.histogram(lengths, cells)
    r = packing.relative_cells(longest, cells)
    assert r > 500 and len(counted) <= cells and counted[-1] == (longest, 1) and sum(n for _, n in counted) == 30_001
    ends = [x for x, _ in counted]
    assert ends[:r] == list(range(1, r + 1))
    assert all(n <= 1 + x / r for x, n in counted)
    assert packing.relative_cells(2**31, packing.CELLS) > 15_000
