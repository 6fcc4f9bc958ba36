from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from flowlake.llm import exact_dedup as X
from flowlake.llm.common import by_listed_id

from .corpus import documents, empty, frame, lowered


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[lowered(r[1])].append(r[0])
    out = []
    for r in rows:
        ids = groups[lowered(r[1])]
        known = [i for i in ids if i is not None]
        out.append((r[0], max(known) if known else None, len(ids), hashlib.sha256(lowered(r[1]).encode()).hexdigest()))
    return out


key = lambda r: tuple((x is not None, x or 0) if not isinstance(x, str) else (True, x) for x in r)


@pytest.mark.parametrize(("block", "hot"), [(4096, 500), (7, 500), (64, 3), (5, 2)])
def test_groups_against_plain_texts(spark, monkeypatch, block, hot):
    monkeypatch.setattr(X, "HOT_ONE_IN", hot)
    rows = documents() if block > 10 else [r for r in documents() if len(r[1] or "") < 2000]
    got = [(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"], r["kept"]) for r in X.exact_groups(frame(spark, rows), block_chars=block).collect()]
    assert sorted((g[:4] for g in got), key=key) == sorted(brute(rows), key=key)
    kept = defaultdict(int)
    for doc_id, keep_id, _, sha, stays in got:
        kept[sha] += stays
        assert not stays or doc_id == keep_id
    assert set(kept.values()) == {1}


def test_keep_one_keeps_one_row_per_text(spark):
    rows = documents()
    got = X.keep_one(frame(spark, rows))
    assert set(got.columns) == set(frame(spark, rows).columns)
    texts = [(r["doc_id"], lowered(r["text"])) for r in got.select("doc_id", "text").collect()]
    assert len(texts) == len({lowered(r[1]) for r in rows}) == len({t for _, t in texts})
    best = {hashlib.sha256(t.encode()).hexdigest(): d for d, t in texts}
    assert all(best[sha] == keep for _, keep, _, sha in brute(rows))


def test_one_text_for_a_third_of_the_rows(spark):
    rows = [(i, "same text" if i % 3 == 0 else f"text {i}", "en", "s", 1) for i in range(900)]
    got = X.exact_groups(frame(spark, rows)).collect()
    assert sum(r["kept"] for r in got) == 601 and {r["keep_id"] for r in got if r["group_size"] > 1} == {897}


def test_empty_table(spark):
    assert X.exact_groups(empty(spark)).collect() == [] and X.keep_one(empty(spark)).collect() == []


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_meet_in_one_shuffle(spark):
    rows = frame(spark, [(i, f"text {i % 700}", "en", "s", 1) for i in range(900)], clashing=False)
    named = X.named(X.block_rows(rows, X.lower_ascii(X.text_or_empty()), 64), 10**6)
    assert plan_of(named).count("Exchange hashpartitioning") == 1


def test_rows_with_other_ids_are_not_shuffled(spark):
    rows = frame(spark, clashing=True)
    ids = spark.createDataFrame([(3,), (None,), (7,), (10**12,)], "x long").withColumn("x", F.coalesce("x", F.lit(X.NO_ID)))
    listed, others = by_listed_id(rows, X.ref(), ids, "x")
    assert "Exchange hashpartitioning" not in plan_of(others) and listed.columns == others.columns == rows.columns
    near, far = listed.collect(), others.collect()
    assert {r["doc_id"] for r in near} >= {3, None, 7} and not {r["doc_id"] for r in far} & {3, None, 7}
    assert len(near) + len(far) == rows.count() and len(near) < 12
