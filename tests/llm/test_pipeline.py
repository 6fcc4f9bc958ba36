from __future__ import annotations

import random

import corpus_pipeline as C
from flowlake.llm import queries

from .corpus import SCHEMA, words
from .test_near_dedup import brute


def tables(spark, folder):
    rnd = random.Random(6)
    rows, labels = [], []
    for i in range(200):
        text = " ".join(words(rnd, rnd.randint(25, 60)))
        bad = i % 5 == 0
        rows.append((i, text.upper().replace(" ", "!! ") if bad else text, "en", "s", len(text)))
        labels.append((i, int(not bad), 0))
    copies = [(300 + i, rows[i][1], "en", "s", 1) for i in range(1, 60, 7)]
    near = [(400 + i, rows[i][1] + " tail", "en", "s", 1) for i in range(2, 60, 9)]
    private = [(500, "write to me@home.org today, " + " ".join(words(rnd, 40)), "en", "s", 1)]
    rows += copies + near + private
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows


def test_stages_one_after_the_other(spark, tmp_path):
    rows = tables(spark, str(tmp_path))
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), [rows]
    for k, (_, stage) in enumerate(C.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/stage-{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage-{k}")
        if k < 4:
            assert docs.columns == columns
        kept.append([tuple(r) for r in docs.collect()])
    _, good, exact, near, clean, packed = kept
    assert {r[0] for r in good} == {r[0] for r in rows if "!!" not in r[1]}
    assert len(exact) == len({r[1].lower() for r in good})
    assert {r[0] for r in near} == {r[0] for r in brute(exact, 5) if r[3]} and len(near) < len(exact)
    assert [r[1] for r in clean if r[0] == 500][0].startswith("write to <email> today")
    assert all(len(r[1]) == r[4] for r in clean)
    assert sorted(r[0] for r in packed) == sorted(r[0] for r in clean)


def test_run_returns_the_last_stage(spark, tmp_path):
    tables(spark, str(tmp_path))
    got = C.run(spark, str(tmp_path))
    again = C.run(spark, str(tmp_path))  # must not remove what the first result still reads
    assert {"doc_id", "bucket", "batch", "slot"} <= set(got.columns) and got.count() == again.count() > 100


def test_every_operator_is_registered():
    assert [sum(q.startswith(f"op{n}_") for q in queries.QUERIES) for n in range(1, 14)] == [1] * 13
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES) and len(C.STAGES) == 5 and C.ORACLE_SQL is None
