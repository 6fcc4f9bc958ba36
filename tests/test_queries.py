"""Registered queries against their SQL on the smallest tables."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb
import pytest

from flowlake.queries import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"
# a spread over all groups; the driver compares every query
CHOSEN = sorted(ORACLE_SQL)[::5]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return str(v)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_its_sql(spark, duck, name):
    got = QUERIES[name](spark, DIR)
    want = duck.sql(ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    mine = Counter(tuple(plain(r[c]) for c in columns) for r in got.collect())
    assert mine == Counter(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_entry_and_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(QUERIES) > 200


def test_models_see_the_whole_embedding(spark):
    wide = len(spark.read.parquet(f"{DIR}/embeddings.parquet").select("embedding").first()[0])
    got = {r["feature"] for r in QUERIES["ml2_importances"](spark, DIR).select("feature").collect()}
    assert got == {f"f{i}" for i in range(wide)}
