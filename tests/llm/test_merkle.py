from __future__ import annotations

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from flowlake.llm import merkle

from .corpus import documents, empty, frame, lowered


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v) -> str:
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r: tuple, text: str | None) -> str:
    return h(field(r[0]), field(r[3]), field(r[2]), field(r[4]), field(text))


def fold(nodes: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """The digest of a list of nodes, and for each its (left, right) siblings up to there."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            run = p // 8 * 8
            paths[i].append(("".join(nodes[run:p]), "".join(nodes[p + 1:run + 8])))
        nodes, at = [h(*nodes[i:i + 8]) for i in range(0, len(nodes), 8)], [p // 8 for p in at]
    return nodes[0], paths


def brute_force(rows: list[tuple], change=lowered) -> list[tuple]:
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append((-(2**70) if r[0] is None else r[0], leaf(r, r[1]), r))
    order = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    folded = {k: fold([x[1] for x in sorted(trees[k], key=lambda x: x[:2])]) for k in order}
    root, above = fold([folded[k][0] for k in order])
    found = []
    for n, k in enumerate(order):
        for (_, own, r), path in zip(sorted(trees[k], key=lambda x: x[:2]), folded[k][1], strict=True):
            path, at = path + above[n], own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None:
                at = leaf(r, change(r[1]))
            for left, right in path:
                at = h(left, at, right)
            found.append((r[0], own, folded[k][0], root, h(*[s for p in path for s in p]), at, at == root))
    return sorted(found, key=repr)


def query(spark, rows, tmp_path, clashing=True) -> list[tuple]:
    frame(spark, rows, clashing).write.parquet(str(tmp_path / "documents.parquet"))
    return sorted(map(tuple, merkle.op12_merkle_manifest(spark, str(tmp_path)).collect()), key=repr)


def many(n: int, languages: int = 3) -> list[tuple]:
    return [(i * 7 % n, f"Text {i}" if i % 5 else None, f"l{i % languages}" if i % 11 else None, "s", i) for i in range(n)]


@pytest.mark.parametrize("rows", [
    documents(n=20), many(1), many(9, 1), many(600, 1), many(30, 30),
    [(i, f"T{i}", f"lang{i}", None, None) for i in range(75)],  # every leaf alone, two levels above
    [(i, f"T{i}", "a" if i else "b", None, None) for i in range(514)],  # a leaf alone beside a tree of four levels
], ids=lambda rows: str(len(rows)))
def test_equal_to_brute_force(spark, rows, tmp_path):
    assert query(spark, rows, tmp_path) == brute_force(rows)


def test_sql_states_the_same_tree(spark, tmp_path):
    rows = documents(n=20) + many(90)
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    con.executemany("insert into documents values (?, ?, ?, ?, ?)", rows)
    assert sorted(con.execute(merkle.OP12_SQL).fetchall(), key=repr) == brute_force(rows)


def test_every_changed_field_is_noticed(spark):
    rows = many(40)
    found = merkle.manifest(frame(spark, rows), ["uid"])
    proofs = found.proofs.withColumn("doc_id", F.col("doc_id")).drop("lang")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    both = docs.join(proofs, "doc_id")
    for field_, other in (("text", F.lit("other")), ("lang", F.lit("xx")), ("source", F.lit(None)), ("n_chars", F.lit(-1))):
        bad = both.select(merkle.folded(merkle.leaf_of(**{field_: other}), F.col("path")).alias("root")).where(F.col("root") == found.root)
        assert bad.count() == 0
    good = both.select(merkle.folded(merkle.leaf_of(), F.col("path")).alias("root")).where(F.col("root") == found.root)
    assert good.count() == len(rows)


def test_fields_do_not_run_into_each_other(spark):
    rows = [(1, "b", "a", "", 1), (1, "b", "", "a", 1), (1, "-", "", None, 1), (1, None, "", "-", 1)]
    got = frame(spark, rows, clashing=False).select(merkle.leaf_of().alias("leaf")).distinct().count()
    assert got == 4


def test_rows_equal_in_all_fields_are_leaves_of_their_own(spark, tmp_path):
    rows = [(1, "Same", "en", "s", 4)] * 200 + many(50)
    assert query(spark, rows, tmp_path, clashing=False) == brute_force(rows)


def test_empty_table(spark, tmp_path):
    assert query(spark, [], tmp_path) == []
    assert merkle.manifest(empty(spark)).root is None
