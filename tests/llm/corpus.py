"""Small corpora with the awkward cases: nulls, empty, very long, tied and repeated rows, clashing columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("uid", "key", "name", "size", "slot", "shard", "node", "sig", "rep", "score", "kept", "count", "h", "_id", "_hash", "_key", "_uid", "gone_id", "n", "start", "bucket")


def words(rnd: random.Random, n: int) -> list[str]:
    return ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 9))) for _ in range(n)]


def documents(seed: int = 1, n: int = 60) -> list[tuple]:
    rnd = random.Random(seed)
    texts: list[str | None] = [None, "", " ", "\n\t", "one", "One", "one two", "é è ", "a  b\n\nc ", "x" * 9000]
    bases = [words(rnd, rnd.randint(5, 120)) for _ in range(8)]
    long = words(rnd, 30_000)
    texts += [" ".join(long), " ".join(long).upper(), " ".join([*long[:-1], "z"])]
    for _ in range(n):
        base = list(rnd.choice(bases))
        for _ in range(rnd.choice((0, 0, 1, 2, len(base) // 3))):
            base[rnd.randrange(len(base))] = words(rnd, 1)[0]
        texts.append(rnd.choice((" ", "\n")).join(base) + rnd.choice(("", ".", "!")))
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[5], rows[20], (rows[21][0], "another text for a used id", None, None, None), (None, "no id at all", "en", None, 12), (None, None, None, None, None)]
    rnd.shuffle(rows)
    return rows


def frame(spark, rows: list[tuple] | None = None, clashing: bool = True):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit(c) for c in CLASHING}) if clashing else df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lowered(text: str | None) -> str:
    return (text or "").translate(A_TO_Z)
