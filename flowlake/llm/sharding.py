"""Operator 3: shards by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points of a 64-bit ring, and a row belongs to the first point clockwise
of its hash. A shard takes rows up to its bound; rows that find it full continue clockwise to the
next point whose shard has room. The bounds are ``total // shards``, one more for the first
``total % shards`` shards, so that counts are at most one apart (the law ``rows``).

Only row counts per arc reach the driver (``shards * vnodes`` numbers). The walk over the ring is
done on those counts, as ranges of ranks in an arc, and the rows then look up their own range.

Defined cases: a null text has size 16 and CRC 0; a null id is a key like any other; repeated rows
are separate rows with separate slots; an empty table gives an empty result; columns named in
``keep`` travel along, whatever their names, unless they clash with the result's own.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder, spread_rank, table, text_or_empty

SHARDS, VNODES, ROW_BYTES = 40, 64, 16


def ring(shards: int, vnodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted positions of all virtual nodes on the signed 64-bit ring, and their shards."""
    points = sorted(
        (int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "big", signed=True), s)
        for s in range(shards) for v in range(vnodes)
    )
    return np.array([p for p, _ in points], dtype=np.int64), np.array([s for _, s in points])


def bounds(total: int, shards: int) -> list[int]:
    return [total // shards + (s < total % shards) for s in range(shards)]


def walk(counts: Sequence[int], owner: Sequence[int], room: Sequence[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, rank after the last, shard, first slot) for all ranks of all arcs.

    First each point takes from its own arc what its shard has room for. The rest of an arc then
    continues clockwise, the longest travelling first; two turns reach every point.
    """
    room, filled, found = list(room), [0] * len(room), []

    def take(arc: int, lo: int, hi: int, shard: int) -> int:
        n = min(hi - lo, room[shard])
        if n:
            found.append((arc, lo, lo + n, shard, filled[shard]))
            room[shard] -= n
            filled[shard] += n
        return lo + n

    rest = [take(arc, 0, n, owner[arc]) for arc, n in enumerate(counts)]
    queue: deque[list[int]] = deque()
    for turn in range(2):
        for arc, shard in enumerate(owner):
            if turn == 0 and rest[arc] < counts[arc]:
                queue.append([arc, rest[arc], counts[arc]])
            while queue and room[shard]:
                first = queue[0]
                first[1] = take(*first, shard)
                if first[1] == first[2]:
                    queue.popleft()
    return found


def shard(docs: DataFrame, shards: int = SHARDS, vnodes: int = VNODES, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, home_shard (before any overflow) and the ``keep`` columns."""
    spark = docs.sparkSession
    shared_folder(spark)
    positions, owner = ring(shards, vnodes)

    @F.pandas_udf("int")
    def arc_of(h: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(positions, h.to_numpy(np.int64)) % len(positions)).astype("int32")

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text_or_empty()) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text_or_empty().cast("binary")).alias("text_crc32"),
        *[F.col(c) for c in keep],
    )
    rows = rows.withColumn("_hash", F.xxhash64(F.col("doc_id").cast("string"))).withColumn("_arc", arc_of("_hash"))
    rows = rows.withColumn("_uid", F.monotonically_increasing_id()).checkpoint()
    counts = {r[0]: r[1] for r in rows.groupBy("_arc").count().collect()}
    per_arc = [counts.get(a, 0) for a in range(len(positions))]
    ranges = walk(per_arc, owner.tolist(), bounds(sum(per_arc), shards))
    ranges = spark.createDataFrame(
        [(*r, int(owner[r[0]])) for r in ranges], "_a int, _lo bigint, _hi bigint, shard int, _first bigint, home_shard int"
    )
    ranked = spread_rank(rows, "_arc", ["_hash", "doc_id", "text_crc32", "_uid"], "_uid", "_rank")
    mine = (F.col("_arc") == F.col("_a")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi"))
    placed = ranked.join(F.broadcast(ranges), mine)
    return placed.select(
        "doc_id", "size", "text_crc32", "shard", (F.col("_first") + F.col("_rank") - F.col("_lo")).alias("slot"), "home_shard", *keep
    )


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home_shard"
    )
