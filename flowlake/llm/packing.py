"""Operator 5: batches from optimal length buckets.

The global histogram of lengths is counted in Spark and dynamic programming on it chooses the bucket
boundaries that need the least padding in total. Inside a bucket, where every row is padded to the
boundary, batches of a token budget form: ``budget // boundary`` rows each, one at least.

Lengths are byte-level tokens (UTF-8 bytes and an end token) unless another length is given. The
histogram has ``CELLS`` cells at most. Up to that many distinct lengths, however long, a cell is one
length and the boundaries are optimal. Where there are more, a cell holds lengths of nearly equal
size: the lengths of a cell differ by one part in ``r`` at most (r is about 20 000 with the longest
text Spark can hold) and lengths up to ``r`` keep cells of their own, so no row widens the cells of
the shorter ones; a boundary is then the longest length of its cell.

Defined cases: a null text counts as empty and has length 1; a row longer than the budget gets a
batch of its own; ties and repeated rows get places of their own; an empty table gives an empty
result; columns named in ``keep`` travel along and further ones are ignored.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spread_rank, staged, table, text_or_empty

BUCKETS, TOKEN_BUDGET, CELLS = 16, 1 << 18, 1 << 18


def byte_tokens() -> Column:
    return (F.octet_length(text_or_empty()) + 1).cast("long")


def boundaries(lengths: Sequence[int], counts: Sequence[int], buckets: int) -> list[int]:
    """At most ``buckets`` of the ascending ``lengths``, the last one included, with the least
    padding when every row is padded to the next boundary; of equal choices the fewest buckets.

    A round allows one bucket more and takes time linear in the lengths: what the first i lengths
    cost before a last bucket is a line in the length that ends it, the lines fall ever steeper and
    the lengths ascend, so the lower envelope is walked once. Integers keep every sum exact.
    """
    x, n = [int(v) for v in lengths], len(lengths)
    if not n:
        return []
    c = [0]
    for v in counts:
        c.append(c[-1] + int(v))
    # cost[j]: padded size of the first j lengths; a bucket of lengths i..j-1 costs x[j-1] * (c[j] - c[i])
    cost = [0, *(v * m for v, m in zip(x, c[1:], strict=True))]
    choices, totals = [array("l", bytes(8 * (n + 1)))], [cost[n]]
    for _ in range(1, min(buckets, n)):
        new, choice, lines, at = cost.copy(), array("l", bytes(8 * (n + 1))), [], 0
        for j in range(1, n + 1):
            k = j - 1
            while len(lines) > 1 and (cost[k] - cost[lines[-2]]) * (c[lines[-1]] - c[lines[-2]]) <= (cost[lines[-1]] - cost[lines[-2]]) * (c[k] - c[lines[-2]]):
                lines.pop()
            lines.append(k)
            at = min(at, len(lines) - 1)
            end = x[k]
            while at + 1 < len(lines) and cost[lines[at + 1]] - end * c[lines[at + 1]] < cost[lines[at]] - end * c[lines[at]]:
                at += 1
            i = lines[at]
            new[j], choice[j] = cost[i] + end * (c[j] - c[i]), i
        cost = new
        choices.append(choice)
        totals.append(cost[n])
    found, j = [], n
    for choice in reversed(choices[: totals.index(min(totals)) + 1]):
        found.append(x[j - 1])
        j = choice[j]
        if not j:
            break
    return found[::-1]


def relative_cells(longest: int, cells: int) -> int:
    """The largest r for which single lengths up to r, and beyond it cells whose ends grow by one part in
    r, are ``cells`` at most up to ``longest``; 1 at least."""
    low, high = 1, cells
    while low < high:
        r = (low + high + 1) // 2
        low, high = (r, high) if r + math.log(max(longest, r) / r) / math.log1p(1 / r) + 1 <= cells else (low, r - 1)
    return low


def histogram(rows: DataFrame, cells: int) -> list[tuple[int, int]]:
    """(longest length, rows) of each cell, ascending: every distinct length, or cells of nearly equal
    lengths where more than ``cells`` lengths are distinct."""
    counted = rows.groupBy("n_tokens").agg(F.count("*").alias("n"))
    found = counted.agg(F.count("*"), F.max("n_tokens")).first()
    if found[0] > cells:
        r, x = relative_cells(found[1], cells), F.col("n_tokens")
        cell = F.when(x <= r, x.cast("double")).otherwise(r + F.ceil(F.log(x / r) / math.log1p(1 / r)))
        counted = counted.groupBy(cell.alias("cell")).agg(F.max("n_tokens").alias("n_tokens"), F.sum("n").alias("n"))
    return sorted((r["n_tokens"], r["n"]) for r in counted.collect())


def pack(
    docs: DataFrame, buckets: int = BUCKETS, budget: int = TOKEN_BUDGET, length: Column | None = None, cells: int = CELLS, keep: Sequence[str] = (),
) -> DataFrame:
    """doc_id, n_tokens, bucket, boundary, batch (numbered inside the bucket), slot (inside the batch), padding."""
    length = byte_tokens() if length is None else length
    rows = docs.select(F.monotonically_increasing_id().alias("_uid"), F.col("doc_id").cast("long").alias("doc_id"), length.alias("n_tokens"), *keep)
    rows = staged(rows, "lengths")
    counted = histogram(rows, cells)
    edges = boundaries([x for x, _ in counted], [n for _, n in counted], buckets)
    chosen = F.array(*[F.lit(e).cast("long") for e in edges]) if edges else F.array(F.lit(0).cast("long"))
    place = F.size(F.filter(chosen, lambda e: e < F.col("n_tokens")))
    rows = rows.withColumn("bucket", place).withColumn("boundary", F.get(chosen, F.col("bucket")))
    ranked = spread_rank(rows, "bucket", ["n_tokens", "doc_id", "_uid"], "_uid", "_rank")
    per_batch = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("boundary"))).cast("long")
    return ranked.select(
        "doc_id", "n_tokens", "bucket", "boundary", F.floor(F.col("_rank") / per_batch).cast("long").alias("batch"),
        F.pmod(F.col("_rank"), per_batch).alias("slot"), (F.col("boundary") - F.col("n_tokens")).alias("padding"), *keep,
    )


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
