"""Operator 2: document fingerprints from prefix polynomial hashes.

The prefix array of a text holds the polynomial hash, modulo two primes, of each of its prefixes.
Any span's hash follows from two entries, so spans are compared in constant time and the longest
common extension of two positions is found by binary search (``PrefixHashes``).

A fingerprint keeps the length, the hash of the whole text, and the hashes of the prefixes and
suffixes whose length is a multiple of a power of two (32 to 63 of each, fewer for short texts).
Grids of two fingerprints nest, so the same binary search finds their longest common prefix and
suffix; ``likeness`` of two stored fingerprints is the share of the longer text that they cover, so
it sees no text between two edits. Equal texts have equal fingerprints and likeness 1.

``near_edited`` and ``near_next`` come from the prefix arrays of both texts (``resemblance``): the
common prefix and suffix to the character, then anchors, windows chosen by the text itself, whose
hashes meet in both; each meeting is extended both ways as far as any-span equality holds. The share
of the longer text in these spans counts, so every common span of ``LEAST`` characters around any
number of edits has an anchor, in whatever order such spans stand. Shorter ones count at the ends only.

The next document in descending id order is needed for each one. Rows are dealt into ranges of ids,
and the first document of each range is copied to the range before it, so no task sees more than a
range and one copy.

Defined cases: a null text counts as empty; two empty texts are alike, an empty and another one are
not; a null id is the smallest; equal ids are ordered by a hash of the text, descending; a single
document is its own next one; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, text_or_empty

PRIMES = (2**31 - 1, 2**31 - 19)
BASES = (911_382_323, 972_663_749)
GRID_BITS = 6
WINDOW, AMONG = 16, 16  # an anchor is the window of least hash among so many that follow each other
LEAST = WINDOW + AMONG - 1
NO_ID = -(2**63)
SCHEMA = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


class Powers:
    """Powers of a base and of its inverse modulo a prime, grown by doubling."""

    def __init__(self, base: int, prime: int) -> None:
        self.prime, self.bases = prime, (base, pow(base, -1, prime))
        self.tables = [np.ones(1, np.int64), np.ones(1, np.int64)]

    def upto(self, n: int) -> list[np.ndarray]:
        while len(self.tables[0]) < n:
            m = len(self.tables[0])
            self.tables = [np.concatenate([t, t * pow(b, m, self.prime) % self.prime]) for b, t in zip(self.bases, self.tables, strict=True)]
        return self.tables


POWERS = [Powers(b, p) for b, p in zip(BASES, PRIMES, strict=True)]


class PrefixHashes:
    """Prefix arrays of one text (code points, counted from 1 so that no character is zero)."""

    def __init__(self, text: str) -> None:
        points = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64) + 1
        self.n = len(points)
        self.prefix = []
        for powers in POWERS:
            table = powers.upto(self.n + 1)[0]
            sums = np.zeros(self.n + 1, np.int64)
            np.cumsum(points * table[: self.n] % powers.prime, out=sums[1:])
            self.prefix.append(sums % powers.prime)

    def spans(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """62-bit hashes of many spans."""
        one, two = (
            (h[stop] - h[start]) % p.prime * p.tables[1][start] % p.prime for h, p in zip(self.prefix, POWERS, strict=True)
        )
        return one << 31 | two

    def span(self, start: int, stop: int) -> int:
        return int(self.spans(np.array([start]), np.array([stop]))[0])

    def common_extension(self, start: int, other: PrefixHashes, other_start: int) -> int:
        """Length of the longest common span from ``start`` here and ``other_start`` there."""
        return _longest(
            min(self.n - start, other.n - other_start),
            lambda k: self.span(start, start + k) == other.span(other_start, other_start + k),
        )

    def same(self, start: int, other: PrefixHashes, other_start: int, n: int) -> bool:
        """Whether the spans of length ``n`` from both starts are equal: cross-multiplied, on plain integers."""
        for h, g, p in zip(self.prefix, other.prefix, POWERS, strict=True):
            one, two = (h.item(start + n) - h.item(start)), (g.item(other_start + n) - g.item(other_start))
            if (one * p.tables[0].item(other_start) - two * p.tables[0].item(start)) % p.prime:
                return False
        return True

    def extent(self, start: int, other: PrefixHashes, other_start: int, back: int, on: int) -> tuple[int, int]:
        """How far two positions agree backwards and onwards, at most ``back`` and ``on``."""
        return (
            _longest(back, lambda k: self.same(start - k, other, other_start - k, k)),
            _longest(on, lambda k: self.same(start, other, other_start, k)),
        )

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the windows that have the least hash among ``AMONG`` neighbours."""
        count = self.n - WINDOW + 1
        if count < AMONG:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        starts = np.arange(count)
        hashes = self.spans(starts, starts + WINDOW)
        edge = np.full(AMONG - 1, -1, np.int64)
        chosen = np.flatnonzero(_sliding(np.maximum, np.concatenate([edge, _sliding(np.minimum, hashes), edge])) == hashes)
        return chosen, hashes[chosen]

    def common_suffix(self, other: PrefixHashes) -> int:
        return _longest(min(self.n, other.n), lambda k: self.span(self.n - k, self.n) == other.span(other.n - k, other.n))

    def fingerprint(self) -> str:
        lengths = np.arange(1, self.n // grid_step(self.n) + 1) * grid_step(self.n)
        ends = np.full(len(lengths), self.n)
        heads, tails = self.spans(np.zeros_like(lengths), lengths), self.spans(ends - lengths, ends)
        shorten = lambda h: (h & 0xFFFFFFFF).astype(">u4").tobytes().hex()
        return f"{self.n:x}:{self.span(0, self.n):016x}:{shorten(heads)}:{shorten(tails)}"


def _sliding(extreme, values: np.ndarray) -> np.ndarray:
    """The extreme of each ``AMONG`` (a power of two) values that follow each other."""
    width = 1
    while width < AMONG:
        values = extreme(values[:-width], values[width:])
        width *= 2
    return values


def _longest(most: int, equal) -> int:
    """The largest k up to ``most`` with ``equal(k)``, which holds up to some length and not beyond."""
    low, high = 0, most
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if equal(mid) else (low, mid - 1)
    return low


def grid_step(n: int) -> int:
    return 1 << max(0, n.bit_length() - GRID_BITS)


def fingerprint(text: str) -> str:
    return PrefixHashes(text).fingerprint()


def likeness(a: str, b: str) -> float:
    """Share of the longer text in the common prefix and suffix that two fingerprints show, 0 to 1."""
    if a == b:
        return 1.0
    (na, _, heads_a, tails_a), (nb, _, heads_b, tails_b) = a.split(":"), b.split(":")
    na, nb = int(na, 16), int(nb, 16)
    if not na or not nb:
        return 0.0
    sa, sb = grid_step(na), grid_step(nb)
    step = max(sa, sb)
    at = lambda grid, own, k: grid[8 * (k * step // own - 1) : 8 * (k * step // own)]
    most = min(na, nb) // step
    head = _longest(most, lambda k: at(heads_a, sa, k) == at(heads_b, sb, k))
    tail = _longest(most, lambda k: at(tails_a, sa, k) == at(tails_b, sb, k))
    return min((head + tail) * step, na, nb) / max(na, nb)


def resemblance(a: PrefixHashes, b: PrefixHashes) -> float:
    """Share of the longer text in spans that both have, each used once, 0 to 1; see the module."""
    x, y = sorted((a, b), key=lambda t: (t.n, t.span(0, t.n)))
    if not x.n:
        return float(not y.n)
    head = x.extent(0, y, 0, 0, x.n)[1]
    tail = x.extent(x.n, y, y.n, x.n - head, 0)[0]
    shared = head + tail
    if shared < x.n:
        shared += _shared_inside(x, y, head, tail)
    return shared / y.n


def _shared_inside(x: PrefixHashes, y: PrefixHashes, head: int, tail: int) -> int:
    """Characters of common spans between the common prefix and suffix."""
    x_end, y_end = x.n - tail, y.n - tail
    if min(x_end, y_end) - head < LEAST:
        return 0
    (x_at, x_hash), (y_at, y_hash) = x.anchors(), y.anchors()
    known = np.isin(x_hash, y_hash)
    if not known.any():
        return 0
    places: dict[int, list[int]] = {}
    for at, h in zip(y_at.tolist(), y_hash.tolist(), strict=True):
        if head <= at and at + WINDOW <= y_end:
            places.setdefault(h, []).append(at)
    done, last, shared = head, head, 0
    used = [(-1, head), (y_end, y.n + 1)]  # spans of y, ascending

    def gap(at: int) -> tuple[int, int] | None:
        """The unused part of y around a window."""
        i = bisect_right(used, (at, y.n + 2))
        low, high = used[i - 1][1], used[i][0]
        return (low, high) if low <= at and at + WINDOW <= high else None

    for at, h in zip(x_at[known].tolist(), x_hash[known].tolist(), strict=True):
        open_ = places.get(h)
        if at < done or at + WINDOW > x_end or not open_:
            continue
        i = bisect_left(open_, last)
        place = open_[i] if i < len(open_) and gap(open_[i]) else None
        while place is None and open_:
            if gap(open_[-1]):
                place = open_[-1]
            else:
                open_.pop()
        if place is None:
            continue
        low, high = gap(place)
        back, on = x.extent(at, y, place, min(at - done, place - low), min(x_end - at, high - place))
        if back + on >= LEAST:
            insort(used, (place - back, place + on))
            done, last, shared = at + on, place + on, shared + back + on
    return shared


def edited(text: str, following: str) -> str:
    """The last half (rounded down) gives way to the start of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next_range(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Rows (_range, _copy, _key, _tie, doc_id, text), one partition per range of ids, sorted descending,
    each range followed by copies of the document that comes next."""
    spark = docs.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.withColumn("_key", F.coalesce("doc_id", F.lit(NO_ID)))
    cuts = rows.agg(F.percentile_approx("_key", [i / n for i in range(1, n)], 10_000).alias("c")).first()["c"] if n > 1 else None
    edges = np.array(sorted(set(cuts or [])), dtype=np.int64)

    @F.pandas_udf("int")
    def range_of(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, keys.to_numpy(np.int64))).astype("int32")

    rows = rows.withColumn("_range", range_of("_key"))
    first = sorted((tuple(r) for r in rows.groupBy("_range").agg(F.max("_key")).collect()), reverse=True)
    follows = [(key, first[(i - 1) % len(first)][0]) for i, (_, key) in enumerate(first)]
    follows = spark.createDataFrame(follows, "_first bigint, _before int")
    own, copy = F.struct(F.col("_range"), F.lit(False).alias("_copy")), F.struct(F.col("_before").alias("_range"), F.lit(True).alias("_copy"))
    places = F.when(F.col("_before").isNull(), F.array(own)).otherwise(F.array(own, copy))
    rows = rows.join(F.broadcast(follows), F.col("_key") == F.col("_first"), "left").withColumn("_place", F.explode(places))
    rows = rows.select("_place._range", "_place._copy", "_key", F.xxhash64("text").alias("_tie"), "doc_id", "text")
    dealt = rows.repartitionById(n, F.col("_range"))
    return dealt.sortWithinPartitions("_range", "_copy", F.desc("_key"), F.desc("_tie"))


def neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness; see ``SCHEMA``."""
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # the row that still waits for the next one

        def line(doc_id: int | None, text: str, hashes: PrefixHashes, own: str, following: str, next_hashes: PrefixHashes) -> tuple:
            changed = edited(text, following)
            other = hashes if changed == text else PrefixHashes(changed)
            print_ = own if changed == text else other.fingerprint()
            sha = hashlib.sha256(changed.encode()).hexdigest()
            return doc_id, len(text), sha, own, print_, resemblance(hashes, other), resemblance(hashes, next_hashes)

        for batch in batches:
            found = []
            for copy, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("_copy", "doc_id", "text")), strict=True):
                if copy and before is None:
                    continue
                hashes = PrefixHashes(text)
                if before is not None:
                    found.append(line(*before, text, hashes))
                before = None if copy else (doc_id, text, hashes, hashes.fingerprint())
            columns = list(zip(*found, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return with_next_range(docs).select("_copy", "doc_id", "text").mapInArrow(work, SCHEMA)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "documents"))
