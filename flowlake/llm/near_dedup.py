"""Operator 4: near-duplicates by bottom-k sketches of one hash function.

A document is the set of its distinct word shingles, each hashed once. Documents with equal sets are
one class, and everything below works on classes. The sketch of a class holds its ``SKETCH``
smallest hashes (the whole set where that is smaller).

Candidates. Two sets with Jaccard similarity J share in their sketches at least the values of their
intersection among the ``SKETCH`` smallest of the union, a sample of the union in which each value
is shared with probability J. For J >= 0.8 fewer than ``LEAST_SHARED`` of 64 are shared with a
probability below 1e-6; sets that are retained whole share at least 0.8 of their values for certain.
So two linked classes meet in the inverted list of one of their rarest retained values: of ``len``
values, the ``len - least + 1`` rarest suffice. Values of a single class have no list.

Pairs. No list is expanded into all its pairs. In a star round each member meets the pivots of its
``STAR_LISTS`` longest lists: the ``STAR_PIVOTS`` members that share most of their sketches with others,
or random ones in further rounds. The union sketch estimates each pair, exact Jaccard on the full sets verifies the ``BEST`` ones of each
member, and components are formed. Members of one component need no further pair. Lists that still
hold several components then compare the members outside their largest component with the members of
other components; that covers every remaining pair of every list. While that would try more than
``PATIENCE`` pairs per list entry, another star round with new pivots comes first, ``STAR_ROUNDS`` at most.

A bitmap of ``BITS`` bits rules most pairs out where they meet: each bit that one of two sets has alone
is a value that they do not share, which bounds their intersection. It marks the whole set up to
``BITS`` values, where the bound is exact, and the sketch beyond. Members of lists longer than ``LONG``,
as a large group of near copies has, meet in many such lists and are too alike for that bitmap. For these
comparisons their full sets are made again and marked in ``WIDE`` bits, blocks of about ``BLOCK`` members
meet in one task, and a pair is given only by the first of the long lists that hold both.

Components are contracted along smallest neighbours, with pointer jumping, in staged tables; links
and components never reach the driver.

Defined cases: a null or empty text, or one without words, has an empty set, links to nothing and is
kept; a text with fewer words than a shingle has one shingle, its whole sequence; a null id is the
smallest id; rows with equal ids are separate rows and each is kept if its id is its component's;
an empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import by_listed_id, map_batches, small_batches, staged, table, text_or_empty, texts_of

WORDS, SKETCH, LEAST_SHARED = 5, 64, 34
PERCENT = 80
BITS, STAR_LISTS, STAR_PIVOTS = 256, 2, 4
PATIENCE, STAR_ROUNDS, BEST = 8, 1, 3
LONG, WIDE, BLOCK = 32, 2048, 4096
NO_ID = -(2**63)
_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_S30, _S27, _S31, _ONE = (np.uint64(x) for x in (30, 27, 31, 1))


# ---- sets and sketches ---------------------------------------------------------------------------


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S30)) * _MIX[1]
    x = (x ^ (x >> _S27)) * _MIX[2]
    return x ^ (x >> _S31)


def shingles(text: str, words: int) -> np.ndarray:
    """Sorted distinct 63-bit hashes of the word shingles. bytes.lower and bytes.split are ASCII only."""
    found = text.encode().lower().split()
    if not found:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(xxh3_64_intdigest, found), np.uint64, len(found))
    span = min(words, len(h))
    count = len(h) - span + 1
    s = np.full(count, np.uint64(span), np.uint64)
    for i in range(span):
        s = _mixed(s * _MIX[0] + h[i : i + count])
    return np.unique((s >> _ONE).astype(np.int64))


def text_hash() -> Column:
    return F.xxhash64(text_or_empty())


def signature(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def marks(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """A bitmap of each set, one row of longs."""
    marked = np.zeros((len(sets), bits), bool)
    marked[np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets) % bits] = True
    return np.packbits(marked, axis=1, bitorder="little").view("<i8")


def sketches(docs: DataFrame, words: int, k: int) -> DataFrame:
    """doc_id, text_hash, n, sig (of the whole set), sketch and bitmap of every document."""
    small_batches(docs.sparkSession)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t, words) for t in texts_of(batch)]
        short = [s[:k] for s in sets]
        lengths = np.array([len(s) for s in short])
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        values = np.concatenate(short)
        bits = marks([s if len(s) <= BITS else s[:k] for s in sets], BITS)
        return pa.RecordBatch.from_arrays([
            batch.column("doc_id"), batch.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()), pa.array([signature(s) for s in sets], pa.binary()),
            pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int64())), pa.array(list(bits), pa.list_(pa.int64())),
        ], names=["doc_id", "text_hash", "n", "sig", "sketch", "bits"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("text_hash"), text_or_empty().alias("text"))
    return rows.mapInArrow(lambda b: map_batches(b, work), "doc_id bigint, text_hash bigint, n bigint, sig binary, sketch array<bigint>, bits array<bigint>")


# ---- candidates ----------------------------------------------------------------------------------


def least_shared(k: int) -> Column:
    """Values that a set of ``n`` must share, of those that both sketches retain, with any set it links to."""
    exact = F.ceil(F.col("n") * PERCENT / 100)
    return F.when(F.col("n") * 100 <= k * PERCENT, exact).otherwise(F.least(exact, F.lit(LEAST_SHARED * k // SKETCH)))


def prefixes(classes: DataFrame, k: int) -> DataFrame:
    """The inverted lists of the rarest retained values that can decide a link: value, from_end (place
    among the class's entries, the most frequent first), node, n, take, slack, bits."""
    # three values or fewer: similarity 0.8 needs equal sets
    large = classes.filter("n > 3")
    retained = large.select("node", F.explode("sketch").alias("value"))
    shared = staged(retained.groupBy("value").count().filter("count > 1"), "frequencies")
    known = retained.join(shared, "value").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("count", "value"))).alias("known"))
    slack = (F.size("sketch") - least_shared(k)).cast("int").alias("slack")
    known = known.join(large.select("node", "n", slack, *[F.col("bits")[i].alias(f"b{i}") for i in range(BITS // 64)]), "node")
    take = F.size("known") - least_shared(k) + 1  # the values of this class alone come first
    known = known.withColumn("take", take.cast("int")).filter("take > 0")
    lists = known.select(*MEMBER, "take", F.posexplode(F.slice("known", F.lit(1), F.col("take"))).alias("i", "x"))
    return lists.select("node", "x.value", (F.col("take") - F.col("i")).alias("from_end"), "n", "take", *MEMBER[2:])


MEMBER = ["node", "n", "slack", *[f"b{i}" for i in range(BITS // 64)]]


def named_member(prefix: str) -> list[Column]:
    return [F.col(c).alias(f"{prefix}_{c}") for c in MEMBER]


def may_link() -> Column:
    """Whether sizes and bitmaps of the members x and y allow a link."""

    def side(a: str, b: str) -> Column:
        ones = [F.bit_count(F.col(f"{a}_b{i}").bitwiseAND(F.bitwise_not(F.col(f"{b}_b{i}")))) for i in range(BITS // 64)]
        na, nb = F.col(f"{a}_n"), F.col(f"{b}_n")
        # values of a that b may lack: by the sizes where both bitmaps are whole, else by the sketch of a
        whole = F.floor(na - (na + nb) * (PERCENT / (100 + PERCENT)) + 1e-6)
        most = F.when((na <= BITS) & (nb <= BITS), whole).when(na > BITS, F.col(f"{a}_slack")).otherwise(BITS)
        return sum(ones[1:], ones[0]) <= most

    return near_size("x_n", "y_n") & side("x", "y") & side("y", "x")


def near_size(a: str, b: str) -> Column:
    return (F.col(a) * 100 >= F.col(b) * PERCENT) & (F.col(b) * 100 >= F.col(a) * PERCENT)


def ordered_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def star_pairs(lists: DataFrame, seed: int) -> DataFrame:
    """Members of lists with the pivots of the list."""
    order = F.xxhash64("node", F.lit(seed))
    near = lists.filter(F.col("from_end") <= STAR_LISTS)
    first = [F.desc("take"), order] if seed == 0 else [order]
    place = F.row_number().over(Window.partitionBy("value").orderBy(*first))
    pivots = near.withColumn("place", place).filter(F.col("place") <= STAR_PIVOTS).select("value", *named_member("y"))
    met = near.select("value", *named_member("x")).join(pivots, "value").filter((F.col("x_node") != F.col("y_node")) & may_link())
    return ordered_pairs(met.select(F.col("x_node").alias("x"), F.col("y_node").alias("y")))


def likely(pairs: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """Pairs that the union sketch does not rule out, with ``shared``, the values both retain in it."""
    side = lambda c: classes.select(F.col("node").alias(c), F.col("sketch").alias(f"s{c}"), F.col("n").alias(f"n{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter(near_size("na", "nb"))
    union = F.slice(F.sort_array(F.array_union("sa", "sb")), 1, k)
    both = both.withColumn("common", F.array_intersect("sa", "sb")).withColumn("union", union)
    shared = F.size(F.array_intersect("union", "common"))
    whole = (F.col("na") <= k) & (F.col("nb") <= k)
    size = F.col("na") + F.col("nb") - F.size("common")
    both = both.withColumn("shared", F.when(whole, F.size("common")).otherwise(shared))
    enough = F.when(whole, F.col("shared") * 100 >= size * PERCENT).otherwise(F.col("shared") >= LEAST_SHARED * k // SKETCH)
    return both.filter(enough).select("a", "b", "shared")


def best_of_each(pairs: DataFrame) -> DataFrame:
    """For each node the ``BEST`` pairs with the most shared values."""
    ends = pairs.select(F.col("a").alias("x"), F.col("b").alias("y"), "shared").union(pairs.select("b", "a", "shared"))
    place = F.row_number().over(Window.partitionBy("x").orderBy(F.desc("shared"), "y"))
    return ordered_pairs(ends.withColumn("place", place).filter(F.col("place") <= BEST))


def from_full_sets(nodes: DataFrame, docs: DataFrame, classes: DataFrame, words: int, make: Callable[[list[np.ndarray]], list]) -> DataFrame:
    """node and ``made``: what ``make`` gives for the full sets of ``nodes``, made again from the few texts it takes."""
    small_batches(docs.sparkSession)
    needed = staged(nodes.join(classes.select("node", "rep", "sig"), "node"), "needed")
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("rep"), "text")
    texts, _ = by_listed_id(texts, F.col("rep"), needed, "rep")

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [shingles(t, words) for t in texts_of(batch)]
        right = [signature(s) == sig for s, sig in zip(made, batch.column("sig").to_pylist(), strict=True)]
        found = pa.RecordBatch.from_arrays([batch.column("node"), pa.array(make(made), pa.binary())], names=["node", "made"])
        return found.filter(pa.array(right, pa.bool_()))

    full = texts.join(needed, "rep").select("node", "sig", "text").mapInArrow(lambda b: map_batches(b, sets), "node bigint, made binary")
    return full.dropDuplicates(["node"])


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """``pairs`` with ``linked``: exact Jaccard on the full sets."""
    needed = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    full = from_full_sets(needed, docs, classes, words, lambda made: [s.tobytes() for s in made])
    full = staged(full, "full-sets", "none")
    side = lambda c: full.select(F.col("node").alias(c), F.col("made").alias(f"h{c}"))

    def compare(batch: pa.RecordBatch) -> pa.RecordBatch:
        linked = []
        for x, y in zip(batch.column("ha").to_pylist(), batch.column("hb").to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
            common = len(np.intersect1d(x, y, assume_unique=True))
            linked.append(100 * common >= PERCENT * (len(x) + len(y) - common))
        return pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    met = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "ha", "hb")
    return met.mapInArrow(lambda b: map_batches(b, compare), "a bigint, b bigint, linked boolean")


# ---- components ----------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): every node of ``edges`` (staged) with one label per component.

    Each node points to its smallest neighbour or itself, pointers are followed to their ends, and
    the edges between ends remain; at least half of the nodes go in every turn.
    """
    labels: DataFrame | None = None
    while True:
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
        point = staged(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("comp")), "pointers")
        while True:
            ahead = point.select(F.col("node").alias("comp"), F.col("comp").alias("end"))
            further = staged(point.join(ahead, "comp").select("node", F.col("end").alias("comp"), (F.col("end") != F.col("comp")).alias("moved")), "pointers")
            point = further.select("node", "comp")
            if further.filter("moved").isEmpty():
                break
        if labels is None:
            labels = point
        else:
            onward = point.select(F.col("node").alias("comp"), F.col("comp").alias("end"))
            labels = staged(labels.join(onward, "comp", "left").select("node", F.coalesce("end", "comp").alias("comp")), "labels")
        end = lambda c: point.select(F.col("node").alias(c), F.col("comp").alias(f"to_{c}"))  # noqa: E731, B023
        left = edges.join(end("a"), "a").join(end("b"), "b").filter("to_a <> to_b")
        edges = staged(left.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            return labels


def mixed_lists(lists: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The members, with comp, major and the length of the list, of the lists that hold more than one component."""
    if labels is None:
        marked = lists.withColumn("comp", F.col("node"))
    else:
        marked = lists.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    sizes = marked.groupBy("value", "comp").count()
    sizes = sizes.groupBy("value").agg(F.count("*").alias("comps"), F.max_by("comp", F.struct("count", "comp")).alias("major"), F.sum("count").alias("length"))
    return marked.join(sizes.filter("comps > 1").select("value", "major", "length"), "value")


def cross_cost(mixed: DataFrame) -> int:
    own = mixed.groupBy("value").agg(F.count("*").alias("all"), F.count_if(F.col("comp") != F.col("major")).alias("outside"))
    return own.agg(F.sum(F.col("all").cast("double") * F.col("outside"))).first()[0] or 0


def met_in_short(mixed: DataFrame) -> DataFrame:
    """Members outside the largest component of a list with the members of other components."""
    outside = mixed.filter("comp <> major").select("value", *named_member("x"), F.col("comp").alias("cx"))
    other = mixed.select("value", *named_member("y"), F.col("comp").alias("cy"), "major")
    once = (F.col("cy") == F.col("major")) | (F.col("x_node") < F.col("y_node"))
    met = outside.join(other, "value").filter((F.col("cx") != F.col("cy")) & once & may_link())
    return met.select(F.col("x_node").alias("x"), F.col("y_node").alias("y"))


def met_in_long(mixed: DataFrame, docs: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """The same of long lists: a pair comes from the first that holds both, if few enough of the wide bits differ."""
    held = staged(mixed.groupBy("node").agg(F.collect_set("value").alias("held")), "held")
    wide = from_full_sets(held.select("node"), docs, classes, words, lambda made: [m.tobytes() for m in marks(made, WIDE)])
    known = staged(held.join(wide.withColumnRenamed("made", "wide"), "node"), "wide")
    members = mixed.select("value", "node", "n", "comp", "major", "length").join(known, "node")
    blocks = F.ceil(F.col("length") / BLOCK).cast("int")
    own, every = F.pmod(F.xxhash64("node"), blocks).cast("int"), F.explode(F.sequence(F.lit(0), blocks - 1))
    sent = [F.col(c).alias(c) for c in ("value", "node", "n", "comp", "major", "wide", "held")]
    outside = members.filter("comp <> major").select(*sent, own.alias("i"), every.alias("j"))
    other = members.select(*sent, own.alias("j"), every.alias("i"))

    def bitmaps(rows: pa.Table) -> np.ndarray:
        return np.frombuffer(b"".join(rows.column("wide").to_pylist()), np.uint64).reshape(rows.num_rows, -1)

    def meet(key: tuple[pa.Scalar, ...], x: pa.Table, y: pa.Table) -> pa.Table:
        value = key[0].as_py()
        number = lambda rows: [rows.column(c).to_numpy() for c in ("node", "n", "comp", "major")]
        before = lambda rows: [{v for v in held if v < value} for held in rows.column("held").to_pylist()]
        (xs, xn, xc, _), (ys, yn, yc, major), xw, yw, xb, yb = number(x), number(y), bitmaps(x), bitmaps(y), before(x), before(y)
        pairs: list[tuple[int, int]] = []
        for a in range(x.num_rows):
            near = (xn[a] * 100 >= yn * PERCENT) & (yn * 100 >= xn[a] * PERCENT)
            may = np.flatnonzero(near & (yc != xc[a]) & ((yc == major) | (ys > xs[a])))
            # each bit that one has alone is a value that the sets do not share
            differ = np.bitwise_count(xw[a] ^ yw[may]).sum(axis=1, dtype=np.int64)
            may = may[differ * (100 + PERCENT) <= (xn[a] + yn[may]) * (100 - PERCENT)]
            pairs += [(int(xs[a]), int(ys[b])) for b in may if xb[a].isdisjoint(yb[b])]
        return pa.table({c: pa.array([p[i] for p in pairs], pa.int64()) for i, c in enumerate("xy")})

    return outside.groupBy("value", "i", "j").cogroup(other.groupBy("value", "i", "j")).applyInArrow(meet, "x bigint, y bigint")


def cross_pairs(mixed: DataFrame, docs: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """The pairs of members of different components that some list holds, without those that cannot link."""
    met, long = met_in_short(mixed.filter(F.col("length") <= LONG)), mixed.filter(F.col("length") > LONG)
    if not long.isEmpty():
        met = met.union(met_in_long(long, docs, classes, words))
    return ordered_pairs(met)


def near_groups(docs: DataFrame, words: int = WORDS, k: int = SKETCH) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and text_hash of every document."""
    base = staged(sketches(docs, words, k), "sketches")
    classes = base.filter("n > 0").withColumn("id", F.coalesce("doc_id", F.lit(NO_ID)))
    classes = classes.groupBy("sig").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("bits").alias("bits"))
    classes = staged(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    lists = staged(prefixes(classes, k), "prefixes")
    entries = lists.count()
    edges, labels, seed, last = [], None, 0, entries == 0
    while not last:
        mixed = staged(mixed_lists(lists, labels), "mixed") if seed else lists
        if seed:
            last = seed > STAR_ROUNDS or cross_cost(mixed) <= PATIENCE * entries
        pairs = cross_pairs(mixed, docs, classes, words) if last else star_pairs(mixed, seed)
        pairs = likely(pairs, classes, k)
        pairs = staged(pairs if last else best_of_each(pairs), "pairs")
        seed += 1
        if pairs.isEmpty():
            continue
        links = staged(verified(pairs, docs, classes, words), "links").filter("linked").select("a", "b")
        if not links.isEmpty():
            edges.append(links)
            labels = components(reduce(DataFrame.union, edges))
    return with_components(base, classes, labels)


def with_components(base: DataFrame, classes: DataFrame, labels: DataFrame | None) -> DataFrame:
    known = classes.select("sig", "node", "rep")
    if labels is None:
        known = known.select("sig", F.col("rep").alias("first"))
    else:
        joined = known.join(labels, "node")
        first = staged(joined.groupBy("comp").agg(F.min("rep").alias("first")), "first-ids")
        linked = joined.join(first, "comp").select("node", "first")
        known = known.join(linked, "node", "left").select("sig", F.coalesce("first", "rep").alias("first"))
    # rows without words look for a key of their own, which nothing has, so that they don't meet in one task
    alone = F.encode(F.concat(F.lit("-"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), "UTF-8")
    rows = base.select("doc_id", "text_hash", "n", F.when(F.col("n") > 0, F.col("sig")).otherwise(alone).alias("sig"))
    rows = rows.join(staged(known, "class-components"), "sig", "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).when(F.col("first") != NO_ID, F.col("first"))
    rows = rows.withColumn("component_id", component)
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept, "text_hash")


def keep_one(docs: DataFrame, words: int = WORDS, k: int = SKETCH) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay: of each component the smallest id, and
    of rows that share it the one with the smallest hash. Rows equal in id and text stay together."""
    rows = near_groups(docs, words, k).filter("n_shingles > 0")
    one = rows.filter("kept").groupBy("component_id").agg(F.min("text_hash").alias("best"), F.count("*").alias("ties"))
    ties = one.filter("ties > 1").select(F.col("component_id").alias("_c"), "best")
    gone = rows.join(ties, F.col("component_id").eqNullSafe(F.col("_c")), "left")
    gone = gone.filter(~F.col("kept") | (F.col("text_hash") > F.col("best")))
    gone = gone.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct()
    gone = staged(gone, "near-copies")
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    listed, others = by_listed_id(docs, own, gone, "gone_id")
    return others.unionByName(listed.join(gone, (own == gone["gone_id"]) & (text_hash() == gone["gone_hash"]), "left_anti"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), words=2).drop("text_hash")
