"""Operator 7: exact deduplication by deterministic block naming, in DataFrame functions only.

A normalised text is cut into blocks of fixed size. Blocks are sorted and each takes the number of the
first row with an equal one, so a block becomes an integer name and equal names mean equal blocks.
Adjacent names are then paired and the pairs are sorted and named again, level by level, until a
document has one name. Documents are equal exactly when they end on the same level with the same name; no hash
decides anything, so nothing can collide.

Copies make some blocks very frequent. Blocks (and pairs) that fill over one in ``HOT_ONE_IN`` of
the rows of their level are fewer than ``HOT_ONE_IN``; they get their names by a broadcast of that
bounded list, and all other rows by one shuffle.

Defined cases: a null text counts as empty; of equal texts the largest id stays, a null id is the
smallest and, where ids tie, one row is kept; an empty table gives an empty result; further columns
of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_listed_id, lower_ascii, staged, table, text_or_empty

BLOCK_CHARS = 4096
HOT_ONE_IN = 500
NO_ID = -(2**63)


def ref() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))


def lookup(rows: DataFrame, key: str, hot: DataFrame | None, cold: DataFrame, values: list[str]) -> DataFrame:
    """Add ``values`` by ``key``: from the broadcast ``hot`` rows, else from the shuffled ``cold`` ones.

    A row found in ``hot`` goes to the shuffle under a key of its own, so that hot keys are spread.
    """
    spread = F.col(key)
    if hot is not None:
        hot = hot.select(F.col(key).alias("_hot_key"), *[F.col(v).alias(f"_hot_{v}") for v in values])
        rows = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
        own = F.concat(F.lit("\u0001"), F.col("uid").cast("string"))
        spread = F.when(F.col("_hot_key").isNull(), F.col(key)).otherwise(own)
    rows = rows.withColumn("_join_key", spread).drop(key)
    cold = cold.select(F.col(key).alias("_cold_key"), *[F.col(v).alias(f"_cold_{v}") for v in values])
    rows = rows.join(cold, F.col("_join_key") == F.col("_cold_key"), "left")
    for v in values:
        found = F.col(f"_cold_{v}") if hot is None else F.when(F.col("_hot_key").isNull(), F.col(f"_cold_{v}")).otherwise(F.col(f"_hot_{v}"))
        rows = rows.withColumn(v, found)
    return rows.drop("_hot_key", "_join_key", "_cold_key", *[f"_{k}_{v}" for k in ("hot", "cold") for v in values])


def hot_names(rows: DataFrame, n: int, of: Callable[[list[int]], DataFrame]) -> DataFrame | None:
    """Keys with more than one in ``HOT_ONE_IN`` of the ``n`` rows, named from -1 downwards by order.

    They are counted by a hash, with one row's ``ref`` for each; ``of`` gives the rows of those few
    refs, whose keys are read in full. A key that only shares its hash with a frequent one is not
    found there and simply stays with the rest.
    """
    counts = rows.groupBy(F.xxhash64("key").alias("h")).agg(F.count("*").alias("n"), F.min("ref").alias("ref"))
    frequent = counts.filter((F.col("n") * HOT_ONE_IN > n) & (F.col("n") > 1)).collect()
    if not frequent:
        return None
    keys = of(sorted({r["ref"] for r in frequent})).filter(F.xxhash64("key").isin([r["h"] for r in frequent]))
    keys = keys.select("key").distinct().sortWithinPartitions("key")
    return staged(keys.select("key", (-1 - F.monotonically_increasing_id()).alias("name")), "hot-names")


def named(rows: DataFrame, n: int, of: Callable[[list[int]], DataFrame] | None = None) -> DataFrame:
    """Replace ``key`` by an integer ``name``, equal for equal keys: the number of the first row that has it.

    Rows are sorted by key once, with what they carry. A frequent key has its name from ``hot_names`` and goes
    to the shuffle under a key of its own, without its text."""
    hot = hot_names(rows, n, of or (lambda refs: rows.filter(F.col("ref").isin(refs))))
    rows, name = rows.withColumn("_number", F.monotonically_increasing_id()), F.min("_number").over(Window.partitionBy("key"))
    if hot is not None:
        hot = hot.select(F.col("key").alias("_hot_key"), F.col("name").alias("_hot_name"))
        rows = rows.join(F.broadcast(hot), F.col("key") == F.col("_hot_key"), "left")
        own = F.concat(F.lit("\u0001"), F.col("uid").cast("string"))
        rows = rows.withColumn("key", F.when(F.col("_hot_key").isNull(), F.col("key")).otherwise(own)).drop("_hot_key")
        name = F.coalesce("_hot_name", name)
    return rows.withColumn("name", name).drop("key", "_number", "_hot_name")


def block_rows(docs: DataFrame, text: Column, block_chars: int) -> DataFrame:
    """uid, doc_id, ref, sha (with the first block only), blocks, pos, key."""
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), ref().alias("ref"), text.alias("norm"))
    cut = F.regexp_extract_all("norm", F.lit("(?s).{1,%d}" % block_chars), F.lit(0))
    rows = rows.withColumn("cut", F.when(F.col("norm") == "", F.array(F.lit(""))).otherwise(cut))
    # posexplode_outer, as the filter that posexplode implies would cut the text a second time
    cells = F.posexplode_outer("cut").alias("pos", "key")
    rows = rows.select("uid", "doc_id", "ref", F.sha2("norm", 256).alias("sha"), F.size("cut").alias("blocks"), cells)
    return rows.withColumn("sha", F.when(F.col("pos") == 0, F.col("sha")))


def identities(docs: DataFrame, text: Column | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document: uid, doc_id, sha and ``key``, the collision-free identity of its text."""
    text = lower_ascii(text_or_empty()) if text is None else text
    length = F.greatest(F.lit(1), F.ceil(F.char_length(text_or_empty()) / block_chars))
    n = docs.agg(F.sum(length)).first()[0] or 0
    of = lambda refs: block_rows(docs.filter(ref().isin(refs)), text, block_chars)
    base = staged(named(block_rows(docs, text, block_chars), n, of).drop("ref"), "block-names")
    last = lambda level, rows: rows.select("uid", F.concat_ws(":", F.lit(level), "name").alias("key"))
    done = [last(0, base.filter("blocks = 1"))]
    rows = base.filter("blocks > 1").select("uid", "blocks", "pos", "name")
    longest = base.agg(F.max("blocks")).first()[0] or 1
    for level in range(1, (longest - 1).bit_length() + 1):
        side = lambda odd: F.max(F.when(F.col("pos") % 2 == odd, F.col("name")))
        half = F.floor(F.col("pos") / 2).cast("int").alias("pos")
        pairs = rows.groupBy("uid", F.ceil(F.col("blocks") / 2).cast("int").alias("blocks"), half).agg(side(0).alias("a"), side(1).alias("b"))
        pairs = staged(pairs.select("uid", "blocks", "pos", F.concat_ws(":", "a", F.coalesce(F.col("b").cast("string"), F.lit(""))).alias("key"), F.col("uid").alias("ref")), "pairs")
        rows = staged(named(pairs, pairs.count()), "pair-names")
        done.append(last(level, rows.filter("blocks = 1")))
        rows = rows.filter("blocks > 1")
    ends = reduce(DataFrame.unionByName, done)
    return base.filter("pos = 0").select("uid", "doc_id", "sha").join(ends, "uid")


def exact_groups(docs: DataFrame, text: Column | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and uid for every row of ``docs``."""
    rows = staged(identities(docs, text, block_chars), "identities")
    by_id = F.coalesce("doc_id", F.lit(NO_ID))
    groups = rows.groupBy("key").agg(F.max("doc_id").alias("keep_id"), F.max_by("uid", by_id).alias("keep_uid"), F.count("*").alias("group_size"))
    groups = staged(groups, "groups")
    n = rows.count()
    large = F.col("group_size") * HOT_ONE_IN > n
    found = lookup(rows, "key", groups.filter(large), groups.filter(~large), ["keep_id", "keep_uid", "group_size"])
    return found.select("doc_id", "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"), F.col("sha").alias("text_sha256"))


def keep_one(docs: DataFrame, text: Column | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay: one of each group of equal texts."""
    text = lower_ascii(text_or_empty()) if text is None else text
    rows = exact_groups(docs, text, block_chars).filter(~F.col("kept"))
    rows = staged(rows.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"), F.coalesce("keep_id", F.lit(NO_ID)).alias("_keep"), F.col("text_sha256").alias("_sha")), "copies")
    same = lambda other: (ref() == other["_id"]) & (F.sha2(text, 256) == other["_sha"])
    gone = rows.filter("_id <> _keep").select("_id", "_sha").distinct()
    listed, others = by_listed_id(docs, ref(), gone, "_id")
    left = others.unionByName(listed.join(gone, same(gone), "left_anti"))
    repeated = rows.filter("_id = _keep").select("_id", "_sha").distinct()
    if repeated.isEmpty():
        return left
    one = Window.partitionBy(ref(), F.sha2(text, 256)).orderBy(F.lit(1))
    number = "row_number_" + "_".join(left.columns)  # a name that no column has
    first = left.join(repeated, same(repeated), "left_semi").withColumn(number, F.row_number().over(one))
    first = first.filter(F.col(f"`{number}`") == 1).drop(number)
    return left.join(repeated, same(repeated), "left_anti").unionByName(first)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP7_SQL = """
with t as (
  select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as norm from documents
), g as (select norm, max(doc_id) as keep_id, count(*) as group_size from t group by norm)
select t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id as kept, sha256(t.norm) as text_sha256
from t join g on t.norm = g.norm
"""
