"""Operator 12: a Merkle manifest of a table, with a proof for every row by pointer jumping.

Every row is a leaf. The leaves of a language, in the order of their ids, are hashed in runs of eight,
level by level, to a subroot, and the subroots of all languages in the same way to the root.

A node starts with a pointer to its parent and one path segment: the siblings to its left and to its
right. A self-join on the pointer then lets it jump: its ancestor's segments are appended to its own and
its pointer becomes its ancestor's. Each join doubles the distance, so trees of depth d are climbed
in log2(d) joins, whatever the number of leaves.

An ancestor at distance d serves up to 8^d leaves. It is copied ``8^(d-1)`` times (``MOST_COPIES`` at most) under
salts that its descendants share by position, so about eight leaves meet one copy: the copies are an
eighth of the leaves however far the jump goes, and no key is hot.

Fields are written as ``-`` when null, else their length in UTF-8 bytes, a colon and the value, so
two different rows never spell the same. Everything is DataFrame functions.

Defined cases: equal ids are ordered by their digests, and rows equal in all fields are leaves of their own; a null id
comes first and is never tampered with in the query; a null language is a tree of its own and its
subroot comes first; a table with one leaf has that leaf as its root, with an empty path; an empty
table gives an empty result; empty and very long texts are hashed whole; further columns are ignored
whatever their names, but for those named in ``keep``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from math import ceil, log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, ordered_rank, staged, table

FANOUT = 8
MOST_COPIES = 512
HEX = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SUBROOT = -1  # level of the node that stands for a whole tree
TOP = ""  # the tree over all subroots; the key of a language is never empty
SEGMENT = "struct<left:binary,right:binary,top:boolean>"


def spelled(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(**changed: Column) -> Column:
    """The leaf's digest in hex; ``changed`` gives other values for some fields."""
    return F.sha2(F.concat(*[spelled(changed.get(f, F.col(f))) for f in FIELDS]), 256)


def hexed(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def folded(leaf: Column, path: Column) -> Column:
    """The digest in hex that a leaf (in hex) and its path lead to."""
    return F.aggregate(path, leaf, lambda at, s: F.sha2(F.concat(hexed(s["left"]), at, hexed(s["right"])), 256))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.concat_ws("", F.transform(path, lambda s: F.concat(hexed(s["left"]), hexed(s["right"])))), 256)


def parents(size: int) -> int:
    return -(-size // FANOUT)


def segment(i: Column, siblings: Column, top: bool) -> Column:
    """The digests before and after place ``i`` of a run, whose digests ``siblings`` has in hex, one after another."""
    left = F.unhex(F.substring(siblings, F.lit(1), i * HEX))
    right = F.unhex(F.substring(siblings, (i + 1) * HEX + 1, F.length(siblings)))
    return F.struct(left.alias("left"), right.alias("right"), F.lit(top).alias("top"))


def runs_of(nodes: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """tree, run, size, members (place, digest, carried) and their digests in hex, of runs of eight nodes."""
    member = F.struct((F.col("pos") % FANOUT).cast("int").alias("place"), "digest", *carried)
    runs = nodes.groupBy("tree", F.expr(f"pos div {FANOUT}").alias("run")).agg(F.max("size").alias("size"), F.sort_array(F.collect_list(member)).alias("members"))
    return runs.withColumn("siblings", F.concat_ws("", F.transform("members", lambda m: hexed(m["digest"]))))


def hashed(runs: DataFrame) -> DataFrame:
    """The nodes one level up, of the trees that have more than one node below."""
    return runs.where("size > 1").select(
        "tree", F.col("run").alias("pos"), F.expr(f"(size + {FANOUT - 1}) div {FANOUT}").alias("size"), F.unhex(F.sha2("siblings", 256)).alias("digest")
    )


def climb(runs: DataFrame, level: int, top: bool, carried: Sequence[str] = ()) -> DataFrame:
    """One row per member of the runs: its pointer to its parent and its first segment.

    The parent of the last run of a tree is the tree's ``SUBROOT``. So is a leaf that is alone; nodes above that
    are alone have that name already and get no row."""
    rows = (runs.where("size > 1") if level else runs).select("tree", "run", "size", "siblings", F.explode("members").alias("m"))
    alone = F.col("size") == 1
    last = F.col("size") <= FANOUT
    return rows.select(
        "tree", F.lit(level).alias("level"), (F.col("run") * FANOUT + F.col("m.place")).alias("pos"),
        F.col("tree").alias("at_tree"), F.when(last, F.lit(SUBROOT)).otherwise(F.lit(level + 1)).alias("at_level"),
        F.when(last, F.lit(0)).otherwise(F.col("run")).cast("long").alias("at_pos"),
        F.when(alone, F.array().cast(f"array<{SEGMENT}>")).otherwise(F.array(segment(F.col("m.place"), F.col("siblings"), top))).alias("path"),
        "m.digest", *[F.col(f"m.{c}") for c in carried],
    )


def grow(leaves: DataFrame, most: int, top: bool, carried: Sequence[str] = ()) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """The climbing rows of the leaves and of each level above, and the subroots (tree, digest)."""
    nodes, level, climbing, tops = leaves, 0, [], []
    while True:
        runs = staged(runs_of(nodes, carried if level == 0 else ()), f"merkle-{'top' if top else 'runs'}-{level}")
        tops.append(runs.where("size = 1").select("tree", F.col("members")[0]["digest"].alias("digest")))
        climbing.append(climb(runs, level, top, carried if level == 0 else ()))
        if most == 1:
            break
        nodes, level, most = hashed(runs), level + 1, parents(most)
    above = [c.drop("digest") for c in climbing[1:-1]]  # the last level has nothing but subroots
    return climbing[0], above, reduce(DataFrame.unionByName, tops)


@dataclass
class Manifest:
    """``proofs``: doc_id, lang, leaf (hex), path (segments from the leaf to the root) and the kept columns;
    ``subroots``: tree (``-`` or ``=`` and the language), digest; ``root``: hex, None of an empty table."""

    proofs: DataFrame
    subroots: DataFrame
    root: str | None


def jump(rows: DataFrame, ancestors: DataFrame, distance: int) -> DataFrame:
    """Let every row jump from its pointer to its ancestor's, appending the ancestor's path. The copies are
    shuffled: Spark estimates their size before they are made, which is no bound for a broadcast."""
    copies = min(FANOUT ** (distance - 1), MOST_COPIES)
    ancestors = ancestors.select(
        F.col("tree").alias("at_tree"), F.col("level").alias("at_level"), F.col("pos").alias("at_pos"),
        F.col("at_tree").alias("_tree"), F.col("at_level").alias("_level"), F.col("at_pos").alias("_pos"), F.col("path").alias("_path"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long"))).alias("_salt"),
    )
    rows = rows.withColumn("_salt", F.pmod(F.expr(f"pos div {FANOUT}"), F.lit(copies)))
    met = rows.join(ancestors.hint("merge"), ["at_tree", "at_level", "at_pos", "_salt"], "left")
    moved = {f"at_{c}": F.coalesce(f"_{c}", f"at_{c}") for c in ("tree", "level", "pos")}
    met = met.withColumn("path", F.when(F.col("_path").isNull(), F.col("path")).otherwise(F.concat("path", "_path"))).withColumns(moved)
    return met.select(*[c for c in rows.columns if c != "_salt"])


def manifest(rows: DataFrame, keep: Sequence[str] = ()) -> Manifest:
    """The manifest of ``rows`` (the fields of a document); ``keep`` names further columns that stay with the proofs."""
    spark = rows.sparkSession
    kept = [f"_keep_{c}" for c in keep]
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("-"))
    leaves = rows.select(
        tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), F.unhex(leaf_of()).alias("digest"), *[F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)]
    )
    leaves = ordered_rank(staged(leaves, "merkle-leaves"), "tree", ["doc_id", "digest"], "pos", "merkle-ranges").withColumnRenamed("pos_of", "size")
    leaves = staged(leaves, "merkle-order")
    most = leaves.agg(F.max("size")).first()[0]
    columns = ["doc_id", F.when(F.col("tree") != "-", F.substring("tree", 2, 1 << 30)).alias("lang"), hexed(F.col("digest")).alias("leaf"), "path",
               *[F.col(k).alias(c) for c, k in zip(keep, kept, strict=True)]]
    if most is None:
        nothing = leaves.withColumn("path", F.array().cast(f"array<{SEGMENT}>"))
        return Manifest(nothing.select(columns), leaves.select("tree", "digest"), None)
    first, above, subroots = grow(leaves, most, False, ["doc_id", *kept])
    subroots = staged(subroots, "merkle-subroots")
    named = ordered_rank(subroots.withColumn("top", F.lit("top")), "top", ["tree"], "pos", "merkle-languages").withColumnRenamed("pos_of", "size")
    named = staged(named.select(F.lit(TOP).alias("tree"), F.col("tree").alias("member"), "pos", "size", "digest"), "merkle-trees")
    trees = named.first()["size"]
    top_leaves, top_above, root = grow(named, trees, True, ["member"])
    if trees > 1:
        entry = top_leaves.select(F.col("member").alias("tree"), F.lit(SUBROOT).alias("level"), F.lit(0).cast("long").alias("pos"), "at_tree", "at_level", "at_pos", "path")
        above = [*above, entry, *top_above]
    depth = max(levels(most) + levels(trees), levels(trees) + 1)  # a leaf that is alone starts a step behind
    if above:
        inner = staged(reduce(DataFrame.unionByName, above), "merkle-inner-1")
        shared = (F.col("level") == SUBROOT) | (F.col("tree") == TOP)
        for k in range(ceil(log2(depth))):
            distance = 2**k
            first = jump(first, inner.where(shared | (F.col("level") == distance)), distance)
            if 2 * distance < depth:
                inner = staged(jump(inner.where(shared | (F.col("level") >= 2 * distance)), inner, distance), f"merkle-inner-{2 * distance}")
    return Manifest(first.select(columns), subroots, root.first()["digest"].hex())


def levels(size: int) -> int:
    n = 0
    while size > 1:
        size, n = parents(size), n + 1
    return n


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    tampered = F.unhex(leaf_of(text=F.when(chosen, lower_ascii(F.col("text"))).otherwise(F.col("text"))))
    docs = docs.select(*FIELDS).withColumn("now", tampered)
    found = manifest(docs, ["now"])
    path = F.col("path")
    rows = found.proofs.select(
        "doc_id", "leaf", folded(F.col("leaf"), F.filter(path, lambda s: ~s["top"])).alias("subroot"), F.lit(found.root).alias("root"),
        proof_digest(path).alias("proof_sha256"), folded(hexed(F.col("now")), path).alias("folded_root"),
    )
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


_SQL_TREE_LEVELS, _SQL_TOP_LEVELS = 8, 4  # enough for 8^8 rows of a language and 8^4 languages
_SQL_STEPS = ", ".join(["-1"] * 8)


def _sql_level(name: str, k: int) -> str:
    """Runs of level k, and every node with its run; a tree of one node passes on unchanged."""
    return f"""
{name}r{k} as (select tree, pos // {FANOUT} as run, max(size) as size, list(h order by pos) as hs from {name}{k} group by all),
{name}{k + 1} as (select tree, run as pos, case when size > 1 then (size + {FANOUT - 1}) // {FANOUT} else 1 end as size,
                  case when size > 1 then sha256(array_to_string(hs, '')) else hs[1] end as h from {name}r{k}),"""


def _sql_climb(source: str, name: str, k: int, values: str) -> str:
    """Fold leaf, mine and the proof of every row by one level."""
    left, right = f"array_to_string(hs[1:p % {FANOUT}], '')", f"array_to_string(hs[p % {FANOUT} + 2:], '')"
    fold = ", ".join(f"case when size > 1 then sha256({left} || {v} || {right}) else {v} end as {v}" for v in values.split())
    return f"""(select c.* exclude ({values.replace(" ", ", ")}, p, proof), p // {FANOUT} as p, {fold}, proof || case when size > 1 then {left} || {right} else '' end as proof
 from {source} c join {name}r{k} r on r.tree = c.{"tree" if name == "n" else "top"} and r.run = c.p // {FANOUT})"""


def _sql_spelled(value: str) -> str:
    return f"case when {value} is null then '-' else strlen(cast({value} as varchar)) || ':' || {value} end"


def _sql_leaf(text: str) -> str:
    return "sha256(" + " || ".join(_sql_spelled(text if f == "text" else f) for f in FIELDS) + ")"


def _sql() -> str:
    bits = f"flatten(list_transform(string_split(cast(doc_id as varchar), ''), lambda c: [ord(c), {_SQL_STEPS}]))"
    crc = f"xor(list_reduce({bits}, lambda a, x: case when x >= 0 then xor(a, x) else xor(a >> 1, 3988292384 * (a & 1)) end, 4294967295::bigint), 4294967295::bigint)"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    trees = "".join(_sql_level("n", k) for k in range(_SQL_TREE_LEVELS))
    tops = "".join(_sql_level("t", k) for k in range(_SQL_TOP_LEVELS))
    climb = "c0"
    for k in range(_SQL_TREE_LEVELS):
        climb = _sql_climb(climb, "n", k, "whole mine")
    over = "c1"
    for k in range(_SQL_TOP_LEVELS):
        over = _sql_climb(over, "t", k, "whole mine")
    return f"""
with leaves as (select *, coalesce('=' || lang, '-') as tree, {_sql_leaf("text")} as leaf, {_sql_leaf(f"case when coalesce({crc} % 3 = 0, false) then {lowered} else text end")} as mine from documents),
placed as (select doc_id, tree, leaf, mine, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by tree) as size from leaves),
n0 as (select tree, pos, size, leaf as h from placed),{trees}
t0 as (select '' as tree, row_number() over (order by tree) - 1 as pos, count(*) over () as size, h, tree as member from n{_SQL_TREE_LEVELS}),{tops}
c0 as (select doc_id, tree, leaf, leaf as whole, mine, pos as p, '' as proof from placed),
c1 as (select c.* exclude (p), c.whole as subroot, '' as top, t.pos as p from {climb} c join t0 t on t.member = c.tree)
select doc_id, leaf, subroot, whole as root, sha256(proof) as proof_sha256, mine as folded_root, mine = whole as verified from {over}
"""


OP12_SQL = _sql()
