"""Operator 11: quality rules with adaptive thresholds, in DataFrame functions only.

Every text gets a few counts in one pass without a shuffle. From them come four integer measures:
word length (thousandths of a character), and the shares of symbols, of repeated lines and of words
in repeated three-word windows (ten-thousandths). Instead of fixed cutoffs, each language and source
has its own fences, taken from quantile sketches.

A sketch is a table of (lang, source, measure, bucket, n). Buckets are the integers below 256 and, beyond,
128 equal steps between one power of two and the next, so a quantile is off by less than one part in 128
whatever the distribution, and a sketch has at most ``MOST_BUCKETS`` rows per group and measure.
Sketches of parts add up to the sketch of the whole (``merge``); the sketch of a language or of everything
is the sum over its sources. Everything is integer arithmetic, so the order of merging never shows.

The quartiles of a group of n documents are drawn towards those of its language with the weight
``PRIOR`` : n, and these towards the quartiles of all documents in the same way. This one formula
holds at every size. A document fails a rule beyond ``REACH`` spreads from the quartile, the spread
being the distance of the quartiles and at least ``LEAST_SPREAD`` of the measure.

A window is found in two steps that keep the result exact: windows are sorted by a hash next to their
position, and those with equal hashes are sorted by their words.

Defined cases: a null text has no words, all counts are 0 and it fails the base rule; so does an empty
one. Texts without words enter no sketch. Null languages and sources form groups of their own. Tied and
repeated rows, and equal or null ids, are rows like any others. An empty table gives an empty result.
Further columns are ignored, whatever their names. A text of any length is taken whole; while a task
has it in hand it takes about 20 bytes of memory per byte (every word and window is an array element).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table, text_or_empty

LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50
PRIOR, REACH = 200, 5
#: smallest spread of each measure, in its own unit, and whether low values fail too
LEAST_SPREAD = {"word_length": (200, True), "symbol_share": (100, False), "dup_line_share": (1000, False), "repeat_share": (800, False)}
MOST_BUCKETS = 256 + 128 * 55
SALTS = 16
WHITE, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
POSITION_BITS = 30  # a text has fewer than 2^31 bytes, so fewer than 2^30 words
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def like_neighbour(items: Column, key) -> Column:
    """Those items of a sorted array whose ``key`` is that of the item before or after."""
    return F.filter(items, lambda x, k: (key(F.get(items, k - 1)) == key(x)) | (key(F.get(items, k + 1)) == key(x)))


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the counts of the contract and ``n_lines`` (lines that have a word)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
                       F.col("source").cast("string").alias("source"), text_or_empty().alias("_text"))
    text, words = F.col("_text"), F.col("_words")
    rows = rows.select(
        "doc_id", "lang", "source",
        F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "").alias("_words"),
        F.filter(F.split(text, "\n"), lambda x: F.length(without(x, WHITE)) > 0).alias("_lines"),
        F.char_length(without(text, WHITE)).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(without(text, SYMBOLS))).cast("long").alias("n_symbols"),
    )
    n_words = F.size(words)
    window = lambda i: F.xxhash64(F.get(words, i - 1), F.get(words, i), F.get(words, i + 1))
    mask = (1 << (63 - POSITION_BITS)) - 1
    packed = F.transform(
        F.sequence(F.lit(1), F.greatest(n_words - 2, F.lit(1))),
        lambda i: F.shiftleft(window(i).bitwiseAND(mask), POSITION_BITS).bitwiseOR(i.cast("long")),
    )
    rows = rows.select(
        "doc_id", "lang", "source", n_words.cast("long").alias("n_words"), "word_chars", "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), F.size("_lines").cast("long").alias("n_lines"),
        "_words", F.when(n_words > 3, F.sort_array(packed)).alias("_packed"),
    )
    maybe = like_neighbour(F.col("_packed"), lambda x: F.shiftright(x, POSITION_BITS))
    place = lambda x: x.bitwiseAND((1 << POSITION_BITS) - 1).cast("int")
    spelled = lambda p: F.struct(F.get(words, p - 1).alias("a"), F.get(words, p).alias("b"), F.get(words, p + 1).alias("c"), p.alias("p"))
    counted = ["doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines"]
    rows = rows.select(*counted, "_words", F.transform(maybe, place).alias("_maybe"))
    rows = rows.select(*counted, F.when(F.size("_maybe") > 0, F.sort_array(F.transform("_maybe", spelled))).alias("_windows"))
    repeated = like_neighbour(F.col("_windows"), lambda x: F.struct(x["a"], x["b"], x["c"]))
    rows = rows.select(*counted, F.sort_array(F.transform(repeated, lambda x: x["p"])).alias("_at"))
    at = F.col("_at")
    covered = F.transform(at, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - p, F.lit(3))))
    total = F.coalesce(F.aggregate(covered, F.lit(0).cast("long"), lambda s, x: s + x), F.lit(0).cast("long"))
    return rows.select(*counted, total.alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))


def whole_part(a: str, scale: int, b: str) -> str:
    return f"case when {b} > 0 then ({a} * {scale}L) div {b} else 0L end"


def with_measures(counted: DataFrame) -> DataFrame:
    return counted.withColumns({
        "word_length": F.expr(whole_part("word_chars", 1000, "n_words")),
        "symbol_share": F.expr(whole_part("n_symbols", 10_000, "word_chars")),
        "dup_line_share": F.expr(whole_part("n_dup_lines", 10_000, "n_lines")),
        "repeat_share": F.expr(whole_part("n_repeat_words", 10_000, "n_words")),
    })


def bucket(value: Column) -> Column:
    """The value with all but its eight leading binary digits set to zero: the lower end of its bucket."""
    low = F.greatest(F.length(F.bin(value)) - 8, F.lit(0))
    power = F.call_function("shiftleft", F.lit(1).cast("long"), low)
    return value - F.pmod(value, power)


def sketch(measured: DataFrame) -> DataFrame:
    """lang, source, measure, bucket, n of all documents with a word."""
    pairs = [F.struct(F.lit(m).alias("measure"), bucket(F.col(m)).alias("bucket")) for m in LEAST_SPREAD]
    rows = measured.where("n_words > 0").select("lang", "source", F.explode(F.array(*pairs)).alias("x"))
    return rows.groupBy("lang", "source", "x.measure", "x.bucket").agg(F.count("*").alias("n"))


def merge(*sketches: DataFrame) -> DataFrame:
    """The sketch of all documents that any of the sketches has seen."""
    whole = reduce(DataFrame.unionByName, sketches)
    return whole.groupBy("lang", "source", "measure", "bucket").agg(F.sum("n").alias("n"))


def quartiles(of: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, measure, docs, low, high: lower ends of the buckets that hold the first and third quartile."""
    summed = of.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "measure")
    upto = group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = summed.withColumns({"upto": F.sum("n").over(upto), "docs": F.sum("n").over(group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    at = lambda part: F.min(F.when(4 * F.col("upto") >= part * F.col("docs"), F.col("bucket")))
    return ranked.groupBy(*keys, "measure").agg(F.max("docs").alias("docs"), at(1).alias("low"), at(3).alias("high"))


def drawn(own: DataFrame, wider: DataFrame, keys: list[str]) -> DataFrame:
    """Quartiles of ``own`` drawn towards those of the ``wider`` group that shares ``keys`` and measure."""
    o, w = own.alias("o"), wider.alias("w")
    same = reduce(lambda a, b: a & b, [F.col(f"o.{k}").eqNullSafe(F.col(f"w.{k}")) for k in [*keys, "measure"]])
    shrunk = [F.expr(f"(o.docs * o.{q} + {PRIOR}L * w.{q}) div (o.docs + {PRIOR}L)").alias(q) for q in ("low", "high")]
    return o.join(w, same).select(*[F.col(f"o.{c}").alias(c) for c in own.columns if c not in ("low", "high")], *shrunk)


def fences(of: DataFrame) -> DataFrame:
    """One row per lang and source: the ends ``<measure>_low`` and ``<measure>_high`` of what passes."""
    of = staged(of, "quality-sketch")
    everything = quartiles(of, [])
    languages = drawn(quartiles(of, ["lang"]), everything, [])
    groups = drawn(quartiles(of, ["lang", "source"]), languages, ["lang"])
    least = F.create_map(*[F.lit(x) for m, (s, _) in LEAST_SPREAD.items() for x in (m, s)])
    reach = REACH * F.greatest(F.col("high") - F.col("low"), least[F.col("measure")].cast("long"))
    groups = groups.withColumn("_reach", reach)
    ends = []
    for m, (_, both) in LEAST_SPREAD.items():
        mine = F.col("measure") == m
        ends.append(F.max(F.when(mine, F.col("low") - F.col("_reach") if both else F.lit(0).cast("long"))).alias(f"{m}_low"))
        ends.append(F.max(F.when(mine, F.col("high") + F.col("_reach"))).alias(f"{m}_high"))
    return groups.groupBy("lang", "source").agg(*ends)


def judge(docs: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """doc_id, lang, source, counts, base_failed, reasons (names of failed rules) and kept.

    ``seen`` is a sketch of documents judged before; it is merged with that of ``docs``.
    """
    measured = staged(with_measures(measure(docs)), "quality-counts")
    own = sketch(measured)
    ends = fences(own if seen is None else merge(own, seen))
    salted = measured.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars", "n_symbols"), F.lit(SALTS)))
    ends = ends.withColumn("_end_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    ends = ends.withColumnRenamed("lang", "_lang").withColumnRenamed("source", "_source")
    mine = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("_salt") == F.col("_end_salt"))
    found = salted.join(ends, mine, "left")
    failed = F.concat_ws(",", F.when(base_failed(), F.lit("base")), *[
        F.when((F.col("n_words") > 0) & ((F.col(m) < F.col(f"{m}_low")) | (F.col(m) > F.col(f"{m}_high"))), F.lit(m)) for m in LEAST_SPREAD
    ])
    return found.select("doc_id", "lang", "source", *COUNTS, base_failed().alias("base_failed"), failed.alias("reasons"), (failed == "").alias("kept"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select("doc_id", *COUNTS, "base_failed", "kept", "reasons")


_SQL_MEASURES = {
    "word_length": ("word_chars", 1000, "n_words"), "symbol_share": ("n_symbols", 10_000, "word_chars"),
    "dup_line_share": ("n_dup_lines", 10_000, "n_lines"), "repeat_share": ("n_repeat_words", 10_000, "n_words"),
}
_SQL_PAIRS = ", ".join(f"{{'measure': '{m}', 'bucket': {m} - {m} % (1::bigint << greatest(length(bin({m})) - 8, 0))}}" for m in LEAST_SPREAD)


def _sql_quartiles(keys: str) -> str:
    by = f"{keys}, " if keys else ""
    return f"""select {by}measure, max(docs) docs, min(bucket) filter (4 * upto >= docs) low, min(bucket) filter (4 * upto >= 3 * docs) high
    from (select {by}measure, bucket, sum(n) over (partition by {by}measure order by bucket) upto, sum(n) over (partition by {by}measure) docs
          from (select {by}measure, bucket, sum(n) n from sketch group by all)) group by {by}measure"""


_SQL_DRAWN = ", ".join(f"cast((o.docs * o.{q} + {PRIOR} * w.{q}) // (o.docs + {PRIOR}) as bigint) {q}" for q in ("low", "high"))
_SQL_SPREAD = "case measure " + " ".join(f"when '{m}' then {s}" for m, (s, _) in LEAST_SPREAD.items()) + " end"
_SQL_ENDS = ", ".join(
    f"max(low - reach) filter (measure = '{m}') {m}_low, max(high + reach) filter (measure = '{m}') {m}_high" if both
    else f"0 {m}_low, max(high + reach) filter (measure = '{m}') {m}_high" for m, (_, both) in LEAST_SPREAD.items()
)
_SQL_REASONS = ", ".join(f"case when n_words > 0 and ({m} < {m}_low or {m} > {m}_high) then '{m}' end" for m in LEAST_SPREAD)
OP11_SQL = rf"""
with docs as (select row_number() over () as rid, doc_id, lang, source, coalesce(text, '') as t from documents),
words as (select rid, generate_subscripts(w, 1) as p, unnest(w) as word from (select rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w from docs)),
triples as (select rid, p, word as a, lead(word) over o as b, lead(word, 2) over o as c from words window o as (partition by rid order by p)),
twice as (select rid, p from (select rid, p, count(*) over (partition by rid, a, b, c) as k from triples where c is not null) where k > 1),
covered as (select rid, count(distinct p + d) as n_repeat_words from twice, (select unnest([0, 1, 2]) as d) group by rid),
totals as (select rid, count(*) as n_words, sum(length(word)) as word_chars, sum(length(regexp_replace(word, '[^#*$%&|<>]', '', 'g'))) as n_symbols from words group by rid),
lines as (select rid, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines
          from (select rid, unnest(string_split(t, chr(10))) as line from docs) where regexp_matches(line, '[^\x20\x09-\x0D]') group by rid),
counted as (select d.rid, doc_id, lang, source, cast(coalesce(n_words, 0) as bigint) n_words, cast(coalesce(word_chars, 0) as bigint) word_chars,
                   cast(coalesce(n_symbols, 0) as bigint) n_symbols, cast(coalesce(n_dup_lines, 0) as bigint) n_dup_lines,
                   cast(coalesce(n_repeat_words, 0) as bigint) n_repeat_words, cast(coalesce(n_lines, 0) as bigint) n_lines
            from docs d left join totals using (rid) left join covered using (rid) left join lines using (rid)),
measured as (select *, {", ".join(f"case when {b} > 0 then {a} * {s} // {b} else 0 end as {m}" for m, (a, s, b) in _SQL_MEASURES.items())} from counted),
sketch as (select lang, source, x.measure as measure, x.bucket as bucket, count(*) as n
           from (select lang, source, unnest([{_SQL_PAIRS}]) as x from measured where n_words > 0) group by all),
everything as ({_sql_quartiles("")}),
languages as (select o.lang, o.measure, o.docs, {_SQL_DRAWN} from ({_sql_quartiles("lang")}) o join everything w on o.measure = w.measure),
groups as (select o.lang, o.source, o.measure, o.docs, {_SQL_DRAWN}
           from ({_sql_quartiles("lang, source")}) o join languages w on o.measure = w.measure and o.lang is not distinct from w.lang),
ends as (select lang, source, {_SQL_ENDS} from (select *, {REACH} * greatest(high - low, {_SQL_SPREAD}) as reach from groups) group by lang, source),
judged as (select m.*, n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words as base_failed, e.* exclude (lang, source)
           from measured m left join ends e on m.lang is not distinct from e.lang and m.source is not distinct from e.source),
said as (select *, concat_ws(',', case when base_failed then 'base' end, {_SQL_REASONS}) as reasons from judged)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, reasons = '' as kept, reasons from said
"""
