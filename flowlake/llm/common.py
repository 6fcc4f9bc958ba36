"""Helpers shared by the corpus operators: shared scratch tables, gapless ranks, joins on hot keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it.

    Where the setting is absent, as in local tests, a private one is made; on a cluster that would
    be wrong, so there the absence is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get(CHECKPOINT_KEY, None) or sc.getConf().get(CHECKPOINT_KEY) or sc.getCheckpointDir()
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="corpus-shared-"))
    return sc.getCheckpointDir().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


_recording = False
_recorded: list[str] = []


def staged(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    if _recording:
        _recorded.append(path)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch_of_one_stage(spark: SparkSession) -> Iterator[None]:
    """Delete what the stage before staged in this scope, and record what is staged now. For a caller
    that writes the result of each stage before it starts the next."""
    global _recording
    while _recorded:
        target = spark._jvm.org.apache.hadoop.fs.Path(_recorded.pop())
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    _recording = True
    try:
        yield
    finally:
        _recording = False


def keep_scratch() -> None:
    """Forget what was recorded: tables that a result still reads, as that of an earlier run, stay."""
    _recorded.clear()


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Arrow batches of few rows, so that a batch of the longest texts still fits a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def lower_ascii(text: Column) -> Column:
    """A-Z only; every other letter stays as it is."""
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def batch_of(columns: dict[str, Sequence | pa.Array], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for f, c in zip(schema, columns.values(), strict=True)
    ], schema=schema)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [x or "" for x in batch.column(column).to_pylist()]


def map_batches(batches: Iterator[pa.RecordBatch], work) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield work(batch)


ID_SLOTS, SLOTS_OF_BITMAP = 1 << 26, 1 << 15


def by_listed_id(rows: DataFrame, of: Column, listed: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` in two parts: those whose id ``of`` may be in ``column`` of ``listed`` and those whose id is not.

    Only the first part need meet ``listed`` in a shuffle. A bitmap of hashed ids tells them apart, of 64 slots to an
    id and ``ID_SLOTS`` (8 MB) at most, so that beyond a million ids more rows that are not listed come along.
    ``listed`` must be stable; ids are not null."""
    bitmaps = max(1, min(ID_SLOTS, listed.count() * 64) // SLOTS_OF_BITMAP)
    slot = lambda c: F.pmod(F.xxhash64(c.cast("long")), F.lit(bitmaps * SLOTS_OF_BITMAP))
    number = lambda c: F.floor(slot(c) / SLOTS_OF_BITMAP)
    place = lambda c: F.pmod(slot(c), F.lit(SLOTS_OF_BITMAP))
    ids = listed.select(F.col(column).alias("_listed_id")).distinct()
    marks = ids.groupBy(number(F.col("_listed_id")).alias("_bitmap_number")).agg(F.bitmap_construct_agg(place(F.col("_listed_id"))).alias("_bitmap"))
    marks = staged(marks, "listed-ids")
    byte = F.col("_bitmap").substr((F.floor(place(of) / 8) + 1).cast("int"), F.lit(1))
    marked = F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), F.pmod(place(of), F.lit(8)).cast("int")) == 1
    found = rows.join(F.broadcast(marks), number(of) == F.col("_bitmap_number"), "left")
    marked, own = F.coalesce(marked, F.lit(False)), [F.col(f"`{c}`") for c in rows.columns]
    return found.filter(marked).select(*own), found.filter(~marked).select(*own)


def spread_rank(
    rows: DataFrame, group: str, order: Sequence[Column | str], uid: str, out: str, least: int = 20_000, most_cells: int = 50_000
) -> DataFrame:
    """Number the rows of each group from 0 without a gap, and never a whole hot group in one task.

    A group is dealt by a hash of ``uid`` into cells of about ``max(least, total / most_cells)``
    rows; rows are ranked inside their cell along ``order`` and each cell starts where the one
    before it ends. ``rows`` must be stable (staged or checkpointed); the number of groups must be
    small. At most ``groups + most_cells`` numbers reach the driver, whatever the input.
    """
    spark = rows.sparkSession
    counts = {r[0]: r[1] for r in rows.groupBy(group).count().collect()}
    per_cell = max(least, sum(counts.values()) // most_cells)
    kind = rows.schema[group].dataType.simpleString()
    deal = spark.createDataFrame([(g, -(-n // per_cell)) for g, n in counts.items()], f"_g {kind}, _cells bigint")
    dealt = rows.join(F.broadcast(deal), F.col(group) == F.col("_g")).drop("_g")
    dealt = dealt.withColumn("_cell", F.pmod(F.xxhash64(uid), F.col("_cells"))).drop("_cells")
    cells = dealt.groupBy(group, "_cell").count().collect()
    starts, at = [], {}
    for g, c, n in sorted((tuple(r) for r in cells), key=lambda r: (str(r[0]), r[1])):
        starts.append((g, c, at.get(g, 0)))
        at[g] = at.get(g, 0) + n
    starts = spark.createDataFrame(starts, f"_g {kind}, _c bigint, _start bigint")
    w = Window.partitionBy(group, "_cell").orderBy(*order)
    ranked = dealt.withColumn("_row", F.row_number().over(w) - 1)
    joined = ranked.join(F.broadcast(starts), (F.col(group) == F.col("_g")) & (F.col("_cell") == F.col("_c")))
    return joined.withColumn(out, F.col("_start") + F.col("_row")).drop("_g", "_c", "_cell", "_start", "_row")


def ordered_rank(rows: DataFrame, group: str, order: Sequence[str], out: str, name: str = "ranked") -> DataFrame:
    """Number the rows of each group from 0 along ``order`` (``out``), and give its row count (``out_of``).

    The table is cut into ranges of (group, order), so a hot group lies in many; each range is numbered
    by itself and starts where the ranges before it end. Equal rows are told apart by their place, which
    keeps a third of the rows being equal from meeting in one range. ``rows`` must be stable and
    ``group`` not null. The result is staged by range, not in one piece; nothing reaches the driver.
    """
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.withColumn("_uid", F.monotonically_increasing_id())
    placed = staged(placed.repartitionByRange(ranges, group, *order, "_uid").withColumn("_range", F.spark_partition_id()), name)
    counts = placed.groupBy(group, "_range").agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(group)
    earlier = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumns({"_start": F.coalesce(F.sum("_n").over(earlier), F.lit(0)), f"{out}_of": F.sum("_n").over(whole)}).drop("_n")
    inside = Window.partitionBy(group, "_range").orderBy(*order, "_uid")
    numbered = placed.withColumn("_row", F.row_number().over(inside) - 1).join(counts, [group, "_range"])
    return numbered.withColumn(out, (F.col("_start") + F.col("_row")).cast("long")).drop("_uid", "_range", "_row", "_start")
