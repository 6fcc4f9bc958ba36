"""Scans of flow CSVs, manifests, JSON samples and prediction files."""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlake.functions.numeric import all_of, is_finite
from flowlake.operators.ordered import numbered


LOT_BITS = 16  # rows numbered in one group, as a power of two


def canonical_header(name: str) -> str:
    """NFKC form with single spaces and no outer blanks; case is kept."""
    return " ".join(unicodedata.normalize("NFKC", name).split())


def _first_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows at which the file changes; the lines of a file arrive in order, one file after another."""
    last = None
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        paths = batch.column("source_path")
        starts = [i + 1 for i in pc.indices_nonzero(pc.not_equal(paths.slice(1), paths.slice(0, n - 1))).to_pylist()]
        if paths[0].as_py() != last:
            starts.insert(0, 0)
        last = paths[n - 1].as_py()
        if starts:
            yield batch.take(pa.array(starts))


def file_headers(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(source_path, header line) of each file. A task passes over its lines once and holds none of them."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    lines = spark.read.text(paths).filter(F.col("_metadata.file_block_start") == 0)
    lines = lines.select(F.col("_metadata.file_path").alias("source_path"), F.col("value").alias("header"))
    return lines.mapInArrow(_first_lines, "source_path string, header string")


def csv_flow_scan(spark: SparkSession, paths: str | Sequence[str], dataset: str) -> DataFrame:
    """Flow CSVs as text columns with canonical headers, source file, row order and dataset.

    Files are read per distinct header line, so that columns in another order or number never end up
    under a wrong name; the parts are united by name. Values stay text: cells are coerced later with
    ``try_cast``, so a bad cell never fails the scan. ``file_block`` and ``line_id`` order the lines of a
    file, see ``with_row_index``."""
    headers: dict[str, list[str]] = {}
    for row in file_headers(spark, paths).collect():  # one row per file of a dataset
        headers.setdefault(row["header"], []).append(row["source_path"])
    out = None
    for files in headers.values():
        names = spark.read.option("header", True).option("inferSchema", False).csv(files[:1]).columns
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        part = spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(files)
        seen: dict[str, int] = {}
        renamed = []
        for n in names:
            c = canonical_header(n)
            seen[c] = seen.get(c, 0) + 1
            renamed.append(c if seen[c] == 1 else f"{c}.{seen[c] - 1}")
        part = part.select(
            *[F.col(f"`{o}`").alias(n) for o, n in zip(names, renamed, strict=True)], F.lit(dataset).alias("dataset"),
            F.col("_metadata.file_path").alias("source_path"), F.col("_metadata.file_name").alias("source_file"),
            F.col("_metadata.file_block_start").alias("file_block"), F.monotonically_increasing_id().alias("line_id"),
        )
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def with_row_index(scan: DataFrame, file: Column | None = None) -> DataFrame:
    """``source_row_index`` from 0 inside each file, by its full path. The line id only orders the lines of
    one block, so the result does not depend on how blocks were packed into tasks. Where a writer has cut
    files into parts, ``file`` tells which parts are one file; they follow each other by path."""
    lot = F.shiftright("line_id", LOT_BITS)  # lines of a block go to many tasks
    if file is None:
        ranked = numbered(scan, ["source_path"], ["line_id"], F.struct("file_block", lot.alias("lot")))
    else:
        ranked = numbered(scan.withColumn("_file", file), ["_file"], ["line_id"], F.struct("source_path", "file_block", lot.alias("lot"))).drop("_file")
    return ranked.withColumn("source_row_index", F.col("rn") - 1).drop("rn", "file_block", "line_id")


def header_sets(spark: SparkSession, paths: Sequence[str], dataset: str) -> DataFrame:
    """(dataset, source_file, column_name) of each file, from its header line."""
    first = file_headers(spark, paths)
    return first.select(
        F.lit(dataset).alias("dataset"), F.col("source_path").alias("source_file"), F.explode(F.split("header", ",")).alias("column_name")
    ).withColumn("column_name", F.trim(F.regexp_replace("column_name", r"\s+", " ")))


def population_select(manifest: DataFrame, include: Sequence[str] | str = "all", exclude: Sequence[str] = (), order: str = "manifest") -> DataFrame:
    """Files of a population: ``all`` or a list, minus excludes, in manifest, given or alphabetical order.
    ``manifest`` has file_name and position."""
    spark = manifest.sparkSession
    got = manifest
    if include != "all":
        wanted = spark.createDataFrame([(n, i) for i, n in enumerate(include)], "file_name string, _given int")
        got = got.join(F.broadcast(wanted), "file_name")
    else:
        got = got.withColumn("_given", F.col("position"))
    if exclude:
        gone = spark.createDataFrame([(n,) for n in exclude], "file_name string")
        got = got.join(F.broadcast(gone), "file_name", "left_anti")
    key = {"manifest": "position", "given": "_given", "alphabetical": "file_name"}[order]
    return got.orderBy(key).drop("_given")


DIGESTS = "file_path string, sha256 string"
#: Settings under which Spark gives every file to one task, whole.
WHOLE_FILES = {"spark.sql.files.maxPartitionBytes": str(2**62), "spark.sql.files.openCostInBytes": str(2**61)}


def _digest_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the files whose lines arrive in order, one file after another."""
    path, size, total, first = None, 0, 0, True
    plain = marked = None

    def done() -> pa.RecordBatch:
        missing = size - total  # the reader takes away a byte order mark and the last line's end
        if missing not in (0, 1, 3, 4):
            raise ValueError(f"{path}: {total} of {size} bytes were read")
        found = marked if missing >= 3 else plain
        if missing in (1, 4):
            found.update(b"\n")
        return pa.RecordBatch.from_pydict({"file_path": [path], "sha256": [found.hexdigest()]})

    for batch in batches:
        names, at = batch.column("file_path"), 0
        values = batch.column("value").to_pylist()
        ends = [i for i in range(1, batch.num_rows) if names[i] != names[i - 1]] + [batch.num_rows] if batch.num_rows else []
        for end in ends:
            name = names[at].as_py()
            if name != path:
                if path is not None:
                    yield done()
                path, size, total, first = name, batch.column("file_size")[at].as_py(), 0, True
                plain, marked = hashlib.sha256(), hashlib.sha256(b"\xef\xbb\xbf")
            if batch.column("block_length")[at].as_py() != size:
                raise ValueError(f"{path}: the file was split over tasks")
            data = (b"" if first else b"\n") + b"\n".join(values[at:end])
            plain.update(data)
            marked.update(data)
            total, first, at = total + len(data), False, end
    if path is not None:
        yield done()


def file_digests(spark: SparkSession, path: str, staging: str) -> DataFrame:
    """Path, name, size and SHA-256 of every file below ``path``, of any size: a file is streamed through one task
    by Spark's own line reader, so it may lie in any store, and only a line has to fit in memory. The digests are
    written to ``staging`` under settings that keep files whole, which are put back."""
    every = spark.read.option("recursiveFileLookup", "true")
    listing = every.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file_path"), F.col("length").alias("bytes"))
    lines = every.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_size").alias("file_size"),
        F.col("_metadata.file_block_length").alias("block_length"), F.col("value").cast("binary").alias("value"))
    before = {k: spark.conf.get(k, None) for k in WHOLE_FILES}
    try:
        for k, v in WHOLE_FILES.items():
            spark.conf.set(k, v)
        lines.mapInArrow(_digest_files, DIGESTS).write.parquet(staging)
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    found = listing.join(spark.read.schema(DIGESTS).parquet(staging), "file_path", "left")
    # a scan leaves out files without a byte; their names are known from the listing that every scan begins with
    plain = lambda c: F.regexp_replace(c, "^[a-z]+:/+", "/")
    named = spark.createDataFrame([(f,) for f in lines.inputFiles()], "file_path string")
    empty = named.join(listing.select(plain("file_path").alias("_p")), plain("file_path") == F.col("_p"), "left_anti")
    empty = empty.select("file_path", F.lit(0).cast("long").alias("bytes"), F.sha2(F.lit("").cast("binary"), 256).alias("sha256"))
    return found.unionByName(empty).select("file_path", F.element_at(F.split("file_path", "/"), -1).alias("file_name"), "bytes", "sha256")


def manifest_verify(expected: DataFrame, present: DataFrame) -> DataFrame:
    """Full outer join of registered and present files. ``expected``: dataset, file_name, sha256."""
    e = expected.select("dataset", "file_name", F.col("sha256").alias("expected_sha256"), F.lit(True).alias("_e"))
    p = present.select("file_name", F.col("sha256").alias("actual_sha256"), F.lit(True).alias("_p"))
    status = (
        F.when(F.col("_e").isNull(), "unregistered").when(F.col("_p").isNull(), "missing")
        .when(F.col("expected_sha256").isNull(), "unverifiable")
        .when(F.col("expected_sha256") == F.col("actual_sha256"), "verified").otherwise("mismatch")
    )
    return e.join(p, "file_name", "full").select("dataset", "file_name", "expected_sha256", "actual_sha256", status.alias("status"))


def manifest_overall(verified: DataFrame) -> DataFrame:
    """One verdict per dataset: the worst of its files; unregistered files do not count."""
    worst = F.min(F.when(F.col("status") == "missing", 0).when(F.col("status") == "mismatch", 1).when(F.col("status") == "unverifiable", 2).otherwise(3))
    names = F.element_at(F.array(*[F.lit(x) for x in ("missing", "mismatch", "unverifiable", "verified")]), F.col("_w") + 1)
    return verified.filter("status <> 'unregistered'").groupBy("dataset").agg(worst.alias("_w")).select("dataset", names.alias("overall"))


def manifest_counts(verified: DataFrame) -> DataFrame:
    return verified.groupBy(F.coalesce("dataset", F.lit("(none)")).alias("dataset"), "status").agg(F.count("*").alias("files"))


FLOW_SAMPLE = "category string, flows array<struct<flow_id:string,label:string,features:map<string,double>>>"


def json_flow_samples(spark: SparkSession, path: str, categories: Sequence[str] | None = None) -> DataFrame:
    """JSON documents of sample flows by category, one row per flow."""
    docs = spark.read.schema(FLOW_SAMPLE).json(path)
    if categories is not None:
        docs = docs.filter(F.col("category").isin(list(categories)))
    return docs.select("category", F.explode("flows").alias("f")).select("category", "f.*")


def predictions_scan(spark: SparkSession, path: str, columns: Sequence[str], scores: Sequence[str]) -> DataFrame:
    """Only the needed columns of a prediction table; rows with a non-finite score are dropped."""
    return spark.read.parquet(path).select(*columns).filter(all_of([is_finite(s) for s in scores]))
