"""From raw documents to packed batches: five stages, each a corpus operator.

Each stage gets the rows that its predecessor kept, written as Parquet and read again. All but the
last return the columns of ``documents``. A stage starts by removing what the operators of the stages
before it had staged; ``docs`` is written by then and needs none of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake.llm import exact_dedup, near_dedup, packing, pii, quality
from flowlake.llm.common import fresh_path, keep_scratch, scratch_of_one_stage, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier (operator 9) rejects go."""
    with scratch_of_one_stage(spark):
        return quality.accepted(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (operator 7) one stays."""
    with scratch_of_one_stage(spark):
        return exact_dedup.keep_one(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (operator 4; five-word shingles, similarity 0.8) one of each group stays."""
    with scratch_of_one_stage(spark):
        return near_dedup.keep_one(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data (operator 8) gives way to its kind; ``n_chars`` follows the text."""
    with scratch_of_one_stage(spark):
        masked = pii.redact(docs)
    if "n_chars" not in docs.columns:
        return masked
    length = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text"))
    return masked.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets its place in a batch (operator 5)."""
    with scratch_of_one_stage(spark):
        return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("MinHash near-dedup", near_stage),
    ("PII", pii_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep_scratch()  # the result of an earlier run may not have been read yet
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = fresh_path(spark, f"stage-{k}")
            docs.write.option("compression", "zstd").parquet(path)
            docs = spark.read.schema(docs.schema).parquet(path)
    return docs
