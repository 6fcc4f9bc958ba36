"""Cleaning, labels, conflicts and row accounting of raw flow tables."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlake.functions.numeric import all_of, any_of, is_finite, is_inf, is_missing
from flowlake.operators.ordered import attach_row, first_per_key, spread_lookup

# Label characters replaced before normalisation, and characters stripped at the ends.
REPLACEMENTS = {"–": "-", "—": "-", "�": "-", "’": "'"}
STRIP = " \t\r\n "

# Benign labels and label-to-family map of each dataset.
BENIGN_LABELS = {
    "cicids2017": ["BENIGN"],
    "cse_cic_ids2018": ["BENIGN"],
    "unsw_nb15": ["NORMAL", "BENIGN", "0"],
}
FAMILIES = {
    "cicids2017": {
        "DOS HULK": "DoS", "DOS GOLDENEYE": "DoS", "DOS SLOWLORIS": "DoS", "DOS SLOWHTTPTEST": "DoS",
        "HEARTBLEED": "Heartbleed", "DDOS": "DDoS", "PORTSCAN": "PortScan",
        "FTP-PATATOR": "BruteForce", "SSH-PATATOR": "BruteForce",
        "WEB ATTACK - BRUTE FORCE": "Web", "WEB ATTACK - XSS": "Web",
        "WEB ATTACK - SQL INJECTION": "Web", "INFILTRATION": "Infiltration", "BOT": "Bot",
    },
    "cse_cic_ids2018": {
        "DOS ATTACKS-HULK": "DoS", "DOS ATTACKS-SLOWHTTPTEST": "DoS", "DOS ATTACKS-GOLDENEYE": "DoS",
        "DOS ATTACKS-SLOWLORIS": "DoS", "DDOS ATTACK-HOIC": "DDoS", "DDOS ATTACK-LOIC-UDP": "DDoS",
        "DDOS ATTACKS-LOIC-HTTP": "DDoS", "BRUTE FORCE -WEB": "Web", "BRUTE FORCE -XSS": "Web",
        "SQL INJECTION": "Web", "INFILTERATION": "Infiltration", "BOT": "Bot",
        "FTP-BRUTEFORCE": "BruteForce", "SSH-BRUTEFORCE": "BruteForce",
    },
    "unsw_nb15": {
        "GENERIC": "Generic", "EXPLOITS": "Exploits", "FUZZERS": "Fuzzers", "DOS": "DoS",
        "RECONNAISSANCE": "Reconnaissance", "ANALYSIS": "Analysis", "BACKDOOR": "Backdoor",
        "SHELLCODE": "Shellcode", "WORMS": "Worms",
    },
}
# Vocabularies of the strict binary label.
BENIGN_WORDS = ["0", "0.0", "0.00", "BENIGN", "NORMAL", "FALSE", "NON-ATTACK", "CLEAN", "LEGITIMATE"]
ATTACK_WORDS = ["1", "1.0", "1.00", "ATTACK", "TRUE", "MALICIOUS", "ANOMALY", "INTRUSION"]
ATTACK_NAMES = [
    "DOS HULK", "DOS GOLDENEYE", "DOS SLOWLORIS", "DOS SLOWHTTPTEST", "HEARTBLEED", "DDOS", "PORTSCAN", "FTP-PATATOR",
    "SSH-PATATOR", "WEB ATTACK - BRUTE FORCE", "WEB ATTACK - XSS", "WEB ATTACK - SQL INJECTION", "INFILTRATION", "BOT",
    "DOS ATTACKS-HULK", "DOS ATTACKS-SLOWHTTPTEST", "DOS ATTACKS-GOLDENEYE", "DOS ATTACKS-SLOWLORIS", "DDOS ATTACK-HOIC",
    "DDOS ATTACK-LOIC-UDP", "DDOS ATTACKS-LOIC-HTTP", "BRUTE FORCE -WEB", "BRUTE FORCE -XSS", "SQL INJECTION",
    "INFILTERATION", "FTP-BRUTEFORCE", "SSH-BRUTEFORCE", "GENERIC", "EXPLOITS", "FUZZERS", "DOS", "RECONNAISSANCE",
    "ANALYSIS", "BACKDOOR", "SHELLCODE", "WORMS", "PORT SCAN", "BACKDOORS",
]
ATTACK_PARTS = [
    "DDOS", "DOS ", "DOS-", "PORTSCAN", "PORT SCAN", "BRUTE FORCE", "PATATOR", "INFILTRATION",
    "INFILTERATION", "BOTNET", "BOT", "EXPLOIT", "FUZZER", "SHELLCODE", "WORM",
]


def normalize_label(label: Column) -> Column:
    """NULL to empty, replacements, strip, single spaces, upper case (compatibility forms are folded
    by ``fold_compatibility`` on the distinct labels)."""
    out = F.coalesce(label.cast("string"), F.lit(""))
    for old, new in REPLACEMENTS.items():
        out = F.replace(out, F.lit(old), F.lit(new))
    out = F.regexp_replace(F.btrim(out, F.lit(STRIP)), "[\\s ]+", " ")
    return F.upper(out)


def fold_compatibility(df: DataFrame, label: str) -> DataFrame:
    """Unicode compatibility folding (NFKC) of a label column, done once per distinct value on the
    executors and joined back; ASCII labels, nearly all of them, skip the join side."""
    @F.pandas_udf("string")
    def nfkc(s):
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))

    odd = F.col(label).rlike(r"[^\x00-\x7F]")
    table = (
        df.filter(odd).groupBy(F.col(label).alias("_raw")).agg(F.count("*").alias("_w"))
        .withColumn("_folded", nfkc("_raw"))
    )
    tagged = df.withColumn("_raw", F.when(odd, F.col(label)))
    spread = [c for c in df.columns]
    joined = spread_lookup(tagged, table, ["_raw"], "_w", spread, absent=F.col("_raw").isNull())
    return joined.withColumn(label, F.coalesce("_folded", label)).select(*df.columns)


def label_table(spark, dataset: str) -> DataFrame:
    """The label contract of a dataset as a small lookup table (fixed size)."""
    rows = [(b, "BENIGN", 0, "BENIGN") for b in BENIGN_LABELS[dataset]]
    rows += [(k, "ATTACK", 1, v) for k, v in FAMILIES[dataset].items()]
    return spark.createDataFrame(
        rows, "normalized_label string, canonical_label string, binary_label int, attack_family string"
    )


def apply_contract(df: DataFrame, label: str, dataset: str) -> DataFrame:
    """Normalized, canonical, binary and family columns; labels outside the contract are UNKNOWN / -1.
    ``label_family`` is the normalized label, ``attack_family`` the family map."""
    table = F.broadcast(label_table(df.sparkSession, dataset))
    folded = fold_compatibility(df.withColumn("_plain", F.col(label).cast("string")), "_plain")
    return (
        folded.withColumn("normalized_label", normalize_label(F.col("_plain"))).drop("_plain")
        .join(table, "normalized_label", "left")
        .withColumns({
            "canonical_label": F.coalesce("canonical_label", F.lit("UNKNOWN")),
            "binary_label": F.coalesce("binary_label", F.lit(-1)),
            "attack_family": F.coalesce("attack_family", F.lit("UNKNOWN")),
            "label_family": F.col("normalized_label"),
        })
    )


def contract_stats(labelled: DataFrame, label: str) -> DataFrame:
    """Accepted, rejected, benign, attack rows and the distinct raw labels (distinct labels are grouped
    first, so the count is over a small table)."""
    per = labelled.groupBy(label, "canonical_label").agg(F.count("*").alias("n"))
    is_ = lambda name: F.col("canonical_label") == name
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    return per.agg(
        total(~is_("UNKNOWN")).alias("accepted"), total(is_("UNKNOWN")).alias("rejected"),
        total(is_("BENIGN")).alias("benign"), total(is_("ATTACK")).alias("attack"),
        F.count_distinct(label).alias("distinct_raw_labels"),
    )


def reject_unknown(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    bad = F.col("canonical_label") == "UNKNOWN"
    return labelled.filter(~bad), labelled.filter(bad)


def rejection_summary(labelled: DataFrame, label: str, dataset: str) -> DataFrame:
    """Rejected labels with counts and share of all rows. The share is taken over per-label counts."""
    per = labelled.groupBy(label, "normalized_label", "canonical_label").agg(F.count("*").alias("row_count"))
    total = per.agg(F.sum("row_count").alias("_total"))
    return (
        attach_row(per, total).filter(F.col("canonical_label") == "UNKNOWN")
        .select(
            F.lit(dataset).alias("dataset"), F.col(label).alias("original_label"), "normalized_label", "row_count",
            F.round(100.0 * F.col("row_count") / F.col("_total"), 6).alias("percentage"),
            F.lit("label not in contract").alias("reason"),
        )
    )


def drop_negative_duration(df: DataFrame, candidates: Sequence[str]) -> DataFrame:
    """Rows with a negative duration go; undefined durations stay. The first present column counts."""
    name = next((c for c in candidates if c in df.columns), None)
    if name is None:
        return df
    d = F.col(f"`{name}`").try_cast("double")
    return df.filter(d.isNull() | F.isnan(d) | (d >= 0))


def drop_repeated_header(df: DataFrame, label: str) -> DataFrame:
    return df.filter(
        F.col(f"`{label}`").isNull() | (F.lower(F.trim(F.col(f"`{label}`"))) != label.strip().lower())
    )


def label_errors(df: DataFrame, label: str) -> DataFrame:
    """The rows whose strict label is undefined, per label text."""
    bad = df.filter(strict_binary_label(F.col(label)).isNull())
    return bad.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("rows_in_error"))


def strict_binary_label(label: Column) -> Column:
    """0, 1 or NULL for a row in error."""
    text = F.upper(F.trim(label.cast("string")))
    number = text.try_cast("double")
    part = any_of([text.contains(p) for p in ATTACK_PARTS])
    return (
        F.when(text.isNull() | (text == ""), F.lit(None).cast("int"))
        .when(number.isNotNull(), F.when(number == 0, 0).when(number == 1, 1))
        .when(text.isin(BENIGN_WORDS), 0)
        .when(text.isin(ATTACK_WORDS) | text.isin(ATTACK_NAMES) | part, 1)
    )


def finite_report(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows in, rows with a missing value, rows with an infinity (which win over missing), rows kept."""
    inf, nan = any_of([is_inf(f) for f in features]), any_of([is_missing(f) for f in features])
    return df.agg(
        F.count("*").alias("rows_in"), F.count_if(inf).alias("inf_rows"),
        F.count_if(nan & ~inf).alias("nan_rows"), F.count_if(~nan & ~inf).alias("rows_kept"),
    )


def finite_only(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.filter(all_of([is_finite(f) for f in features]))


# Columns that may never be model inputs.
PROHIBITED = [
    "src_ip", "dst_ip", "source_ip", "destination_ip", "src_port", "dst_port", "source_port",
    "destination_port", "protocol", "timestamp", "time", "label", "binary_label", "attack_cat",
    "ground_truth", "is_attack", "flow_id",
]
PROHIBITED_PATTERNS = [
    "^(flow )?id$", "timestamp", "src[_ ]?ip", "dst[_ ]?ip", "source[_ ]?ip", "destination[_ ]?ip",
    "src[_ ]?port", "dst[_ ]?port", "source[_ ]?port", "destination[_ ]?port", "attack_cat", "^label$",
]


def contract_check(df: DataFrame, features: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Columns in contract order, and one row of violation counts per feature."""
    missing = [f for f in features if f not in df.columns]
    if missing:
        raise ValueError(f"missing features: {missing}")
    aggs = [F.count_if(is_missing(f) | is_inf(f)).alias(f) for f in features]
    wide = df.agg(*aggs)
    return df.select(*features), wide.unpivot([], list(features), "feature", "violations")


def prohibited_columns(df: DataFrame) -> list[str]:
    banned = lambda c: c in PROHIBITED or any(re.search(p, c) for p in PROHIBITED_PATTERNS)
    return [c for c in df.columns if banned(c.strip().lower())]


def tag_duplicates(df: DataFrame, keys: Sequence[str], row_id: Sequence[str]) -> DataFrame:
    """Mark every member of a duplicated vector."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("_copies"))
    return (
        spread_lookup(df, counts, keys, "_copies", row_id)
        .withColumn("is_duplicate", F.col("_copies") > 1).drop("_copies")
    )


def dedup_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return first_per_key(df, keys, order)


def vector_table(df: DataFrame, features: Sequence[str], y: str, family: str | None = None) -> DataFrame:
    """One row per distinct feature vector: copies, label counts and whether labels conflict."""
    aggs = [
        F.count("*").alias("copies"), F.count_if(F.col(y) == 0).alias("n0"), F.count_if(F.col(y) == 1).alias("n1"),
    ]
    if family is not None:
        aggs.append((F.min(family) != F.max(family)).alias("family_conflict"))
    return df.groupBy(*features).agg(*aggs).withColumn("label_conflict", (F.col("n0") > 0) & (F.col("n1") > 0))


def conflict_summary(vectors: DataFrame) -> DataFrame:
    c = F.col("label_conflict")
    n = lambda cond, v: F.coalesce(F.sum(F.when(cond, v)), F.lit(0)).cast("long")
    return vectors.agg(
        F.count("*").alias("vectors"), F.count_if(F.col("copies") > 1).alias("duplicated_vectors"),
        n(F.col("copies") > 1, F.col("copies") - 1).alias("excess_rows"),
        F.count_if(c).alias("conflict_vectors"), n(c, F.col("copies")).alias("conflict_rows"),
        n(c, F.col("n0")).alias("conflict_benign_rows"), n(c, F.col("n1")).alias("conflict_attack_rows"),
        F.count_if("family_conflict").alias("family_conflict_vectors"),
    )


def conflict_examples(vectors: DataFrame, features: Sequence[str], n: int = 10) -> DataFrame:
    return vectors.filter("label_conflict").orderBy(F.desc("copies"), *features).limit(n)


def resolve_conflicts(
    df: DataFrame, vectors: DataFrame, features: Sequence[str], row_id: Sequence[str], policy: str = "reject_conflicts",
) -> DataFrame:
    """``reject_conflicts`` drops every row of a conflicting vector, ``keep_first`` drops none here."""
    if policy == "keep_first":
        return df
    table = vectors.select(*features, "copies", "label_conflict")
    return (
        spread_lookup(df, table, features, "copies", row_id)
        .filter(~F.col("label_conflict")).select(*df.columns)
    )


def conflict_members(
    df: DataFrame, vectors: DataFrame, features: Sequence[str], row_id: Sequence[str]
) -> DataFrame:
    table = vectors.select(*features, "copies", "label_conflict")
    return (
        spread_lookup(df, table, features, "copies", row_id)
        .filter("label_conflict").select(*df.columns)
    )


def bayes_ceiling(vectors: DataFrame) -> DataFrame:
    """Best accuracy any classifier can reach on the ambiguous vectors, and the error it must make."""
    n = F.sum("copies").cast("double")
    return vectors.filter("label_conflict").agg(
        F.sum("copies").alias("ambiguous_rows"),
        (F.sum(F.greatest("n0", "n1")) / n).alias("max_accuracy"),
        (F.sum(F.least("n0", "n1")) / n).alias("min_error"),
    )


def accounting(tagged: DataFrame, file: str, reason: str, reasons: Sequence[str]) -> DataFrame:
    """Per file and in total: raw rows, rows removed for each reason, final rows, and whether raw minus
    removed equals final. ``reason`` is NULL for rows that stay."""
    per = tagged.rollup(file).agg(
        F.grouping(file).cast("int").alias("is_total"), F.count("*").alias("raw_rows"),
        *[F.count_if(F.col(reason) == r).alias(r) for r in reasons],
        F.count_if(F.col(reason).isNull()).alias("final_rows"),
    )
    removed = sum((F.col(r) for r in reasons[1:]), F.col(reasons[0]))
    return per.withColumn("reconciles", F.col("raw_rows") - removed == F.col("final_rows"))


# Removal reasons in the order in which they are charged.
REASONS = ("duplicate_row", "unknown_label", "negative_duration", "non_finite", "label_conflict", "duplicate_vector")
DUPLICATE_POLICIES = ("deduplicate", "retain", "none")
CONFLICT_POLICIES = ("reject_conflicts", "keep_first")


def duplicate_policy(df: DataFrame, keys: Sequence[str], order: str, policy: str = "deduplicate") -> DataFrame:
    """``deduplicate`` keeps the first row of each vector, ``retain`` marks the copies, ``none`` does neither."""
    if policy not in DUPLICATE_POLICIES:
        raise ValueError(f"unknown duplicate policy {policy!r}; known: {', '.join(DUPLICATE_POLICIES)}")
    if policy == "deduplicate":
        return dedup_first(df, keys, [order])
    return tag_duplicates(df, keys, [order]) if policy == "retain" else df


def tag_removals(
    raw: DataFrame, dataset: str, *, columns: Sequence[str], features: Sequence[str], label: str, duration: str, order: str,
    conflicts: str = "reject_conflicts",
) -> DataFrame:
    """Label columns and ``removal_reason`` for every raw row, NULL where the row stays.

    A row is charged to the first reason of ``REASONS`` that applies; conflicts and repeated vectors are
    judged among the rows that the earlier reasons leave. ``order`` is a unique row order."""
    if conflicts not in CONFLICT_POLICIES:
        raise ValueError(f"unknown conflict policy {conflicts!r}; known: {', '.join(CONFLICT_POLICIES)}")
    firsts = raw.groupBy(*columns).agg(F.min(order).alias("_first"), F.count("*").alias("_w"))
    rows = apply_contract(spread_lookup(raw, firsts, columns, "_w", [order]).drop("_w"), label, dataset)
    d = F.col(duration).try_cast("double")
    early = (
        F.when(F.col(order) != F.col("_first"), REASONS[0]).when(F.col("canonical_label") == "UNKNOWN", REASONS[1])
        .when(d < 0, REASONS[2]).when(~all_of([is_finite(f) for f in features]), REASONS[3])
    )
    rows = rows.withColumn("removal_reason", early).drop("_first")
    left = rows.filter(F.col("removal_reason").isNull())
    both = (F.min("binary_label") != F.max("binary_label")).alias("_conflict")
    vectors = left.groupBy(*features).agg(both, F.min(order).alias("_first"), F.count("*").alias("_w"))
    if conflicts == "keep_first":
        vectors = vectors.withColumn("_conflict", F.lit(False))
    judged = spread_lookup(rows, vectors, features, "_w", [order])
    late = F.when(F.col("_conflict"), REASONS[4]).when(F.col(order) != F.col("_first"), REASONS[5])
    reason = F.when(F.col("removal_reason").isNull(), late).otherwise(F.col("removal_reason"))
    return judged.withColumn("removal_reason", reason).drop("_conflict", "_first", "_w")


def population(tagged: DataFrame) -> DataFrame:
    """The rows of ``tag_removals`` that stay."""
    return tagged.filter(F.col("removal_reason").isNull()).drop("removal_reason")


def dataset_summary(labelled: DataFrame, family: str, file: str, y: str = "y") -> DataFrame:
    """Rows, benign, attack overall, per family and per file in one pass."""
    labelled = labelled.select(F.col(family).alias("family"), F.col(file).alias("source_file"), F.col(y).alias("y"))
    return labelled.groupingSets(
        [[], [F.col("family")], [F.col("source_file")]], "family", "source_file"
    ).agg(
        F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"),
        F.count_if(F.col("y") == 0).alias("benign"), F.count_if(F.col("y") == 1).alias("attack"),
    ).withColumn("imbalance", F.col("benign").cast("double") / F.greatest(F.col("attack"), F.lit(1)))


def class_distribution(df: DataFrame, split: str, y: str = "y") -> DataFrame:
    return df.groupBy(split).agg(
        F.count("*").alias("n"), F.count_if(F.col(y) == 0).alias("benign"), F.count_if(F.col(y) == 1).alias("attack"),
        F.avg((F.col(y) == 1).cast("double")).alias("attack_fraction"),
    )


def union_populations(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
