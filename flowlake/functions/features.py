"""The flow feature contract: semantic fields, feature formulas and ordered feature sets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlake.functions.numeric import clip, is_finite, over_one, rate, ratio, to_double

# Dataset column maps (header names of the published CSV files).
US = 0.000001
CIC_2017 = {
    "duration_seconds": ("Flow Duration", US),
    "total_fwd_packets": ("Total Fwd Packets", 1.0),
    "total_bwd_packets": ("Total Backward Packets", 1.0),
    "fwd_bytes": ("Total Length of Fwd Packets", 1.0),
    "bwd_bytes": ("Total Length of Bwd Packets", 1.0),
    "pkt_len_mean": ("Packet Length Mean", 1.0),
    "pkt_len_std": ("Packet Length Std", 1.0),
    "syn_flags": ("SYN Flag Count", 1.0),
    "ack_flags": ("ACK Flag Count", 1.0),
    "rst_flags": ("RST Flag Count", 1.0),
    "fin_flags": ("FIN Flag Count", 1.0),
    "flow_iat_mean_s": ("Flow IAT Mean", US),
    "flow_iat_std_s": ("Flow IAT Std", US),
    "fwd_pkt_len_mean": ("Fwd Packet Length Mean", 1.0),
    "bwd_pkt_len_mean": ("Bwd Packet Length Mean", 1.0),
    "active_mean_s": ("Active Mean", US),
    "idle_mean_s": ("Idle Mean", US),
    "subflow_fwd_bytes": ("Subflow Fwd Bytes", 1.0),
    "subflow_bwd_bytes": ("Subflow Bwd Bytes", 1.0),
}
CSE_2018_NAMES = {
    "total_fwd_packets": "Tot Fwd Pkts",
    "total_bwd_packets": "Tot Bwd Pkts",
    "fwd_bytes": "TotLen Fwd Pkts",
    "bwd_bytes": "TotLen Bwd Pkts",
    "pkt_len_mean": "Pkt Len Mean",
    "pkt_len_std": "Pkt Len Std",
    "syn_flags": "SYN Flag Cnt",
    "ack_flags": "ACK Flag Cnt",
    "rst_flags": "RST Flag Cnt",
    "fin_flags": "FIN Flag Cnt",
    "fwd_pkt_len_mean": "Fwd Pkt Len Mean",
    "bwd_pkt_len_mean": "Bwd Pkt Len Mean",
    "subflow_fwd_bytes": "Subflow Fwd Byts",
    "subflow_bwd_bytes": "Subflow Bwd Byts",
}
CSE_2018 = {f: (CSE_2018_NAMES.get(f, c), s) for f, (c, s) in CIC_2017.items()}
UNSW = {
    "duration_seconds": ("dur", 1.0),
    "total_fwd_packets": ("spkts", 1.0),
    "total_bwd_packets": ("dpkts", 1.0),
    "fwd_bytes": ("sbytes", 1.0),
    "bwd_bytes": ("dbytes", 1.0),
}
UNSW_RATIOS = {"pkt_len_mean": (("sbytes", "dbytes"), ("spkts", "dpkts"))}
COLUMN_MAPS = {
    "cicids2017": (CIC_2017, {}),
    "cse_cic_ids2018": (CSE_2018, {}),
    "unsw_nb15": (UNSW, UNSW_RATIOS),
}

# Ordered feature sets.
R4 = ["flow_duration_ms", "flow_packets_per_s", "flow_bytes_per_s", "packet_length_mean"]
R10 = R4 + ["packet_length_std", "syn_count", "ack_count", "rst_count", "fin_count", "syn_ack_ratio"]
R15 = R10 + [
    "flow_iat_mean_ms", "flow_iat_std_ms", "down_up_ratio", "fwd_packet_length_mean",
    "bwd_packet_length_mean",
]
R20 = R15 + [
    "flow_bytes_per_packet", "active_mean_ms", "idle_mean_ms", "subflow_fwd_bytes",
    "subflow_bwd_bytes",
]
R10_SEQ = R10 + ["inter_flow_delta_s"]
FEATURE_SETS = {"R4": R4, "R10": R10, "R15": R15, "R20": R20, "R10_SEQ": R10_SEQ}


def semantic_project(
    df: DataFrame, mapping: Mapping[str, tuple[str, float]], ratios: Mapping | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Dataset columns to semantic fields. A field whose column is absent is left out, never guessed."""
    have = set(df.columns)
    cols: list[Column] = [F.col(f"`{c}`") for c in keep]
    for field, (source, scale) in mapping.items():
        if source in have:
            cols.append((to_double(F.col(f"`{source}`")) * F.lit(scale)).alias(field))
    for field, (num, den) in (ratios or {}).items():
        if have.issuperset([*num, *den]):
            top = sum((to_double(F.col(f"`{c}`")) for c in num[1:]), to_double(F.col(f"`{num[0]}`")))
            low = sum((to_double(F.col(f"`{c}`")) for c in den[1:]), to_double(F.col(f"`{den[0]}`")))
            cols.append(ratio(top, low).alias(field))
    return df.select(*cols)


def derived_totals(df: DataFrame) -> DataFrame:
    """total_packets and total_bytes; NULL if either direction is NULL."""
    return df.withColumns(
        {
            "total_packets": F.col("total_fwd_packets") + F.col("total_bwd_packets"),
            "total_bytes": F.col("fwd_bytes") + F.col("bwd_bytes"),
        }
    )


def formulas() -> dict[str, tuple[tuple[str, ...], Column]]:
    """Feature name to (semantic fields it needs, expression)."""
    c = F.col
    ms = lambda f: c(f) * 1000.0
    return {
        "flow_duration_ms": (("duration_seconds",), ms("duration_seconds")),
        "flow_packets_per_s": (
            ("total_packets", "duration_seconds"), rate(c("total_packets"), c("duration_seconds"))),
        "flow_bytes_per_s": (
            ("total_bytes", "duration_seconds"), rate(c("total_bytes"), c("duration_seconds"))),
        "packet_length_mean": (("pkt_len_mean",), c("pkt_len_mean")),
        "packet_length_std": (("pkt_len_std",), c("pkt_len_std")),
        "syn_count": (("syn_flags",), c("syn_flags")),
        "ack_count": (("ack_flags",), c("ack_flags")),
        "rst_count": (("rst_flags",), c("rst_flags")),
        "fin_count": (("fin_flags",), c("fin_flags")),
        "syn_ack_ratio": (("syn_flags", "ack_flags"), over_one(c("syn_flags"), c("ack_flags"))),
        "flow_iat_mean_ms": (("flow_iat_mean_s",), ms("flow_iat_mean_s")),
        "flow_iat_std_ms": (("flow_iat_std_s",), ms("flow_iat_std_s")),
        "down_up_ratio": (
            ("total_fwd_packets", "total_bwd_packets"),
            over_one(c("total_bwd_packets"), c("total_fwd_packets"))),
        "fwd_packet_length_mean": (("fwd_pkt_len_mean",), c("fwd_pkt_len_mean")),
        "bwd_packet_length_mean": (("bwd_pkt_len_mean",), c("bwd_pkt_len_mean")),
        "flow_bytes_per_packet": (
            ("total_bytes", "total_packets"), over_one(c("total_bytes"), c("total_packets"))),
        "active_mean_ms": (("active_mean_s",), ms("active_mean_s")),
        "idle_mean_ms": (("idle_mean_s",), ms("idle_mean_s")),
        "subflow_fwd_bytes": (("subflow_fwd_bytes",), c("subflow_fwd_bytes")),
        "subflow_bwd_bytes": (("subflow_bwd_bytes",), c("subflow_bwd_bytes")),
    }


def compute_features(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Features in contract order; a feature whose fields are missing is unavailable and left out."""
    have, book = set(df.columns), formulas()
    cols = [book[f][1].alias(f) for f in features if have.issuperset(book[f][0])]
    return df.select(*keep, *cols)


def unavailable(df: DataFrame, features: Sequence[str]) -> list[str]:
    have, book = set(df.columns), formulas()
    return [f for f in features if not have.issuperset(book[f][0])]


def flow_contract(df: DataFrame) -> DataFrame:
    """Ten-feature contract on assembled flows (duration floored at one microsecond)."""
    dur = F.greatest(F.col("duration_s"), F.lit(1e-6))
    count = lambda n: F.col(n).cast("double")
    return df.withColumns(
        {
            "flow_duration_ms": F.col("duration_s") * 1000.0,
            "flow_packets_per_s": count("packet_count") / dur,
            "flow_bytes_per_s": count("total_bytes") / dur,
            "packet_length_mean": F.col("length_mean"),
            "packet_length_std": F.col("length_std"),
            "syn_ack_ratio": over_one(F.col("syn_count"), F.col("ack_count")),
        }
    )


def sequence_contract(df: DataFrame) -> DataFrame:
    """Contract for sequences: flags clamped to {0,1}, ratio on clamped flags, delta in [0, 300],
    non-finite values replaced by 0."""
    safe = lambda n: F.when(is_finite(n), F.col(n)).otherwise(0.0)
    one = lambda n: F.least(F.col(n).cast("double"), F.lit(1.0))
    return df.select(
        *[c for c in df.columns if c not in R10_SEQ],
        *[safe(n).alias(n) for n in R4 + ["packet_length_std"]],
        *[one(n).alias(n) for n in ("syn_count", "ack_count", "rst_count", "fin_count")],
        over_one(one("syn_count"), one("ack_count")).alias("syn_ack_ratio"),
        clip(F.col("inter_flow_delta_s"), 0, 300).alias("inter_flow_delta_s"),
    )
