"""Detection rules over flow rows, the hybrid verdict and alert rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rule ids, names and severities.
INVALID_FLAGS = "RULE-TCP-INVALID-FLAGS"
SYN_FLOOD = "RULE-SYN-FLOOD"
PORT_SCAN = "RULE-PORT-SCAN"
HIGH_RATE = "RULE-HIGH-RATE-BURST"
SPOOFED = "RULE-IP-SPOOF-RESERVED"
ICMP_FLOOD = "RULE-ICMP-FLOOD"
MULTI_FLOW = "RULE-PORT-SCAN-MULTI-FLOW"
FLOORS = {"HIGH": 0.85, "MEDIUM": 0.65, "LOW": 0.50}
MATCH = "struct<rule_id:string,name:string,severity:string,matched_value:string>"


def hit(rule_id: str, name: str, severity: str, value: Column) -> Column:
    return F.struct(
        F.lit(rule_id).alias("rule_id"), F.lit(name).alias("name"),
        F.lit(severity).alias("severity"), value.cast("string").alias("matched_value"),
    ).cast(MATCH)


def _first(cases: Iterable[tuple[Column, Column]]) -> Column:
    out = None
    for cond, value in cases:
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def invalid_flags() -> Column:
    c, tcp = F.col, F.col("protocol") == 6
    return _first([
        (tcp & c("has_syn_fin"),
         hit(INVALID_FLAGS, "TCP Invalid Flags (SYN+FIN)", "HIGH", F.lit("SYN+FIN"))),
        (tcp & c("has_syn_rst"),
         hit(INVALID_FLAGS, "TCP Invalid Flags (SYN+RST)", "HIGH", F.lit("SYN+RST"))),
        (tcp & c("has_xmas_flags"),
         hit(INVALID_FLAGS, "TCP Xmas Scan Flags", "HIGH", F.lit("FIN+PSH+URG"))),
        (tcp & c("has_null_flags"),
         hit(INVALID_FLAGS, "TCP NULL Scan Flags", "HIGH", F.lit("NULL (flags=0)"))),
        (tcp & (c("invalid_flags_count") > 0),
         hit(INVALID_FLAGS, "TCP Invalid Flag Anomaly", "HIGH",
             _text("invalid_flags_count=", c("invalid_flags_count")))),
    ])


def syn_flood() -> Column:
    syn, ack = F.col("syn_count"), F.col("ack_count")
    tcp = F.col("protocol") == 6
    counts = _text("syn_count=", syn.cast("long"), ", ack_count=", ack.cast("long"))
    ratio = syn / F.greatest(ack.cast("double"), F.lit(1.0))
    return _first([
        (tcp & (syn >= 20) & (ack == 0), hit(SYN_FLOOD, "TCP SYN Flood (Zero ACK)", "HIGH", counts)),
        (tcp & (syn >= 10) & (ratio >= 10.0),
         hit(SYN_FLOOD, "TCP SYN Flood (High SYN/ACK Ratio)", "HIGH",
             _text(counts, ", ratio=", F.format_string("%.2f", ratio)))),
    ])


def port_probe() -> Column:
    syn, ack, size = F.col("syn_count"), F.col("ack_count"), F.col("total_bytes")
    tcp = F.col("protocol") == 6
    return _first([
        (tcp & (syn >= 5) & (size <= 250),
         hit(PORT_SCAN, "TCP Single-Flow Port Probe", "MEDIUM",
             _text("syn_count=", syn, ", total_bytes=", size))),
        (tcp & (syn >= 3) & (ack == 0) & (size <= 180),
         hit(PORT_SCAN, "TCP Unanswered Port Probe", "MEDIUM",
             _text("syn_count=", syn, ", ack_count=0, total_bytes=", size))),
    ])


def high_rate(min_packets: int | None = 10) -> Column:
    dur = F.greatest(F.col("duration_s"), F.lit(1e-6))
    pps, bps = F.col("packet_count") / dur, F.col("total_bytes") / dur
    enough = F.lit(True) if min_packets is None else F.col("packet_count") >= min_packets
    return _first([
        (enough & (pps >= 50_000.0),
         hit(HIGH_RATE, "High Volumetric Packet Rate Burst", "HIGH",
             _text("flow_packets_per_s=", F.format_string("%.1f", pps)))),
        (enough & (bps >= 50_000_000.0),
         hit(HIGH_RATE, "High Volumetric Byte Rate Burst", "HIGH",
             _text("flow_bytes_per_s=", F.format_string("%.1f", bps)))),
    ])


def spoofed_source(tcp_only: bool = True) -> Column:
    src, dst = F.trim("src_ip"), F.trim("dst_ip")
    bad = src.isin("0.0.0.0", "255.255.255.255")
    if tcp_only:
        bad = bad & (F.col("protocol") == 6)
    return _first([
        (bad, hit(SPOOFED, "Reserved/Broadcast Source IP on TCP", "HIGH", _text("src_ip=", src))),
        (src.startswith("127.") & ~dst.startswith("127."),
         hit(SPOOFED, "Cross-Interface Loopback Spoofing", "HIGH",
             _text("src_ip=", src, ", dst_ip=", dst))),
    ])


def icmp_flood() -> Column:
    n, icmp = F.col("packet_count"), F.col("protocol") == 1
    pps = n / F.greatest(F.col("duration_s"), F.lit(1e-6))
    return _first([
        (icmp & (n >= 20),
         hit(ICMP_FLOOD, "ICMP Burst / Flood", "MEDIUM", _text("packet_count=", n, ", protocol=ICMP"))),
        (icmp & (n >= 10) & (pps >= 20.0),
         hit(ICMP_FLOOD, "ICMP High-Rate Echo Burst", "MEDIUM",
             _text("flow_packets_per_s=", F.format_string("%.1f", pps), ", protocol=ICMP"))),
    ])


def multi_flow(scan_type: str = "scan_type") -> Column:
    """Match built from the columns the scan operators add (NULL scan type means no hit)."""
    return F.when(
        F.col(scan_type).isNotNull(),
        hit(MULTI_FLOW, "Multi-Flow Port Scan Correlation", "HIGH",
            _text("unique_ports=", F.col("scan_ports"), ", target=", F.col("scan_target"))),
    )


def flow_rules() -> list[Column]:
    return [invalid_flags(), syn_flood(), port_probe(), high_rate(), spoofed_source(), icmp_flood()]


def collect_matches(df: DataFrame, extra: Iterable[Column] = (), out: str = "rule_matches") -> DataFrame:
    """All matches of a row in rule order; further rules, such as the multi-flow one, come fourth."""
    first, last = flow_rules()[:3], flow_rules()[3:]
    return df.withColumn(out, F.array_compact(F.array(*first, *extra, *last)))


# What each rule needs when only feature columns are at hand.
FEATURE_NEEDS = {
    SYN_FLOOD: ("syn_count", "ack_count"),
    PORT_SCAN: ("syn_count", "packet_length_mean"),
    HIGH_RATE: ("flow_packets_per_s", "flow_bytes_per_s"),
    SPOOFED: ("src_ip", "dst_ip"),
    INVALID_FLAGS: ("has_syn_fin", "has_syn_rst", "has_xmas_flags", "has_null_flags",
                    "invalid_flags_count"),
    ICMP_FLOOD: ("protocol",),
    MULTI_FLOW: ("src_ip", "dst_ip", "dst_port"),
}


# How the missing endpoints of a rule are reported.
GAP_NAMES = {SPOOFED: "src_ip/dst_ip", MULTI_FLOW: "dst_port"}


def rules_from_features(df: DataFrame, out: str = "rule_matches") -> DataFrame:
    """The rules on feature columns, with the thresholds of that form, plus ``unavailable_rules`` and
    ``unavailable_features``. Availability follows from the columns present."""
    have, c = set(df.columns), F.col
    fixed: list[str] = []
    missing: list[str] = []
    matches: list[Column] = []

    def ready(rule: str) -> bool:
        gap = [f for f in FEATURE_NEEDS[rule] if f not in have]
        if gap:
            fixed.append(rule)
            missing.extend([GAP_NAMES[rule]] if rule in GAP_NAMES else gap)
        return not gap

    if ready(SYN_FLOOD):
        syn, ack = c("syn_count").cast("double"), c("ack_count").cast("double")
        given = c("syn_ack_ratio") if "syn_ack_ratio" in have else syn / F.greatest(ack, F.lit(1.0))
        steep = (given >= 10.0) | ((ack > 0) & (F.try_divide(syn, ack) >= 10.0))
        text = _text("syn_count=", syn.cast("long"), ", ack_count=", ack.cast("long"))
        matches.append(_first([
            ((syn >= 20) & (ack == 0), hit(SYN_FLOOD, "TCP SYN Flood (Zero ACK)", "HIGH", text)),
            ((syn >= 10) & steep, hit(SYN_FLOOD, "TCP SYN Flood (High SYN/ACK Ratio)", "HIGH",
                                      _text(text, ", ratio=", F.format_string("%.2f", given)))),
        ]))
    if ready(PORT_SCAN):
        syn, mean = c("syn_count").cast("double"), c("packet_length_mean")
        ack = c("ack_count").cast("double") if "ack_count" in have else F.lit(0.0)
        matches.append(F.when(
            (syn >= 5) & (mean <= 60.0) & (ack == 0),
            hit(PORT_SCAN, "Single-Flow Port Scan Probe", "MEDIUM",
                _text("syn_count=", syn.cast("long"), ", packet_length_mean=",
                      F.format_string("%.1f", mean)))))
    if ready(HIGH_RATE):
        pps, bps = c("flow_packets_per_s"), c("flow_bytes_per_s")
        matches.append(_first([
            (pps >= 50_000.0, hit(HIGH_RATE, "High Volumetric Packet Rate Burst", "HIGH",
                                  _text("flow_packets_per_s=", F.format_string("%.1f", pps)))),
            (bps >= 50_000_000.0, hit(HIGH_RATE, "High Volumetric Byte Rate Burst", "HIGH",
                                      _text("flow_bytes_per_s=", F.format_string("%.1f", bps)))),
        ]))
    if ready(SPOOFED):
        matches.append(spoofed_source(tcp_only=False))
    if ready(MULTI_FLOW) and "scan_type" in have:
        matches.append(multi_flow())
    flags = [f for f in FEATURE_NEEDS[INVALID_FLAGS] if f in have]
    if flags:
        text = {"has_syn_fin": ("TCP Invalid Flags (SYN+FIN)", F.lit("SYN+FIN")),
                "has_syn_rst": ("TCP Invalid Flags (SYN+RST)", F.lit("SYN+RST")),
                "has_xmas_flags": ("TCP Xmas Scan Flags", F.lit("FIN+PSH+URG")),
                "has_null_flags": ("TCP NULL Scan Flags", F.lit("NULL"))}
        cases = [(c(f).cast("boolean"), hit(INVALID_FLAGS, text[f][0], "HIGH", text[f][1]))
                 for f in flags if f in text]
        if "invalid_flags_count" in have:
            cases.append((c("invalid_flags_count") > 0, hit(
                INVALID_FLAGS, "TCP Invalid Flag Anomaly", "HIGH",
                _text("invalid_flags_count=", c("invalid_flags_count").cast("long")))))
        matches.append(_first(cases))
    else:
        fixed.append(INVALID_FLAGS)
        missing.append("packet_tcp_flags")
    proto = c("protocol") if "protocol" in have else F.lit(6)
    count = None
    if "packet_count" in have:
        count = c("packet_count").cast("long")
    elif "flow_packets_per_s" in have:
        count = c("flow_packets_per_s").cast("long")
    if count is not None:
        matches.append(F.when(
            (proto == 1) & (count >= 20),
            hit(ICMP_FLOOD, "ICMP Burst / Flood", "MEDIUM",
                _text("packet_count=", count, ", protocol=ICMP"))))
    icmp_gap = F.when(proto != 1, F.lit(ICMP_FLOOD))
    gone = F.array_sort(F.array_compact(F.array(*[F.lit(r) for r in sorted(set(fixed))], icmp_gap)))
    names = sorted(set(missing))
    return df.withColumns({
        out: F.array_compact(F.array(*matches)) if matches else F.array().cast(f"array<{MATCH}>"),
        "unavailable_rules": gone,
        "unavailable_features": F.array(*[F.lit(n) for n in names]).cast("array<string>"),
    })


def drop_unavailable(df: DataFrame, needs: dict[str, tuple[str, ...]] = FEATURE_NEEDS) -> DataFrame:
    """Drop matches of rules whose inputs are not among the columns."""
    have = set(df.columns)
    gone = [r for r, f in needs.items() if not have.issuperset(f)]
    return df.withColumn(
        "rule_matches", F.filter("rule_matches", lambda m: ~m["rule_id"].isin(gone) if gone else F.lit(True))
    )


def _has(severity: str) -> Column:
    return F.exists("rule_matches", lambda m: m["severity"] == severity)


def hybrid_verdict(df: DataFrame, score: str = "score", threshold: float = 0.5) -> DataFrame:
    """Detector score and rule matches into one verdict, source, threat score and severity."""
    p = F.greatest(F.least(F.col(score), F.lit(1.0)), F.lit(0.0))
    model, rule = p >= threshold, F.size("rule_matches") > 0
    floor = (
        F.when(_has("HIGH"), FLOORS["HIGH"]).when(_has("MEDIUM"), FLOORS["MEDIUM"])
        .when(_has("LOW"), FLOORS["LOW"]).otherwise(0.0)
    )
    return df.withColumns({
        "verdict": F.when(model | rule, "ATTACK").otherwise("BENIGN"),
        "detection_source": F.when(model & rule, "HYBRID").when(rule, "RULE").when(model, "RF")
        .otherwise("NONE"),
        "threat_score": F.greatest(p, floor),
        "severity": F.when(_has("HIGH") | (p >= 0.85), "HIGH")
        .when(_has("MEDIUM") | (p >= 0.65), "MEDIUM")
        .when(model | rule, "LOW").otherwise("INFORMATIONAL"),
        "rule_ids": F.transform("rule_matches", lambda m: m["rule_id"]),
    })


def alert_rows(df: DataFrame, score: str = "score", alert_threshold: float = 0.65,
               predict_threshold: float = 0.5) -> DataFrame:
    """Rows worth an alert, with threat score, level and source tag."""
    s = F.col(score)
    model = (s >= predict_threshold) & (s >= alert_threshold)
    rule = F.size("rule_matches") > 0
    floor = F.when(_has("HIGH"), 0.85).when(rule, 0.65).otherwise(0.0)
    return df.filter(model | rule).withColumns({
        "threat_score": F.greatest(s, floor),
        "level": F.when((s >= 0.85) | _has("HIGH"), "HIGH")
        .when((s >= 0.65) | _has("MEDIUM"), "MEDIUM").otherwise("LOW"),
        "alert_source": F.when(model & rule, "HYBRID").when(rule, "RULE").otherwise("MODEL"),
    })


def apply_rule_table(df: DataFrame, rules: Iterable[tuple[str, str, str, str]]) -> DataFrame:
    """User rules given as (id, name, severity, SQL boolean expression)."""
    cols = [F.when(F.expr(e), hit(i, n, s, F.lit(e))) for i, n, s, e in rules]
    return df.withColumn("rule_matches", F.array_compact(F.array(*cols)))
