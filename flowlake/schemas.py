"""Table schemas as DDL text."""

from __future__ import annotations

# Columns that are stored as JSON text in exchange files.
JSON_TYPES = {
    "features": "map<string,double>",
    "rule_matches": "array<struct<rule_id:string,name:string,severity:string,description:string,matched_value:string>>",
    "detection": "map<string,string>",
    "response": "map<string,string>",
    "metadata": "map<string,string>",
}
EVENTS = (
    "event_id string, ts timestamp, flow_id string, source_mode string, source_ip string, dest_ip string, source_port int, "
    "dest_port int, protocol int, hybrid_verdict string, hybrid_risk_score double, severity string, source_escalated boolean, "
    + ", ".join(f"{n} {t}" for n, t in JSON_TYPES.items())
)
