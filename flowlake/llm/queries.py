"""The registered queries of the corpus operators and the SQL of those that SQL can express."""

from __future__ import annotations

from .exact_dedup import OP7_SQL, op7_exact_dedup
from .fingerprints import op2_fingerprints
from .hard_negatives import OP13_SQL, op13_hard_negatives
from .html_text import op10_html_text
from .merkle import OP12_SQL, op12_merkle_manifest
from .near_dedup import op4_near_dedup
from .packing import op5_packing
from .pieces import op6_pieces
from .pii import op8_pii
from .quality import op9_quality
from .quality_rules import OP11_SQL, op11_quality_rules
from .sharding import op3_sharding
from .token_store import op1_token_store

QUERIES = {
    "op1_token_store": op1_token_store,
    "op2_fingerprints": op2_fingerprints,
    "op3_sharding": op3_sharding,
    "op4_near_dedup": op4_near_dedup,
    "op5_packing": op5_packing,
    "op6_pieces": op6_pieces,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_pii": op8_pii,
    "op9_quality": op9_quality,
    "op10_html_text": op10_html_text,
    "op11_quality_rules": op11_quality_rules,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_hard_negatives": op13_hard_negatives,
}
ORACLE_SQL = {
    "op7_exact_dedup": OP7_SQL,
    "op11_quality_rules": OP11_SQL,
    "op12_merkle_manifest": OP12_SQL,
    "op13_hard_negatives": OP13_SQL,
}
