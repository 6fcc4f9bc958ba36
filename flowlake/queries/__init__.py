"""The registered queries of the library's operators over the given tables, and their SQL twins.

A module per group of operators. Each query takes (spark, sf_dir) and reads whole tables; the SQL of a
query states the rule of the operator in DuckDB's dialect, over the same views.
"""

from __future__ import annotations

from flowlake.queries import cleaning, correlation, drift, events, flows, models, policy, quality, splits, streams

_GROUPS = (flows, correlation, quality, cleaning, splits, drift, policy, events, models, streams)
QUERIES = {name: fn for g in _GROUPS for name, fn in g.BOOK.queries.items()}
ORACLE_SQL = {name: sql for g in _GROUPS for name, sql in g.BOOK.sql.items()}
