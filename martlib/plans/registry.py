"""All registered queries of the warehouse operators, with their DuckDB SQL."""

from __future__ import annotations

from martlib.plans import event_queries, load_queries, quality_queries, shop_queries, sink_queries

_MODULES = (shop_queries, quality_queries, event_queries, load_queries, sink_queries)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
