"""All queries of the engine's own operators with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from chronofold.plans import queries_events, queries_functions, queries_graph, queries_joins, queries_knowledge, queries_records, queries_spatial, queries_upkeep, queries_views, queries_write

QUERIES, ORACLES = {}, {}
for part in (queries_records, queries_events, queries_spatial, queries_functions, queries_graph, queries_joins, queries_write, queries_views, queries_upkeep, queries_knowledge):
    QUERIES |= part.BOOK.queries
    ORACLES |= part.BOOK.oracles
