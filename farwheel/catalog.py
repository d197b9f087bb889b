"""Every registered query of the transit engine with its SQL oracle. Keys are operator ids with a name behind."""

from __future__ import annotations

from farwheel import queries_artefacts, queries_drawn, queries_groups, queries_journeys, queries_lines, queries_live, queries_rows, queries_scalars, queries_sources, queries_walks
from farwheel.registry import ORACLE_SQL, QUERIES, Query

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES", "Query", "queries_artefacts", "queries_drawn", "queries_groups", "queries_journeys", "queries_lines", "queries_live", "queries_rows", "queries_scalars", "queries_sources", "queries_walks"]

FLAGSHIP: Query = QUERIES.get("TOP-01_next_departures")
