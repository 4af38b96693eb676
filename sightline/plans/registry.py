"""All registered queries of the engine, and their SQL."""

from __future__ import annotations

from sightline.plans import delivery, events, files, frames, measures, more, reports, streams, tables

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for module in (frames, events, reports, tables, more, delivery, measures, streams, files):
    QUERIES |= module.Q.queries
    ORACLE_SQL |= module.Q.sql
