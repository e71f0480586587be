"""All registered queries and their SQL."""

from __future__ import annotations

from callscope.plans import annotated, core, rollups, statistics, validation

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _m in (core, annotated, rollups, statistics, validation):
    QUERIES |= _m.QUERIES
    SQL |= _m.SQL
