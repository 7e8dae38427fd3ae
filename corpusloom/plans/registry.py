"""All queries of the engine and their oracle SQL."""

from __future__ import annotations

from . import curation, feeds, grading, interfaces, measures, records, rollouts, traces

MODULES = (curation, grading, traces, records, rollouts, interfaces, feeds, measures)


def queries():
    out = {}
    for m in MODULES:
        out |= m.QUERIES
    return out


def oracle_sql():
    out = {}
    for m in MODULES:
        out |= m.SQL
    return out
