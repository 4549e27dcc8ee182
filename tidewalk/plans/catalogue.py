"""All queries of the engine's own operators, and the SQL of those that have some."""

from __future__ import annotations

from . import connected, equity, modelling, operations, relational, statistics, textual

MODULES = (relational, statistics, equity, textual, operations, connected, modelling)
QUERIES = {name: fn for m in MODULES for name, fn in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
