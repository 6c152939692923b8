"""Registered queries with their SQL equivalents."""

from __future__ import annotations

from lakeloom.plans import corpus, files, models, sheet, text

MODULES = (text, sheet, corpus, models, files)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
