"""Registered queries of the page-layout and label-quality operators, each with its SQL where SQL can express it."""

from __future__ import annotations

from pagewright.plans import aggregates, catalogue, joins, layouts, quality, selections, sequences

MODULES = (aggregates, joins, sequences, selections, layouts, quality, catalogue)
QUERIES = {name: q for m in MODULES for name, q in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
