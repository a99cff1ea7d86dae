"""All queries over the given tables, and their SQL."""

from __future__ import annotations

from . import handoff, screening, tables, texts, workspace

QUERIES = screening.QUERIES | tables.QUERIES | texts.QUERIES | workspace.QUERIES | handoff.QUERIES
ORACLES = screening.ORACLES | tables.ORACLES | texts.ORACLES | workspace.ORACLES | handoff.ORACLES
