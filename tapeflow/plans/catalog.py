"""All queries of the engine by name."""

from __future__ import annotations

from . import analysis, decisions, enrichment, learning, market, reports, stored, trading
from . import twins as _twins  # adds to the twins of the others
from .base import nudged

_GROUPS = (trading, market, analysis, decisions, enrichment, reports, stored, learning)

QUERIES = {f.__name__: f for group in _GROUPS for f in group.QUERIES}
ORACLE_SQL = {k: nudged(v) for group in _GROUPS for k, v in group.ORACLE.items()}
