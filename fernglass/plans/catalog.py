"""All queries of the core and their oracles."""

from __future__ import annotations

from . import access, intake, ledger, maintenance, search, state, structure, texts

_MODULES = (ledger, texts, maintenance, state, search, structure, intake, access)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
