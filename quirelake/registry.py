"""Registered queries and the SQL that must give the same rows."""

from .queries import documents, pipelines, search, sessions, store

_MODULES = (search, documents, store, pipelines, sessions)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in _MODULES for k, s in m.ORACLES.items()}
