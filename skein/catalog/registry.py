"""All queries of the core."""

from __future__ import annotations

from . import problems, retrieval, structure, versions

MODULES = [problems, retrieval, structure, versions]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: s for m in MODULES for k, s in m.ORACLE.items()}
