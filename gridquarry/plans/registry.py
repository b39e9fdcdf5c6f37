"""Every query of the library with its SQL."""

from __future__ import annotations

from gridquarry.plans import catalog, oracles

QUERIES = dict(catalog.QUERIES)
ORACLE_SQL = dict(oracles.ORACLE_SQL)
