"""All registered queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from weftline.plans import exchange, gates, manifests, profile, ranking, relational, scalars, scoring  # noqa: F401
from weftline.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
