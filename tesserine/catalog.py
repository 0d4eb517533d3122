"""All queries of the library and their SQL, by name."""

from __future__ import annotations

from tesserine.plans import oracles, queries

QUERIES = queries.QUERIES
ORACLES = oracles.oracles()
