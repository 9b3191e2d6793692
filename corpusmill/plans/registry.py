"""All queries of the library outside the training-data package."""

from __future__ import annotations

from corpusmill.plans import core_queries

QUERIES = dict(core_queries.QUERIES)
ORACLES = dict(core_queries.ORACLES)
