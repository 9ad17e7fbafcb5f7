"""All registered queries."""

from __future__ import annotations

from adlattice.plans import encode_queries, evaluation_queries, profile_queries, source_queries
from adlattice.plans.registry import Query

QUERIES: list[Query] = [*source_queries.QUERIES, *profile_queries.QUERIES, *encode_queries.QUERIES, *evaluation_queries.QUERIES]
