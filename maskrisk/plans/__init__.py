"""Registered queries: name to (query, DuckDB SQL or None)."""

from . import pixel_queries, record_queries, shape_queries, summary_queries

REGISTRY: dict[str, tuple] = {**pixel_queries.REGISTRY, **record_queries.REGISTRY, **shape_queries.REGISTRY, **summary_queries.REGISTRY}
