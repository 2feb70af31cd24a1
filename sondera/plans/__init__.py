"""Registered queries by theme; importing this package fills the catalog."""

from . import frame_queries, function_queries, kernel_queries, relation_queries, source_queries, vector_queries  # noqa: F401
