"""Importing this module fills the catalog."""

from airgrid.plans import grid_queries, learning_queries, matching_queries, report_queries, source_queries, streaming_queries, temporal_queries  # noqa: F401
