"""Registered queries by area. Importing the modules fills the registry."""

from importlib import import_module

AREAS = ("ingest_queries", "chunk_queries", "vector_queries", "search_queries", "answer_queries", "catalog_queries", "field_queries", "sample_queries",
         "metric_queries", "usage_queries", "workflow_queries",
         "stream_queries", "source_queries")


def load_all() -> None:
    for area in AREAS:
        import_module(f"doclattice.plans.{area}")
