"""Registry of the engine's queries."""

from __future__ import annotations

import importlib

from lodestar.plans import registry

MODULES = ("text_queries", "knowledge_queries", "graph_queries", "event_queries", "vector_queries", "dataset_queries", "matching_queries", "relational_queries", "streaming_queries", "review_queries", "evidence_queries", "assertion_queries", "training_queries", "pipeline_queries")


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"lodestar.plans.{name}")


def entry(spark):
    """The flagship query on the smallest tables: the twenty best co-occurrence edges."""
    _load()
    return registry.QUERIES["top_edges"](spark, "/root/testdata/sf0.001")


def queries():
    _load()
    return dict(registry.QUERIES)


def oracle_sql():
    _load()
    return dict(registry.ORACLES)
