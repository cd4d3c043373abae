"""Registered queries over the given tables."""

from pactlane.plans import (  # noqa: F401
    compare_queries,
    corpus_queries,
    curate_queries,
    evaluation_queries,
    library_queries,
    provenance_queries,
    review_queries,
    source_queries,
)
from pactlane.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
