"""Imports every query module, which fills the registry."""

from gleaner.plans import (queries_compare, queries_facets, queries_io, queries_joins, queries_records,  # noqa: F401
                           queries_streams, queries_text, queries_vectors)
from gleaner.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
