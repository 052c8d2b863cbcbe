"""Imports every module of queries, so that the registry is full."""

from . import expression_queries, object_queries, solver_queries, spatial_queries, survey_queries, temporal_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
