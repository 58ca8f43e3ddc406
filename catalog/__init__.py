"""Registered queries on the test tables, each with the SQL it must agree with."""

from . import (
    function_queries,
    observe_queries,
    output_queries,
    quality_queries,
    relational_queries,
    shaping_queries,
    source_queries,
    streaming_queries,
)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
