"""Operators for large-scale training data. Nothing else in the library imports this subpackage."""

from grainloom.llm.queries import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
