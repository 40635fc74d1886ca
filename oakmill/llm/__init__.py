"""Operators of a large training-data pipeline. Nothing else in the library imports this."""

from oakmill.llm.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
