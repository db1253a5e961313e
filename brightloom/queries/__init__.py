"""All registered queries and their SQL."""

from brightloom.queries import cubes, dispatch, insight, learning, particles, streams  # noqa: F401
from brightloom.queries.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
