"""Registered queries of the library's own operators, each with the DuckDB SQL that gives the same rows."""

from . import tables  # noqa: F401  adds its queries
from .queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
