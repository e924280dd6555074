"""All queries of the engine, by name, and the SQL that each must equal."""

from .oracle import ORACLE_SQL
from .queries import QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
