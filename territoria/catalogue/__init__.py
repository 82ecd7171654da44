"""The queries of the library on the test tables, by name, and their SQL."""

from __future__ import annotations

from territoria.catalogue import adaptive, facts, parse, quality, scores, store
from territoria.catalogue.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "adaptive", "facts", "parse", "quality", "scores", "store"]
