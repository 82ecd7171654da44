"""Keys of rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def idempotence_key(*parts: Column) -> Column:
    """sha-256 of the parts joined by bars; a null part is empty and keeps its place."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def indicator_key(system: Column, code: Column) -> Column:
    return F.concat(system, F.lit(":"), code)
