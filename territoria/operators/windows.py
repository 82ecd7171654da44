"""Picks and changes over ordered groups; every order is total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from territoria.functions.periods import month_index


def first_by(df: DataFrame, keys: list[str], *order: Column | str, descending: bool = False) -> DataFrame:
    """The first row of each key in the order given, ascending or descending throughout, nulls last. Rows combine before
    the shuffle, so a key with very many rows is no burden to a task."""
    rest = [c for c in df.columns if c not in keys]
    if not rest or not order:
        return df.dropDuplicates(keys)
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    known = (lambda c: c.isNotNull()) if descending else (lambda c: c.isNull())
    by = F.struct(*(x.alias(f"_{n}{k}") for n, c in enumerate(columns) for k, x in (("a", known(c)), ("b", c))))
    row = F.struct(*(F.col(f"`{c}`") for c in rest))
    best = df.groupBy(*keys).agg((F.max_by if descending else F.min_by)(row, by).alias("_row"))
    return best.select(*(F.col(f"`{c}`") if c in keys else F.col(f"_row.`{c}`").alias(c) for c in df.columns))


def best_observations(df: DataFrame, keys: list[str], confidence: str = "confidence", updated: str = "updated", created: str = "created", ident: str = "id") -> DataFrame:
    """The most trusted row of each key: confidence, then freshness, nulls last; the largest id among equals."""
    return first_by(df, keys, confidence, updated, created, ident, descending=True)


def change(value: str, keys: list[str], order: str) -> Column:
    return F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(order))


def consecutive_change(df: DataFrame, period: str, value: str, keys: list[str] = ()) -> DataFrame:
    """change and percent against the row before, only where that is the month before."""
    w = Window.partitionBy(*keys).orderBy(period)
    next_month = month_index(F.col(period)) - F.lag(month_index(F.col(period))).over(w) == 1
    before = F.lag(value).over(w)
    return df.withColumn("consecutive", F.coalesce(next_month, F.lit(False))).withColumn("change", F.when(next_month, F.col(value) - before)).withColumn("percent", F.when(next_month, (F.col(value) - before) / F.nullif(before, F.lit(0.0)) * 100.0))


def percent_change(value: str, keys: list[str], order: str) -> Column:
    """Percent against the row before; 0 where there is none or it is zero."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    return F.coalesce((F.col(value) / F.nullif(before, F.lit(0.0)) - 1) * 100.0, F.lit(0.0))


def latest_wins(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    return first_by(df, keys, version, descending=True)
