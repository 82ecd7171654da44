"""Aggregations with the rules of the domain."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from territoria.operators.ranks import percentiles


def by_rule(df: DataFrame, keys: list[str], rule: str, value: str) -> DataFrame:
    """Sum, or mean where the rule says mean; rows without a value don't count. Sums and counts combine before the
    shuffle."""
    total = F.when(F.col(rule) == "mean", F.avg(value)).otherwise(F.sum(value))
    return df.where(F.col(value).isNotNull()).groupBy(*keys, rule).agg(total.alias(value), F.count(value).alias("n"))


def bounds(df: DataFrame, keys: list[str], value: str, winsorized: bool = False, tail: float = 0.05) -> DataFrame:
    """Lower and upper bound by key: extremes, or exact interpolated percentiles."""
    if winsorized:
        return percentiles(df, keys, value, {"lo": tail, "hi": 1 - tail})
    return df.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("n"))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """How many rows there are beyond the first of each key; nulls are equal to each other."""
    return df.groupBy(*keys).agg(F.count("*").alias("_n")).agg(F.sum(F.col("_n") - 1).alias("duplicates"), F.sum("_n").alias("total"))


def null_counts(df: DataFrame) -> DataFrame:
    """(column_name, nulls) for the columns that have nulls, in one pass."""
    one = df.agg(*(F.sum(F.col(c).isNull().cast("long")).alias(c) for c in df.columns))
    return one.unpivot([], df.columns, "column_name", "nulls").where("nulls > 0")


def numeric_shares(df: DataFrame, parse) -> DataFrame:
    """(column_name, share): the part of each text column's values that are numbers, in one pass."""
    one = df.agg(*(F.avg(parse(F.col(c)).isNotNull().cast("double")).alias(c) for c in df.columns))
    return one.unpivot([], df.columns, "column_name", "share")


def missing_months(df: DataFrame, year: str, month: str) -> DataFrame:
    """The months that each year lacks."""
    return df.groupBy(year).agg(F.array_except(F.sequence(F.lit(1), F.lit(12)), F.collect_set(F.col(month).cast("int"))).alias("missing")).where(F.size("missing") > 0)


def examples(df: DataFrame, keys: list[str], value: str, name: str = "examples", n: int = 8) -> DataFrame:
    """(keys, name): the first n different values of each key in order, joined by bars. Values are made different and
    limited to n before they are gathered, and before they are shuffled to their key, so no array or task holds more."""
    distinct = df.where(F.col(value).isNotNull()).select(*keys, value).distinct()
    first = distinct.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(value))).where(F.col("_at") <= n)
    found = first.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_at", F.col(value).alias("_v")))), lambda x: x["_v"]), " | ").alias(name))
    alone = df.select(*keys).distinct()
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys]
    return alone.alias("a").join(found.alias("f"), on, "left").select(*(F.col(f"a.{k}") for k in keys), F.coalesce(F.col(f"f.{name}"), F.lit("")).alias(name))


def missing_by(df: DataFrame, group: str, expected: DataFrame) -> DataFrame:
    """Rows of group x expected that df lacks."""
    return df.select(group).distinct().crossJoin(expected).join(df, [group, *expected.columns], "left_anti")
