"""Quality and observability: curated frames, completeness, gates, freshness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from territoria.functions.numbers import parsed_french
from territoria.functions.periods import month_number, period_key
from territoria.functions.text import code_upper, plain_text


def curated(raw: DataFrame, indicators: DataFrame) -> DataFrame:
    """Raw deposits (reference_year, reference_month, departement_code, indicator_name, value as text) as typed rows in
    canonical order; the dictionary (name, indicator_code, indicator_group, unit) is joined by normalised name."""
    named = raw.withColumn("_k", plain_text(F.col("indicator_name"))).join(indicators.withColumn("_k", plain_text(F.col("name"))).drop("name"), "_k", "left").drop("_k")
    month = month_number(F.col("reference_month"))
    out = named.withColumn("departement_code", code_upper(F.col("departement_code"))).withColumn("reference_month_number", month).withColumn("reference_period", period_key(F.col("reference_year"), month)).withColumn("value", parsed_french(F.col("value")))
    return out.orderBy(F.col("reference_period").asc_nulls_last(), F.col("departement_code").asc_nulls_last(), F.col("indicator_code").asc_nulls_last())


def freshness(df: DataFrame, indicator: str, period: str, territory: str) -> DataFrame:
    return df.groupBy(indicator).agg(F.count("*").alias("rows"), F.count_distinct(territory).alias("territories"), F.min(period).alias("first_period"), F.max(period).alias("last_period"))


def gate(df: DataFrame, keys: list[str], territory: str, expected: int) -> DataFrame:
    """Whether each key has the territories expected."""
    return df.groupBy(*keys).agg(F.count_distinct(territory).alias("territories")).withColumn("passed", F.col("territories") == expected)


def incomplete(df: DataFrame, source: str, expected: int) -> DataFrame:
    return df.groupBy(source).agg(F.count("*").alias("rows")).where(F.col("rows") != expected)


def filings(rows: DataFrame, departments: int = 50) -> tuple[DataFrame, list[str]]:
    """Filings (year, month, code, indicator, value, file) without repeated keys, and what is against them: negative
    values are an error; with too few departments the set is empty, with a warning."""
    from territoria.operators.windows import first_by

    once = first_by(rows, ["year", "month", "code", "indicator", "file"], "value")
    seen = once.agg(F.count_distinct("code").alias("n"), F.count_if(F.col("value") < 0).alias("negative")).first()
    if seen["negative"]:
        raise ValueError("negative filings")
    return (once, []) if seen["n"] >= departments else (once.limit(0), [f"{seen['n']} departments, {departments} needed"])
