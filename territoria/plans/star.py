"""The star schema and its views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from territoria.functions.keys import indicator_key
from territoria.functions.periods import granularity, month_of, year_of
from territoria.operators.joins import ratios, snapshot_asof
from territoria.operators.reshape import stacked
from territoria.operators.windows import first_by


def periods(*keys: DataFrame) -> DataFrame:
    """dim_period from any tables of period_key."""
    every = stacked(*(k.select("period_key") for k in keys)).distinct()
    p = F.col("period_key")
    return every.select("period_key", year_of(p).alias("reference_year"), month_of(p).alias("reference_month_number"), granularity(p).alias("granularity"))


def indicators(*sources: DataFrame) -> DataFrame:
    """dim_indicator from (source_system, indicator_code, indicator_name), the first name of a code."""
    every = stacked(*sources)
    once = first_by(every, ["source_system", "indicator_code"], "indicator_name")
    return once.withColumn("indicator_key", indicator_key(F.col("source_system"), F.col("indicator_code")))


def facts(fact: DataFrame, indicator: DataFrame, territory: DataFrame, indicator_on: str, territory_on: str) -> DataFrame:
    """A fact with its indicator, which it must have, and its territory, if known. Whether a dimension is small enough to
    be broadcast is for Spark to tell by its size."""
    return fact.join(indicator, indicator_on).join(territory, territory_on, "left")


def store(deposits: DataFrame, macro: DataFrame, filings: DataFrame, departments: DataFrame, metadata: DataFrame) -> dict[str, DataFrame]:
    """The tables of the store by name, as plans: dimensions of departments, indicators (with the label and year that the
    metadata (code, label) gives) and periods, and a fact per source. deposits: reference_period, department_code,
    indicator_code, indicator_name, value; macro and filings alike with reference_year. Rows without a value or of unknown
    departments are no facts."""
    known = departments.select("department_code").distinct()
    kept = {n: f.where("value is not null").join(known, "department_code", "left_semi") for n, f in (("deposits", deposits), ("macro", macro), ("filings", filings))}
    named = lambda n: kept[n].select(F.lit(n).alias("source_system"), "indicator_code", "indicator_name")
    dim = indicators(named("deposits"), named("macro"), named("filings")).join(metadata.select(F.col("code").alias("indicator_code"), "label"), "indicator_code", "left")
    dim = dim.withColumn("indicator_name", F.coalesce("label", "indicator_name")).drop("label")
    keys = [kept["deposits"].select(F.col("reference_period").alias("period_key")), *(kept[n].select(F.col("reference_year").cast("string").alias("period_key")) for n in ("macro", "filings"))]
    fact = lambda n: kept[n].withColumn("indicator_key", indicator_key(F.lit(n), F.col("indicator_code"))).drop("indicator_name")
    return {"dim_department": departments, "dim_indicator": dim, "dim_period": periods(*keys), **{f"fact_{n}": fact(n) for n in kept}}


def deposits_with_macro(deposits: DataFrame, macro: DataFrame, on: list[str]) -> DataFrame:
    """Deposits with the macro values of the latest snapshot up to a year ahead."""
    return snapshot_asof(deposits, macro, on, "reference_year", "macro_year", ahead=1)


def regional(macro: DataFrame, keys: list[str], code: str, value: str, definitions: DataFrame) -> DataFrame:
    """Sums by region, and the ratios defined on them."""
    base = macro.groupBy(*keys, code).agg(F.sum(value).alias(value))
    return stacked(base.withColumn("rule", F.lit("sum")), ratios(base, keys, code, value, definitions).withColumn("rule", F.lit("derived_ratio")))
