"""Imports of annual and monthly statistics into observations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from territoria.functions.numbers import finite, guarded_ratio
from territoria.functions.text import code_strict
from territoria.operators.joins import months_or_year, propagated, with_latest_year, year_over_year
from territoria.operators.reshape import stacked
from territoria.plans.conformed import keyed


def published(rows: DataFrame) -> DataFrame:
    """Income and poverty rows that may be published: departments and regions, known measures, final and finite values."""
    return rows.where(F.col("GEO_OBJECT").isin("DEP", "REG") & F.col("FILOSOFI_MEASURE").isin("PR_MD60", "MED_SL") & (F.col("CONF_STATUS") == "F") & finite(F.col("OBS_VALUE")))


def income(rows: DataFrame, territories: DataFrame, periods: DataFrame) -> DataFrame:
    """Published annual values of known territories, at every period from their year on."""
    known = published(rows).join(territories, "GEO", "left_semi")
    return propagated(known, periods, "TIME_PERIOD", "period")


def inflation(index: DataFrame) -> DataFrame:
    """(period, rate): year-over-year change by month, and the mean of its months for each year."""
    months = year_over_year(index, "period", "value").select("period", "rate")
    years = months.groupBy(F.substring("period", 1, 4).alias("period")).agg(F.avg("rate").alias("rate"))
    return stacked(months, years)


def unemployment(macro: DataFrame, periods: DataFrame, keys: list[str]) -> DataFrame:
    """Unemployed per hundred active people at each period, from the latest macro year that isn't after it. macro: keys,
    year, ACT, CHOM; sums of several territories count missing parts as zero."""
    sums = macro.groupBy(*keys, "year").agg(F.sum(F.coalesce("ACT", F.lit(0.0))).alias("ACT"), F.sum(F.coalesce("CHOM", F.lit(0.0))).alias("CHOM"))
    dated = with_latest_year(periods.select("period"), "snapshot_year", F.substring("period", 1, 4).cast("int"), macro, "year")
    joined = dated.join(sums, F.col("snapshot_year") == F.col("year"))
    return joined.select(*keys, "period", "snapshot_year", guarded_ratio(F.col("CHOM"), F.col("ACT"), 100.0).alias("value"))


def replicated(rates: DataFrame, months: DataFrame, version: str, indicator: str, unit: str) -> DataFrame:
    """Annual values of departments (year, code, name, value) as observations: at each month of their year that is known
    (months: period), or at the year itself; with indicator, unit, observation_type and the key that its version makes."""
    rows = months_or_year(rates, months, "year", "period").withColumnRenamed("period_key", "period")
    kind = F.when(F.length("period") == 7, "annual_replicated_monthly").otherwise("annual")
    rows = rows.select("period", "code", "name", F.lit(indicator).alias("indicator"), "value", F.lit(unit).alias("unit"), kind.alias("observation_type"))
    return keyed(rows, version)


def imported(rows: DataFrame, written: DataFrame) -> DataFrame:
    """rows with status: inserted, or unchanged where their key is among those written. Of rows with one key one counts."""
    there = written.select("key").distinct().withColumn("_there", F.lit(True))
    return rows.dropDuplicates(["key"]).join(there, "key", "left").withColumn("status", F.when(F.col("_there"), "unchanged").otherwise("inserted")).drop("_there")


def import_report(rows: DataFrame) -> DataFrame:
    """(departments, inserted, unchanged) of imported rows."""
    return rows.agg(F.count_distinct("code").alias("departments"), F.count_if(F.col("status") == "inserted").alias("inserted"), F.count_if(F.col("status") == "unchanged").alias("unchanged"))


def whole_years(rates: DataFrame, known: DataFrame) -> DataFrame:
    """rates of years that have a value for each known department (code); a year that lacks one is an error, which the job
    that reads the result raises."""
    there = rates.join(known.select("code").distinct(), "code", "left_semi")
    counts = there.groupBy("year").agg(F.count_distinct("code").alias("_n"))
    counts = counts.withColumn("_all", known.select(F.count_distinct("code")).scalar())
    whole = F.when(F.col("_n") == F.col("_all"), True).otherwise(F.raise_error(F.concat(F.lit("incomplete: "), F.col("year").cast("string"))).cast("boolean"))
    return there.join(counts.where(whole).select("year"), "year")


def mean_debt(rows: DataFrame) -> DataFrame:
    """Thousands of euros over cases as euros a case, where both are positive."""
    return rows.where("thousands > 0 and cases > 0").withColumn("value", F.col("thousands") * 1000.0 / F.col("cases"))


def legacy(rows: DataFrame) -> DataFrame:
    """Old rows (year, region, indicator_name, value) with a department code in their region and a finite value."""
    return rows.withColumn("code", code_strict(F.col("region"))).where(F.col("code").isNotNull() & finite(F.col("value")))


def legacy_import(rows: DataFrame, known: DataFrame, indicators: dict[str, str], written: DataFrame) -> DataFrame:
    """Old rows as observations with status (see imported): of known departments (code, name), under the new names of
    their indicators; rows of others are left out. The last value of a department, year and indicator counts, by value
    where rows tell nothing else."""
    named = legacy(rows).withColumn("indicator", F.element_at(F.create_map(*(F.lit(x) for kv in indicators.items() for x in kv)), F.col("indicator_name"))).where("indicator is not null")
    one = named.join(known, "code").groupBy("code", "name", "indicator", F.col("year").cast("string").alias("period")).agg(F.max("value").alias("value"))
    return imported(keyed(one.withColumn("level", F.lit("department")), "income-1"), written)
