"""Whole analyses over curated facts: what changed from month to month, where most is, and a dashboard's data set."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from territoria.operators.windows import consecutive_change, percent_change

#: Sections of the analysis, in order.
SECTIONS = ("summary", "month", "break", "department", "comparison")


def business_analysis(totals: DataFrame, years: tuple[int, int], departments: int = 10, breaks: int = 5) -> DataFrame:
    """(section, place, label, value, before, change, percent) of the totals (period `YYYY-MM`, code, name, value) of
    departments.

    summary is one row: the last month's sum against the first's. month has every month's sum and its change against the
    month before, if that is there; break the `breaks` largest of these changes, up or down; department the departments
    with most in the last month; comparison each month that both `years` have, the second against the first. Ties go by
    label. A change against zero has no percentage; no rows give no rows. Sums are by month and so few; departments of one
    month are limited before they meet."""
    sums = totals.groupBy("period").agg(F.sum("value").alias("value"))
    months = consecutive_change(sums, "period", "value").select("period", "value", (F.col("value") - F.col("change")).alias("before"), "change", "percent")
    part = lambda rows, section, place, label: rows.select(F.lit(section).alias("section"), place.cast("int").alias("place"), label.alias("label"), "value", "before", "change", "percent")
    against = lambda rows: rows.withColumn("change", F.col("value") - F.col("before")).withColumn("percent", F.try_divide("change", "before") * 100.0)
    ends = sums.agg(F.min("period").alias("first"), F.max("period").alias("last"), F.max_by("value", "period").alias("value"), F.min_by("value", "period").alias("before")).where("last is not null")
    place = lambda *order: F.row_number().over(Window.orderBy(*order))
    largest = months.where("change is not null").orderBy(F.abs("change").desc(), "period").limit(breaks)
    most = totals.where(F.col("period") == totals.select(F.max("period")).scalar()).orderBy(F.desc("value"), "code").limit(departments)
    most = most.select("code", "name", "value", *(F.lit(None).cast("double").alias(c) for c in ("before", "change", "percent")))
    own = lambda year: sums.where(F.substring("period", 1, 4) == str(year)).withColumn("month", F.substring("period", 6, 2))
    both = own(years[1]).select("month", "value").join(own(years[0]).select("month", F.col("value").alias("before")), "month")
    out = part(against(ends), "summary", F.lit(1), F.concat_ws(" ", "first", "last"))
    for rows in (
        part(months, "month", place("period"), F.col("period")), part(largest, "break", place(F.abs("change").desc(), "period"), F.col("period")),
        part(most, "department", place(F.desc("value"), "code"), F.concat_ws(" ", "code", "name")), part(against(both), "comparison", place("month"), F.col("month"))):
        out = out.unionByName(rows)
    return out


def finalised(rows: DataFrame) -> DataFrame:
    """A dashboard's data set from rows (year, code, indicator, indicator_name, macro_value, filings): rows without year, code
    or indicator go; macro_indicator_label is the indicator's name, or says that it has none; national_filings_mean is the
    mean of its year and national_macro_mean that of its year and indicator; annual_change_pct is the change of filings
    against the row before, of the department and indicator, in percent, zero where there is none or it was zero. Missing
    filings count as zero. Means are joined back, so no task holds a year."""
    held = rows.where("year is not null and code is not null and indicator is not null").withColumn("year", F.col("year").cast("int")).withColumn("filings", F.coalesce(F.col("filings").cast("double"), F.lit(0.0)))
    name = F.trim(F.coalesce("indicator_name", F.lit("")))
    label = F.when((name != "") & (F.lower(name) != "nan") & (name != F.col("indicator")), name).otherwise(F.concat(F.lit("Indicateur INSEE non libellé ("), F.col("indicator"), F.lit(")")))
    by_year = held.groupBy("year").agg(F.avg("filings").alias("national_filings_mean"))
    by_both = held.groupBy("year", "indicator").agg(F.avg("macro_value").alias("national_macro_mean"))
    changed = held.withColumn("annual_change_pct", percent_change("filings", ["code", "indicator"], "year"))
    return changed.withColumn("macro_indicator_label", label).join(by_year, "year").join(by_both, ["year", "indicator"])
