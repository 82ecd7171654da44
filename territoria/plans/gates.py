"""Checks as rows: coverage and alerts folded to one verdict, and steps that wait for it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def coverage_checks(rows: DataFrame, wanted: DataFrame, territory: str = "code") -> DataFrame:
    """(name, severity, found, expected, status) for the checks wanted (name, severity, period, indicator, expected): how
    many territories rows (period, indicator, and theirs) have there. status is passed, failed, or missing where there is
    no row at all. Rows without a value of their own count if they are there; wanted checks are few."""
    counts = rows.groupBy("period", "indicator").agg(F.count_distinct(territory).alias("found"))
    joined = wanted.join(counts, ["period", "indicator"], "left")
    status = F.when(F.col("found").isNull(), "missing").when(F.col("found") == F.col("expected"), "passed").otherwise("failed")
    return joined.select("name", "severity", F.coalesce("found", F.lit(0)).alias("found"), F.col("expected").cast("long").alias("expected"), status.alias("status"))


def alert_checks(alerts: DataFrame, name: str = "no_integrity_errors") -> DataFrame:
    """One check that no alert (severity, name, n) is an error, and a warning for each other alert there is."""
    errors = alerts.where("severity = 'error'").agg(F.count("*").alias("found"))
    whole = errors.select(F.lit(name).alias("name"), F.lit("error").alias("severity"), "found", F.lit(0).cast("long").alias("expected"), F.when(F.col("found") == 0, "passed").otherwise("failed").alias("status"))
    rest = alerts.where("severity <> 'error'").select("name", F.lit("warning").alias("severity"), F.col("n").cast("long").alias("found"), F.lit(0).cast("long").alias("expected"), F.lit("failed").alias("status"))
    return whole.unionByName(rest)


def verdict(checks: DataFrame) -> DataFrame:
    """One row for all checks: passed, which is that no error check failed or is missing; how many checks there are; and
    the names of those that failed, are missing, and that only warn. No check at all doesn't pass."""
    bad = F.col("status") != "passed"
    names = lambda c: F.sort_array(F.collect_list(F.when(c, F.col("name"))))
    error = F.col("severity") == "error"
    return checks.agg(
        ((F.count("*") > 0) & (F.count_if(error & bad) == 0)).alias("passed"), F.count("*").alias("checks"),
        names(error & (F.col("status") == "failed")).alias("failed"), names(error & (F.col("status") == "missing")).alias("missing"), names(~error & bad).alias("warnings"))


def passes(checks: DataFrame) -> bool:
    return bool(verdict(checks).first()["passed"])
