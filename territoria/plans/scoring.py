"""Composite territorial scores: gates, best observations, bounds over the whole cohort, coverage, bands."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from territoria.functions.numbers import band, finite, scaled
from territoria.operators.aggregates import bounds
from territoria.operators.windows import best_observations

#: A coverage from which a score counts as complete; digits of a coverage, beyond which the order of a sum of weights tells.
FULL, DIGITS = 1 - 1e-12, 12


def gated(observations: DataFrame, configs: DataFrame) -> DataFrame:
    """Observations of configured indicators, with the warning that a non-finite value or a wrong unit gives. configs:
    indicator, weight, direction, expected_unit (few rows)."""
    rows = observations.join(configs.select("indicator", "expected_unit"), "indicator")
    wrong = F.col("expected_unit").isNotNull() & ~F.col("unit").eqNullSafe(F.col("expected_unit"))
    unit = F.concat(F.lit("incompatible_unit:"), "indicator", F.lit(":expected="), "expected_unit", F.lit(":actual="), F.coalesce("unit", F.lit("null")))
    return rows.withColumn("warning", F.when(~finite(F.col("value")), F.concat(F.lit("non_finite_value:"), "indicator")).when(wrong, unit))


def picked(observations: DataFrame, configs: DataFrame) -> DataFrame:
    """The best valid observation of each level, period, territory and indicator."""
    valid = gated(observations.where("value is not null and code is not null"), configs).where("warning is null")
    return best_observations(valid, ["level", "period", "code", "indicator"])


def details(chosen: DataFrame, configs: DataFrame, winsorized: bool = False) -> DataFrame:
    """Each picked value scaled between its bounds, with its effective weight and contribution. Bounds are those of the
    whole cohort; fixed ones of a config come first."""
    cohort = ["level", "period", "indicator"]
    if winsorized:
        chosen = chosen.join(bounds(chosen, cohort, "value", True).drop("n"), cohort)
    else:
        chosen = chosen.withColumn("lo", F.min("value").over(Window.partitionBy(*cohort))).withColumn("hi", F.max("value").over(Window.partitionBy(*cohort)))
    fixed = configs.withColumn("_lo", F.col("fixed_min") if "fixed_min" in configs.columns else F.lit(None).cast("double")).withColumn("_hi", F.col("fixed_max") if "fixed_max" in configs.columns else F.lit(None).cast("double"))
    rows = chosen.drop("expected_unit", "warning").join(fixed.select("indicator", "weight", "direction", "_lo", "_hi"), "indicator")
    rows = rows.withColumn("lo", F.coalesce("_lo", "lo")).withColumn("hi", F.coalesce("_hi", "hi")).drop("_lo", "_hi")
    available = F.sum("weight").over(Window.partitionBy("level", "period", "code"))
    rows = rows.withColumn("normalized", scaled(F.col("value"), F.col("lo"), F.col("hi"), F.col("direction"))).withColumn("available", available)
    return rows.withColumn("effective_weight", F.col("weight") / F.col("available")).withColumn("contribution", F.col("normalized") * F.col("effective_weight") * 100.0)


def universe(observations: DataFrame) -> DataFrame:
    """Every territory with any observation, of whatever indicator."""
    return observations.where("code is not null").select("level", "period", "code").distinct()


def scores(observations: DataFrame, configs: DataFrame, floor: float = 0.60, winsorized: bool = False) -> DataFrame:
    """level, period, code, coverage, score, risk, status, missing. Territories whose available weight is below the floor
    have no score. Period and level are keys of one plan, never loops."""
    rows = details(picked(observations, configs), configs, winsorized)
    total = configs.agg(F.sum("weight").alias("total"))
    sums = rows.groupBy("level", "period", "code").agg(F.sum("weight").alias("have"), F.sum("contribution").alias("raw"), F.collect_set("indicator").alias("seen"))
    wanted = configs.agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "indicator"))), lambda x: x["indicator"]).alias("wanted"))
    out = universe(observations).join(sums, ["level", "period", "code"], "left").crossJoin(F.broadcast(total)).crossJoin(F.broadcast(wanted))
    out = out.withColumn("coverage", F.round(F.coalesce("have", F.lit(0.0)) / F.col("total"), DIGITS))
    enough = F.col("coverage") >= floor
    out = out.withColumn("score", F.when(enough, F.least(F.greatest("raw", F.lit(0.0)), F.lit(100.0)))).withColumn("risk", band(F.col("score")))
    status = F.when(~enough, "insufficient_data").when(F.col("coverage") >= FULL, "valid").otherwise("partial")
    missing = F.array_except("wanted", F.coalesce("seen", F.array().cast("array<string>")))
    return out.select("level", "period", "code", "coverage", "score", "risk", status.alias("status"), missing.alias("missing"))


def summary(scored: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return scored.groupBy("level", "period").agg(n("valid"), n("partial"), n("insufficient_data"), F.count("*").alias("territories"))


def explained(scored: DataFrame, parts: DataFrame, top: int = 5) -> DataFrame:
    """A sentence for each score: its value, band and largest contributions."""
    ranked = parts.groupBy("level", "period", "code").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("contribution")).alias("k"), "indicator"))), 1, top).alias("t"))
    words = F.array_join(F.transform("t", lambda x: F.format_string("%s (%.1f)", x["indicator"], -x["k"])), ", ")
    return scored.join(ranked, ["level", "period", "code"]).select("level", "period", "code", F.format_string("Score %.1f (%s), mainly from %s.", "score", "risk", words).alias("text"))
