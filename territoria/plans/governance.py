"""Versions of scores compared, validated and tested for sensitivity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from territoria.functions.numbers import average_rank, correlation
from territoria.operators.aggregates import bounds
from territoria.operators.joins import matched
from territoria.operators.ranks import average_ranks
from territoria.operators.windows import change


def comparison_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """(code, period, score_a, score_b, delta, rank_a, rank_b) of two versions (code, period, score). Ranks are average,
    descending, within the period."""
    left = a.where("score is not null").withColumnRenamed("score", "score_a")
    right = b.where("score is not null").withColumnRenamed("score", "score_b")
    rows = matched(left, right, ["code", "period"])
    return rows.withColumn("delta", F.col("score_b") - F.col("score_a")).withColumn("rank_a", average_rank("score_a", "period", descending=True)).withColumn("rank_b", average_rank("score_b", "period", descending=True))


def comparison(rows: DataFrame) -> DataFrame:
    """Rows compared, Spearman's correlation (of the ranks, pooled), mean and largest absolute change."""
    return rows.agg(F.count("*").alias("compared"), correlation(F.col("rank_a"), F.col("rank_b")).alias("spearman"), F.avg(F.abs("delta")).alias("mean_abs_delta"), F.max(F.abs("delta")).alias("max_abs_delta"), F.count_if(F.col("rank_a") != F.col("rank_b")).alias("rank_changes"))


def spearman(df: DataFrame, x: str, y: str, least: int = 3) -> DataFrame:
    """Spearman's correlation over all pairs, null for fewer than `least`."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("_a"), F.col(y).alias("_b"))
    ranked = average_ranks(pairs, {"_a": "_x", "_b": "_y"})
    return ranked.agg(F.count("*").alias("n"), F.when(F.count("*") >= least, correlation(F.col("_x"), F.col("_y"))).alias("spearman"))


def volatility(scored: DataFrame) -> DataFrame:
    """Mean absolute change between periods of each territory."""
    moved = scored.withColumn("_d", F.abs(change("score", ["code"], "period")))
    return moved.groupBy("code").agg(F.avg("_d").alias("volatility")).where("volatility is not null")


def scenario_scores(values: DataFrame, limits: DataFrame, scenarios: DataFrame, scale) -> DataFrame:
    """Scores of (code, indicator, value) under weights (scenario, indicator, weight, direction), renormalised over what
    a territory has. Scenarios and limits are few."""
    rows = values.join(limits, "indicator").join(scenarios, "indicator")
    part = scale(F.col("value"), F.col("lo"), F.col("hi"), F.col("direction"))
    return rows.groupBy("scenario", "code").agg((F.sum(part * F.col("weight")) / F.sum("weight") * 100.0).alias("score"))


def reference_bounds(observations: DataFrame, periods: list[str]) -> DataFrame:
    return bounds(observations.where(F.col("period").isin(periods)), ["indicator"], "value", winsorized=True)
