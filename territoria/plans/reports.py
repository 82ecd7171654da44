"""Whole reports: figures as rows of one plan each, and Markdown of the few rows that are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from territoria.functions.numbers import scaled
from territoria.operators.ranks import average_ranks
from territoria.plans import governance

#: Rows of a report that are read into a text at most; more is an error, not a cut.
REPORT_ROWS = 1000


def markdown(df: DataFrame, digits: int = 1) -> str:
    """A small table as Markdown: figures with `digits` decimals, nulls as a dash."""
    rows = df.limit(REPORT_ROWS + 1).collect()
    if len(rows) > REPORT_ROWS:
        raise ValueError(f"a report has at most {REPORT_ROWS} rows")
    shown = lambda v: "-" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    return "\n".join("| " + " | ".join(x) + " |" for x in [df.columns, ["---"] * len(df.columns), *([shown(v) for v in r] for r in rows)])


def document(title: str, sections: dict[str, str | list[str]]) -> str:
    """A title and sections, each a text or a list of points."""
    parts = [f"# {title}"]
    for name, body in sections.items():
        parts.append(f"## {name}\n\n" + (body if isinstance(body, str) else "\n".join(f"- {x}" for x in body) or "- none"))
    return "\n\n".join(parts) + "\n"


def written(spark, text: str, path: str) -> None:
    """One text file's worth of report, through Spark so that any store will do."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def validation_summary(rows: DataFrame, departments: DataFrame, expected: int, keys: list[str]) -> DataFrame:
    """One row on a curated frame (departement_code, indicator_code, reference_period, value): rows, departments, those
    missing of the expected ones, rows without indicator or value, repeated keys, first and last period."""
    known = departments.select("departement_code").distinct()
    lacking = known.join(rows.select("departement_code"), "departement_code", "left_anti").agg(F.count("*").alias("missing_departments"))
    repeats = rows.groupBy(*keys).agg(F.count("*").alias("_n")).agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"))
    one = rows.agg(
        F.count("*").alias("rows"), F.count_distinct("departement_code").alias("departments"), F.count_if(F.col("indicator_code").isNull()).alias("unknown_indicators"),
        F.count_if(F.col("value").isNull()).alias("without_value"), F.min("reference_period").alias("first_period"), F.max("reference_period").alias("last_period"))
    return one.crossJoin(F.broadcast(lacking)).crossJoin(F.broadcast(repeats)).withColumn("complete", (F.col("departments") == expected) & (F.col("missing_departments") == 0))


def alerts(counts: DataFrame, severities: dict[str, str]) -> DataFrame:
    """(severity, name, n) of the counts (name, n) that aren't zero, errors first; a name without a severity warns."""
    severity = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in severities.items() for x in kv)), F.col("name")), F.lit("warning"))
    return counts.where("n > 0").select(severity.alias("severity"), "name", "n")


def score_validation(scored: DataFrame, criteria: DataFrame) -> DataFrame:
    """(indicator, n, spearman, pearson) of scores (code, period, score) against each outside criterion (code, period,
    indicator, value), over territories that have both; correlations of fewer than three pairs are null."""
    pairs = scored.where("score is not null").join(criteria.where("value is not null"), ["code", "period"]).select("indicator", F.col("score").alias("_s"), F.col("value").alias("_o"))
    ranked = average_ranks(pairs, {"_s": "_rs", "_o": "_ro"}, ["indicator"])
    enough = lambda c: F.when(F.count("*") >= 3, c)
    return ranked.groupBy("indicator").agg(F.count("*").alias("n"), enough(governance.correlation(F.col("_rs"), F.col("_ro"))).alias("spearman"), enough(governance.correlation(F.col("_s"), F.col("_o"))).alias("pearson"))


def sensitivity(values: DataFrame, limits: DataFrame, scenarios: DataFrame, baseline: str = "baseline") -> DataFrame:
    """(scenario, code, score, place, delta, moved): scores under each scenario's weights, with their place, and their
    difference in score and place from the baseline's."""
    rows = governance.scenario_scores(values, limits, scenarios, scaled)
    place = F.rank().over(Window.partitionBy("scenario").orderBy(F.desc("score")))
    placed = rows.withColumn("place", place.cast("long"))
    base = placed.where(F.col("scenario") == baseline).select("code", F.col("score").alias("_s"), F.col("place").alias("_p"))
    return placed.join(base, "code").select("scenario", "code", "score", "place", (F.col("score") - F.col("_s")).alias("delta"), (F.col("place") - F.col("_p")).alias("moved"))


def sensitivity_summary(rows: DataFrame) -> DataFrame:
    """(scenario, territories, mean_abs_delta, max_abs_delta, moved)."""
    return rows.groupBy("scenario").agg(F.count("*").alias("territories"), F.avg(F.abs("delta")).alias("mean_abs_delta"), F.max(F.abs("delta")).alias("max_abs_delta"), F.count_if(F.col("moved") != 0).alias("moved"))
