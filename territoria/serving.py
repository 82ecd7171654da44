"""What an API over the store answers: listings with filters and pages, each a lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from territoria.operators.reshape import conjunction, nested, page
from territoria.operators.windows import first_by

#: Rows of a page at most, by listing.
LIMITS = {"departments": 500, "indicators": 5000, "facts": 5000, "macro": 100_000, "dashboard": 250_000}
#: Columns of a fact's kind in the store (kind: the column of its value, the column of its time).
KINDS = {"deposits": ("value", "reference_period"), "macro": ("value", "reference_year"), "filings": ("value", "reference_year")}


class Conflict(LookupError):
    """A table that the answer needs isn't there."""


def health(spark: SparkSession, tables: dict[str, DataFrame], required: list[str]) -> DataFrame:
    """(name, rows, status): ok, empty or missing for each required table."""
    parts = [t.agg(F.count("*").alias("rows")).select(F.lit(n).alias("name"), "rows") for n, t in tables.items()]
    names = spark.createDataFrame([(n,) for n in required], "name string")
    counted = parts[0] if parts else spark.createDataFrame([], "name string, rows long")
    for p in parts[1:]:
        counted = counted.unionByName(p)
    status = F.when(F.col("rows").isNull(), "missing").when(F.col("rows") == 0, "empty").otherwise("ok")
    return names.join(counted, "name", "left").select("name", F.coalesce("rows", F.lit(0)).alias("rows"), status.alias("status"))


def tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    """(name, kind) of the tables and views that the session knows."""
    rows = [(t.name, "view" if t.tableType in ("VIEW", "TEMPORARY") else "table") for t in spark.catalog.listTables(database)]
    return spark.createDataFrame(sorted(rows), "name string, kind string")


def observability(runs: DataFrame, documents: DataFrame, observations: DataFrame) -> DataFrame:
    """(name, value): the last run's state, documents by status, observations, their latest period, territories."""
    last = first_by(runs.withColumn("_all", F.lit(1)), ["_all"], "at", descending=True)
    parts = [
        last.select(F.lit("last_run").alias("name"), F.col("status").alias("value")),
        documents.groupBy("status").agg(F.count("*").alias("n")).select(F.concat(F.lit("documents:"), F.coalesce("status", F.lit("unknown"))).alias("name"), F.col("n").cast("string").alias("value")),
        observations.agg(F.count("*").cast("string").alias("a"), F.max("period").alias("b"), F.count_distinct("code").cast("string").alias("c")).unpivot([], ["a", "b", "c"], "k", "value").select(F.element_at(F.create_map(*(F.lit(x) for x in ("a", "observations", "b", "latest_period", "c", "territories"))), F.col("k")).alias("name"), "value"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def departments(dim: DataFrame, region: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    rows = dim.where(conjunction({"region_name": region}))
    return page(rows.select("department_code", "department_name", "region_name"), [F.col("department_code")], limit, offset, LIMITS["departments"])


def indicators(dim: DataFrame, system: str | None = None, group: str | None = None, words: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """Indicators by source system and group, and by a part of their name in any case."""
    rows = dim.where(conjunction({"source_system": system, "indicator_group": group}))
    if words:
        rows = rows.where(F.contains(F.lower("indicator_name"), F.lit(words.lower())))
    return page(rows.select("indicator_key", "source_system", "indicator_code", "indicator_name", "indicator_group"), [F.col("indicator_key")], limit, offset, LIMITS["indicators"])


def facts(store: dict[str, DataFrame], kind: str, department: str | None = None, indicator: str | None = None, since: object = None, until: object = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """(kind, department_code, indicator_code, time, value) of one kind of facts, between two times where given. An
    unknown kind is an error, one whose table the store lacks a conflict."""
    if kind not in KINDS:
        raise ValueError(f"kinds are {', '.join(KINDS)}")
    if kind not in store:
        raise Conflict(f"the store has no {kind}")
    value, time = KINDS[kind]
    rows = store[kind].where(conjunction({"department_code": department, "indicator_code": indicator}))
    for bound, side in ((since, F.col(time) >= F.lit(since)), (until, F.col(time) <= F.lit(until))):
        rows = rows if bound is None else rows.where(side)
    rows = rows.select(F.lit(kind).alias("kind"), "department_code", "indicator_code", F.col(time).cast("string").alias("time"), F.col(value).alias("value"))
    return page(rows, [F.col("time"), F.col("department_code"), F.col("indicator_code")], limit, offset, LIMITS["facts"])


def region_macro(view: DataFrame, region: str | None = None, indicator: str | None = None, year: int | None = None, limit: int = 1000, offset: int = 0) -> DataFrame:
    rows = view.where(conjunction({"region_code": region, "indicator_code": indicator, "reference_year": year}))
    return page(rows, [F.col("reference_year"), F.col("region_code"), F.col("indicator_code")], limit, offset, LIMITS["macro"])


def dashboard(joined: DataFrame, aliases: dict[str, str], period: str | None = None, limit: int = 1000, offset: int = 0) -> DataFrame:
    """The joined view under the names a dashboard reads (new name to column); a column may have several names."""
    rows = joined.where(conjunction({"reference_period": period}))
    return page(rows.select(*(F.col(c).alias(n) for n, c in aliases.items())), [F.col(next(iter(aliases)))], limit, offset, LIMITS["dashboard"])


def observations(rows: DataFrame, documents: DataFrame, level: str | None = None, code: str | None = None, indicator: str | None = None, period: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """Observations with the document they come from."""
    found = rows.where(conjunction({"level": level, "code": code, "indicator": indicator, "period": period}))
    joined = found.join(documents.select("document_id", "title", "url"), "document_id", "left")
    return page(joined.select("id", "level", "code", "period", "indicator", "value", "unit", "title", "url"), [F.col("id")], limit, offset, LIMITS["facts"])


def latest_scores(scores: DataFrame, level: str | None = None, code: str | None = None, risk: str | None = None, period: str | None = None, calculated: bool | None = None, coverage: float | None = None) -> DataFrame:
    """The scores that all the filters given let through; calculated asks for those with or without a score."""
    rows = scores.where(conjunction({"level": level, "code": code, "risk": risk, "period": period}))
    if calculated is not None:
        rows = rows.where(F.col("score").isNotNull() == calculated)
    return rows if coverage is None else rows.where(F.col("coverage") >= coverage)


def score_of(scores: DataFrame, details: DataFrame, models: DataFrame, model: str | None = None, level: str = "department", code: str | None = None, period: str | None = None) -> DataFrame:
    """Scores with the name and version of their model, and their parts as an array, the largest contribution first."""
    rows = latest_scores(scores, level, code, None, period).join(models.where(conjunction({"model": model})), "model")
    parts = nested(details.withColumn("_k", -F.col("contribution")), ["model", "level", "period", "code"], ["_k", "indicator"], ["value", "normalized", "effective_weight", "contribution"])
    parts = parts.withColumn("details", F.transform("details", lambda x: x.dropFields("_k")))
    return rows.join(parts, ["model", "level", "period", "code"], "left")


def provenance(details: DataFrame, observations_: DataFrame, documents: DataFrame) -> DataFrame:
    """Each part of a score with the observation it was picked from and that one's document."""
    return details.join(observations_.select(F.col("id").alias("observation_id"), "document_id", "unit", "confidence"), "observation_id").join(documents.select("document_id", "title", "url"), "document_id")
